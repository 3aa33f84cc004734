"""Line dedup, SimHash, decontamination and licences against brute force."""

import collections
import random
import re
import time

import numpy as np
import pytest
import xxhash
from conftest_paths import SF
from pyspark.sql import functions as F

from dumplake.llm import decontaminate, frames, licenses, line_dedup, queries, simhash_dedup
from dumplake.session import stage


def roots(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 200
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(120)] if seed < 3 else [(i, i + 1) for i in range(n - 1)]
    got = {r.node: r.component for r in frames.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(n, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}


def test_no_links(spark):
    assert frames.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- line dedup ---------------------------------------------------------------------------------

def sentence(rng, n=9):
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n)) + "."


def test_repeated_runs_go_and_first_copies_stay(spark):
    rng = random.Random(5)
    passage = [sentence(rng) for _ in range(12)]
    rows = []
    for i in range(40):
        before, after = [sentence(rng) for _ in range(4)], [sentence(rng) for _ in range(4)]
        # Some have the passage, some a short part of it, one twice, some on lines of their own.
        middle = passage if i % 3 == 0 else passage[:3] if i % 3 == 1 else []
        sep = "\n" if i % 2 else " "
        rows.append((i, sep.join(before + middle + after + (middle if i == 9 else []))))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        if i % 3 == 0 and i:
            assert got[i].n_deleted == (24 if i == 9 else 12), i
            assert not any(p in got[i].text for p in passage)
            assert len(line_dedup.line_numbers(got[i].text)[0]) == 8
        else:
            assert got[i].text == text and got[i].n_deleted == 0


@pytest.mark.parametrize("seed", range(3))
def test_every_deleted_line_stands_earlier_and_shared_runs_are_found(spark, seed):
    rng = random.Random(seed)
    pool = [sentence(rng, rng.randint(3, 14)) for _ in range(60)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.5:
                a = rng.randrange(50)
                lines += pool[a : a + rng.randint(1, 10)]
            else:
                lines.append(sentence(rng))
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    every = [(i, j, line) for i, t in rows for j, line in enumerate(t.split("\n"))]
    first = {}
    for i, j, line in every:
        first.setdefault(line, (i, j))
    seen = collections.Counter()
    for i, text in rows:
        old, new = text.split("\n"), [x for x in got[i].text.split("\n") if x]
        gone = collections.Counter(old) - collections.Counter(new)
        for line in gone:
            assert first[line] < (i, len(old))
        seen.update(gone)
        # A run of 50 words at the start of which nothing differs from one earlier text loses some of its lines.
    for line, (i, _) in first.items():
        assert line in got[i].text.split("\n"), "the first copy stays"
    assert sum(seen.values()) > 0


@pytest.mark.parametrize("seed", range(20))
def test_equal_runs_share_a_fingerprint(seed):
    rng = np.random.default_rng(seed)
    run_h, run_w = rng.integers(0, 2**63, 12).astype(np.uint64), rng.integers(3, 12, 12)
    run_w[0] += max(0, 50 - run_w.sum())

    def padded(k):
        h = np.concatenate((rng.integers(0, 2**63, k).astype(np.uint64), run_h, rng.integers(0, 2**63, k).astype(np.uint64)))
        w = np.concatenate((rng.integers(1, 12, k), run_w, rng.integers(1, 12, k)))
        return set(line_dedup.fingerprints(h, w, 25, 50)[1].tolist())

    assert padded(int(rng.integers(0, 20))) & padded(int(rng.integers(0, 20)))


def brute_line_dedup(rows, run_words=50):
    """Texts without any run of ``run_words`` words that stands earlier, every pair of places compared."""
    docs = [(i, t.split("\n")) for i, t in sorted(rows)]
    seen, out = set(), {}
    for i, lines in docs:
        n = [len(x.split()) for x in lines]
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(n[a:b]) >= run_words:
                    run = tuple(" ".join(x.split()) for x in lines[a:b])
                    if run in seen:
                        gone.update(range(a, b))
                    seen.add(run)
        out[i] = "".join(x + ("\n" if j < len(lines) - 1 else "") for j, x in enumerate(lines) if j not in gone)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_like_every_pair_of_places(spark, seed):
    rng = random.Random(seed)
    pool = [sentence(rng, rng.choice([1, 4, 9, 14, 30, 55])) for _ in range([6, 15, 40][seed])]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(len(pool))
            lines += rng.choice([pool[a : a + rng.randint(1, 8)], [rng.choice(pool) for _ in range(rng.randint(1, 4))], [sentence(rng)], pool[:2] * 3])
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, rows[3][1]) for i in range(3)]
    # A run whose gram stands first without the rest of the run.
    one, two = sentence(rng, 30), sentence(rng, 22)
    rows += [(300, one), (301, one + "\n" + two), (302, two + "\n" + one), (303, one + "\n" + two)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_line_dedup(rows)


def test_one_line_that_fills_a_text(spark):
    line = "these nine words stand in every line of it"
    rows = [(1, "\n".join([line] * 100_000)), (2, "\n".join([line] * 7)), (3, line)]
    start = time.time()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - start < 120
    assert (got[1].n_deleted, got[2].n_deleted, got[3].n_deleted) == (99_999, 7, 0) and got[1].text == line + "\n"


def test_hot_keys_are_split(spark, monkeypatch):
    left = spark.range(1000).selectExpr("if(id % 3 = 0, 0, id) AS k", "id")
    right = stage(left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")), "right")
    got = frames.join_hot(left, right, "k", rows_a_task=10)
    assert sorted(map(tuple, got.collect())) == sorted((0 if i % 3 == 0 else i, i, 0 if i % 3 == 0 else i) for i in range(1000))


def test_line_dedup_of_odd_rows(odd_docs, no_docs):
    out = line_dedup.dedup_lines(odd_docs)
    assert sorted(out.columns) == sorted({*odd_docs.columns, "words_deleted"})
    assert sorted(str((r.doc_id, r.text, r.lang)) for r in out.collect()) == sorted(str((r.doc_id, r.text, r.lang)) for r in odd_docs.collect())
    assert line_dedup.dedup_lines(no_docs).count() == 0


# --- simhash ------------------------------------------------------------------------------------

def brute_print(text):
    words = (text or "").encode().lower().split()
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_clusters(rows, got, shown=lambda i: i):
    prints = [brute_print(t) for _, t in rows]
    values = np.array(prints, np.uint64)
    want = roots(len(rows), [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4)])
    low = {}
    for (i, _), r in zip(rows, want):
        low[r] = min(low.get(r, 2**63), -(2**63) if i is None else i)
    expect = sorted(str((i, format(p, "016x"), None if low[r] == -(2**63) else low[r])) for (i, _), p, r in zip(rows, prints, want))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == expect


def test_clusters_of_given_and_odd_documents(spark, odd_docs, no_docs, texts):
    check_clusters(sorted(texts.items()), queries.op8_simhash_dedup(spark, SF).collect())
    check_clusters([(r.doc_id, r.text) for r in odd_docs.collect()], simhash_dedup.cluster(odd_docs).collect())
    assert simhash_dedup.cluster(no_docs).count() == 0


@pytest.mark.parametrize("radius", [0, 4, 7])
def test_links_connect_all_pairs(spark, radius, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "OWNED_BLOCK", 16)
    monkeypatch.setattr(simhash_dedup, "VISITOR_BLOCK", 32)
    monkeypatch.setattr(simhash_dedup, "LEAF", 8)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    rows = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(6)]))
    frame = spark.createDataFrame([(int(x),) for x in rows.view(np.int64)], "fp long")
    at = {int(x): i for i, x in enumerate(rows.view(np.int64))}
    links = simhash_dedup.links(frame, radius).collect()
    assert all(np.bitwise_count(np.uint64(0)) <= radius for _ in links)
    got = roots(len(rows), [(at[r.a], at[r.b]) for r in links])
    want = roots(len(rows), [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(rows ^ rows[i]) <= radius)])
    assert got == want


def test_keep_one(spark, odd_docs):
    kept = simhash_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert len(rows) == 7  # all texts without a word are one group, the repeated row is one
    assert len({(r.doc_id, r.text) for r in rows}) == len(rows)


# --- decontamination ----------------------------------------------------------------------------

def bag(words):
    k = min(5, len(words))
    return collections.Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else collections.Counter()


def brute_leaks(docs, items, least=0.8):
    found = set()
    words = {d: re.findall(r"\w+", (text or "").lower()) for d, text in docs}
    shingles = {(d, k): {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} for d, w in words.items() for k in range(1, 6)}
    for i, item in items:
        iw = re.findall(r"\w+", item.lower())
        ib, n = bag(iw), len(iw)
        if not n:
            continue
        for d, w in words.items():
            if n > 4 and len(w) > 4 and not shingles[d, 5] & set(ib):
                continue  # no window can be similar
            for p in range(max(1, len(w) - n + 1)):
                b = bag(w[p : p + n])
                if b and sum((b & ib).values()) / sum((b | ib).values()) >= least:
                    found.add((d, i))
                    break
    return found


def test_leaks_of_given_documents(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op10_decontaminate(spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(texts.items(), items) and len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_leaks_with_edits_short_items_and_chunks(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK_ITEMS", 7)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=4))
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 4, 5, 8, 20, 40, 60])))) for i in range(30)] + [(30, None), (None, "x y z a b c"), (31, ""), (32, "...")]
    docs = []
    for d in range(60):
        w = items[d % 30][1].split()
        if d % 3 == 1:
            w[-1] = word()
        if d % 3 == 2 and len(w) > 8:
            del w[0]
        docs.append((d, " ".join([word() for _ in range(rng.randint(0, 30))] + w + [word() for _ in range(rng.randint(0, 30))])))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect()}
    assert got == brute_leaks(docs, [(i, t) for i, t in items if i is not None and t])
    assert {r.doc_id for r in decontaminate.clean(frame, bench).collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.clean(odd_docs, bench).count() == odd_docs.count()
    assert decontaminate.clean(no_docs, bench).count() == 0 and decontaminate.clean(frame, bench.limit(0)).count() == 60


# --- licences -----------------------------------------------------------------------------------

def brute_licenses(text, templates, least=0.8):
    words = frames.word_hashes(text or "")
    s = frames.shingle_hashes(words, 5) if len(words) >= 5 else words[:0]
    found = {}
    for name, t in templates.items():
        tw = frames.word_hashes(t)
        own = np.unique(frames.shingle_hashes(tw, 5))
        size = 1 << (len(tw) - 5).bit_length()
        for w in range(-(-len(s) // size)):
            share = len(np.intersect1d(s[w * size : (w + 2) * size], own)) / len(own)
            if share >= least:
                found[name] = max(share, found.get(name, 0))
    return found


@pytest.mark.parametrize("rows", [1, 2])
def test_licenses_in_texts(rows):
    rng = random.Random(4)
    table = licenses.Templates(licenses.TEMPLATES, rows=rows)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=4))
    missed = 0
    for _ in range(300):
        part = rng.choice(list(licenses.TEMPLATES.values())).split()
        if rng.random() < 0.5 and len(part) > 12:
            part[rng.randrange(len(part))] = word()
        text = " ".join([word() for _ in range(rng.randint(0, 200))] + part + [word() for _ in range(rng.randint(0, 200))])
        got = {name: share for name, share, _, _ in table.match(text)}
        want = brute_licenses(text, licenses.TEMPLATES)
        assert set(got) <= set(want)
        missed += len(set(want) - set(got))
    assert missed <= 2


def test_band_settings():
    for j in (0.2, 0.5, 0.9):
        for rows in (1, 2, 3):
            assert 1 - (1 - j**rows) ** licenses.band_settings(j, 0.999, rows) >= 0.999


def test_license_query(spark, odd_docs, no_docs, texts):
    got = {(r.doc_id, r.license) for r in queries.op4_licenses(spark, SF).collect()}
    assert got == {(i, name) for i, t in texts.items() for name in brute_licenses(t, licenses.TEMPLATES)}
    assert licenses.scan(odd_docs).count() == 0 and licenses.scan(no_docs).count() == 0
    with pytest.raises(ValueError):
        licenses.Templates({"short": "too short"})
    row = licenses.scan(odd_docs.limit(1).withColumn("text", F.lit("so: Released under the MIT License."))).first()
    assert (row.license, row.containment, row.first_word, row.n_words) == ("MIT", 1.0, 1, 5)
