import random
from collections import Counter, defaultdict
from itertools import permutations
import re

from dumplake.llm.filter_audit import audit, failures, later_copies

LABELS = "doc_id long, quality int, toxic int, part string"


def plain(docs, labels):
    """Every order applied document by document."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    rows = [(i, s or "", t or "") for i, t, s in docs]
    fails = []
    for i, part, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        capitals = sum("A" <= c <= "Z" for c in text)
        bad = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * capitals > 5 * len(text),
               "D": any(c in "#$%&*|" for c in text), "E": i is not None and any(j is not None and j < i and u == text for j, _, u in rows)}
        fails.append({k for k, v in bad.items() if v})
    out = defaultdict(Counter)
    for order in map("".join, permutations("ABCDE")):
        for (i, part, _), bad in zip(rows, fails):
            gone = False
            for step, f in enumerate(order, 1):
                c = out[part, order, step]
                if f in bad:
                    c["redundant" if gone else "removed"] += 1
                    c["good_lost"] += not gone and i in good
                    c["toxic_lost"] += not gone and i in toxic
                    c["unique_fails"] += bad == {f}
                    gone = True
                c["kept"] += not gone
    shapley = Counter()
    for (part, order, step), c in out.items():
        shapley[part, order[step - 1]] += c["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {k: tuple(c[n] for n in names) + (shapley[k[0], k[1][k[2] - 1]],) for k, c in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_all_orders_like_document_by_document(spark):
    rng = random.Random(4)
    words = ["one", "Two", "THREE", "a#b", "vier", "Ünf"] + [f"w{i}" for i in range(80)]
    docs = []
    for i in range(120):
        text = " ".join(rng.choices(words[: rng.choice([4, 30, 86])], k=rng.choice([0, 10, 49, 50, 80])))
        docs.append((rng.choice([i, i, i, None, 7]), rng.choice([text, text, None, docs[0][1] if docs else text]), rng.choice(["s1", "s2", None, ""])))
    docs += docs[:5] + [(500, "x " * 30_000, "s1"), (501, "x" * 200_000, "s1")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(60), *range(20), None]]
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, source string, kept int, part string, bits int")
    lab = spark.createDataFrame([(*x, "p") for x in labels], LABELS)
    assert got(audit(frame, lab)) == plain(docs, labels)


def test_a_text_with_very_many_rows_is_split(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same', if(id % 3 = 1, 'other ' || id, 'pair ' || id div 6)) AS text", "'s' AS source")
    marked = docs.selectExpr("doc_id", "xxhash64(text) AS h")
    few, many = later_copies(docs, marked, rows_a_task=10), later_copies(docs, marked)
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() == 299 + 150
    joins = few._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in joins and "split" in joins and "CartesianProduct" not in few._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(docs, labels).count() == 0 and failures(docs).count() == 0
    one = spark.createDataFrame([(None, None, None)], docs.schema)
    assert got(audit(one, labels))["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
