"""Toxicity by held-out accuracy, embeddings against brute force."""

import random
import zlib

import numpy as np
import pytest
from check_oracle import compare
from conftest_paths import SF
from pyspark.sql import functions as F

from dumplake.llm import nn_descent, queries, toxicity
from dumplake.llm.registry import ORACLE


def labelled(spark, n=900, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["ba", "co", "di", "fu", "ge", "lo", "mi"], k=3))
    bad = ["grumbol", "znarfe", "quiblex"]
    docs, labels = [], []
    for i in range(n):
        y = int(i % 5 == 0)
        words = [word() for _ in range(rng.randint(5, 200))]
        if y:
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "st", "ung"]))
        docs.append((i, " ".join(words), "en"))
        labels.append((i, None if i % 50 == 1 else y))
    labels += [(None, 1), (3, 0), (0, 0), (n + 5, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    rows = toxicity.score_documents(docs, toxicity.fit(docs, toxicity.learnable(labels))).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = sum((r.score >= 0.7) == (r.doc_id % 5 == 0) for r in held)
    assert right / len(held) >= 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_labels_are_never_inputs_of_a_score(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, toxicity.learnable(labels))
    swapped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, toxicity.learnable(swapped))
    assert (model.features == again.features).all() and np.allclose(model.weights, again.weights)


def test_odd_rows_and_one_class(spark, odd_docs, no_docs):
    docs, labels = labelled(spark, 60)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_documents(odd_docs, model)
    assert sorted(rows.columns) == sorted(odd_docs.columns)
    got = rows.select("doc_id", "text", F.col("score").alias("s")).collect()
    assert len(got) == 11 and all(0 <= r.s <= 1 for r in got)
    assert len({r.s for r in got if not r.text}) == 1
    assert toxicity.score_documents(no_docs, model).count() == 0
    for some in (labels.where("toxic = 0"), labels.limit(0)):
        model = toxicity.fit(docs, some)
        assert len({r.score for r in toxicity.score_documents(docs, model).collect()}) == 1


def test_very_long_text_scores_like_its_grams():
    table = np.ones(1 << toxicity.BITS, bool)
    text = " ".join(f"w{i % 977}x{i % 13}" for i in range(400_000))
    assert len(text) > toxicity._CHUNK
    a, b = text[: toxicity._CHUNK + 500], text[toxicity._CHUNK - 500 :]
    both = np.union1d(toxicity.present(a, table), toxicity.present(b, table))
    assert len(np.setdiff1d(toxicity.present(text, table), both)) == 0


def test_toxicity_query(spark):
    rows = queries.op3_toxicity(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)


# --- embeddings ---------------------------------------------------------------------------------

def brute(rows):
    vec = []
    for _, x, label in rows:
        v = None if x is None or label is None or not x or any(c is None for c in x) else np.array(x, float)
        vec.append(v if v is not None and np.isfinite(v).all() and v @ v > 0 else None)
    n, up = len(rows), list(range(len(rows)))
    links = [0] * n

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = vec[i], vec[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    low = {}
    for i in range(n):
        low[root(i)] = min(low.get(root(i), 2**63), rows[i][0])
    return sorted((rows[i][0], links[i], low[root(i)], rows[i][0] == low[root(i)]) for i in range(n))


def test_query_matches_sql(spark):
    same, _, _, detail = compare(spark, SF, "op7_nn_descent", queries.op7_nn_descent, ORACLE["op7_nn_descent"])
    assert same, detail


def test_clusters_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 32)
    monkeypatch.setattr(nn_descent, "LEAF_MOST", 64)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 12))
    rows = []
    for i in range(600):
        c = 0 if i % 3 == 0 else int(rng.integers(0, 150))  # a third of the rows are copies of one vector
        noise = 0 if i % 9 == 0 else 0.06
        rows.append((len(rows), [float(x) for x in (base[c] * rng.choice([1, 1, 3]) + noise * rng.standard_normal(12)).astype(np.float32)], int(c % 4)))
    odd = [None, [], [0.0] * 12, [None] * 12, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [1.0] * 5, rows[0][1]]
    rows += [(600 + i, x, 0) for i, x in enumerate(odd)] + [(700, rows[0][1], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit("x"), "w": F.lit(1), "vec": F.lit(2)})
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in nn_descent.link_vectors(frame).collect())
    assert got == brute(rows)


def test_saturated_lists_are_enlarged(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((6, 16))
    sizes = [2, 9, 30, 35, 38, 12]
    rows = [(len(rows), x, 0) for rows in [[]] for c, n in enumerate(sizes) for x in [[float(v) for v in base[c] + 0.1 * rng.standard_normal(16)] for _ in range(n)]]
    rows = [(i, x, label) for i, (_, x, label) in enumerate(rows)]
    compared = []
    blocks = nn_descent._count_blocks
    monkeypatch.setattr(nn_descent, "_count_blocks", lambda members, threshold: compared.append(members.count()) or blocks(members, threshold))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found, recall = nn_descent.search_links(frame)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect()) == brute(rows)
    assert compared == [0] and recall == 1.0, "no list is saturated at 40 places, so nothing is left to blocks"


def test_vectors_whose_squares_are_no_doubles(spark):
    small = [1.0, 2.0, 3.0, 0.5]
    rows = [(0, small, 1), (1, [1e300 * v for v in small], 1), (2, [1e-300 * v for v in small], 1), (3, [5e-324, 0.0, 0.0, 0.0], 1), (4, [1.0, 0.0, 0.0, 0.0], 1)]
    got = nn_descent.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(0, 2, 0), (1, 2, 0), (2, 2, 0), (3, 1, 3), (4, 1, 3)]


def test_too_low_a_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "_audit", lambda *a: 0.5)
    monkeypatch.setattr(nn_descent, "ATTEMPTS", 1)
    with pytest.raises(RuntimeError, match="0.500"):
        nn_descent.link_vectors(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], "vec_id long, embedding array<double>, label int"))


def test_no_vectors(spark):
    assert nn_descent.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
