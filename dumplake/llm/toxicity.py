"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Defined results: a null text is an empty text and scores by the intercept alone; null or other labels than 0
and 1 teach nothing; several labels of one id count as their maximum, several rows of one id as the smallest
text; with only one class (or no labels) every score is the share of toxic labels. Columns of the input
stay, except one that an output of the same name replaces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumplake.llm.frames import text_or_empty, without
from dumplake.session import stage

BITS = 20
ORDERS = (4, 5, 6)
#: Bound of the training sample: labelled rows of each class, those with the smallest hash of their id.
PER_CLASS = 12_000
FEATURES = 8192
MIN_DOCS = 3
_CHUNK = 1 << 20


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    intercept: float


def _grams(text: str) -> list[np.ndarray]:
    """Hash slots of all n-grams of the lower-cased text with single blanks, a chunk at a time."""
    codes = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for at in range(0, len(codes), _CHUNK):
        part = codes[at : at + _CHUNK + ORDERS[-1] - 1]
        sums, h = np.uint32(1), part * np.uint32(1)
        for n in range(2, ORDERS[-1] + 1):
            if n > len(part):
                break
            sums = np.uint32((int(sums) * 0x01000193) & 0xFFFFFFFF)
            h = h[:-1] + part[n - 1 :] * sums
            if n in ORDERS:
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
                out.append(((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))
    return out


def present(text: str, table: np.ndarray) -> np.ndarray:
    """The distinct slots of a text that are not zero in ``table``."""
    hits = [g[table[g] != 0] for g in _grams(text)]
    return np.unique(np.concatenate(hits)) if hits else np.empty(0, np.uint32)


def _counts(batches):
    seen, pos, neg = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for pdf in batches:
        for y, text in zip(pdf["y"], pdf["text"]):
            for g in _grams(text):
                seen[g] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            (pos if y else neg)[found] += 1
    for slots in np.array_split(np.flatnonzero((pos > 0) | (neg > 0)), 16):
        yield pd.DataFrame({"f": slots.astype(np.int32), "pos": pos[slots], "neg": neg[slots]})


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame, float]:
    """At most ``per_class`` labelled texts of each class as ``y, text``, and the true log odds of the classes."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    totals = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = [rows.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    # At most 2 * per_class rows of two numbers, so this side is small at any size of the corpus.
    sample = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    sample = stage(sample.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text")).repartition(8), "toxic-sample")
    return sample, math.log((totals.get(1, 0) + 0.5) / (totals.get(0, 0) + 0.5))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int = FEATURES) -> Model:
    """Fit on a bounded sample of labelled rows; the sample and every pass over it are Spark tables."""
    sample, odds = training_sample(docs, labels, per_class)
    had = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(had) < 2:
        return Model(np.empty(0, np.int64), np.empty(0), odds)
    counts = sample.mapInPandas(_counts, "f int, pos int, neg int").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    a, b = (F.col("pos") + 1) / (had[1] + 2), (F.col("neg") + 1) / (had[0] + 2)
    share = (F.col("pos") + F.col("neg")) / (had[0] + had[1])
    gain = F.abs(F.col("pos") / had[1] - F.col("neg") / had[0]) / F.sqrt(share * (1 - share) + 1e-9)
    best = counts.where(F.col("pos") + F.col("neg") >= MIN_DOCS).select("f", F.log(a / b).alias("r"), gain.alias("gain")).orderBy(F.desc("gain"), "f").limit(features).collect()
    if not best:
        return Model(np.empty(0, np.int64), np.empty(0), odds)
    best.sort(key=lambda x: x.f)
    slots, ratios = np.array([x.f for x in best]), np.array([x.r for x in best])

    def vectors(batches):
        table = np.zeros(1 << BITS, bool)
        table[slots] = True
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["y"].astype(float), "at": [np.searchsorted(slots, present(t, table)) for t in pdf["text"]]})

    sparse = F.udf(lambda at: Vectors.sparse(len(slots), at, ratios[at]), VectorUDT())
    points = stage(sample.mapInPandas(vectors, "y double, at array<int>"), "toxic-points").select("y", sparse("at").alias("x"))
    line = LogisticRegression(featuresCol="x", labelCol="y", maxIter=40, regParam=1e-3, standardization=False).fit(points)
    return Model(slots, ratios * line.coefficients.toArray(), line.intercept + odds - math.log(had[1] / had[0]))


def toxicity(model: Model, text: Column) -> Column:
    """The score of a text, 0 to 1."""
    slots, weights, intercept = model.features, model.weights.astype(np.float32), model.intercept

    @F.pandas_udf("double")
    def score(batches: pd.Series) -> pd.Series:
        table = np.zeros(1 << BITS, np.float32)
        table[slots] = weights
        sums = [float(table[present(t, table)].sum(dtype=np.float64)) for t in batches]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(sums, float) + intercept, -700, 700))))

    return score(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``."""
    return without(docs, "score").withColumn("score", toxicity(model, docs["text"]))


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may teach: crc32 of the id as text leaves a remainder other than 1 by 3."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
