"""A corpus pipeline of five stages: documents in, token digests of the cleaned documents out.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and is written as a table before
the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dumplake.llm import bpe, decontaminate, line_dedup, simhash_dedup, toxicity
from dumplake.llm.frames import ready
from dumplake.llm.queries import RANKS
from dumplake.llm.registry import table
from dumplake.session import stage

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go; the rest stay as they are."""
    ready(spark)
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    return docs.where(toxicity.toxicity(model, F.col("text")) < TOXIC)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go from the texts; ``n_chars`` follows. No document goes."""
    ready(spark)
    out = line_dedup.dedup_lines(docs)
    n_chars = F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash the one with the smallest id stays."""
    ready(spark)
    return simhash_dedup.keep_one(docs)


def decontaminate_docs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    ready(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, decoded again, as digests per document."""
    ready(spark)
    return bpe.digests(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_near),
    ("decontaminate", decontaminate_docs),
    ("byte_bpe", encode),
]

#: SQL cannot express these stages; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
