"""How filters of a corpus interact: what each removes, repeats or loses under every order of applying them.

Five conditions mark a document: few words (A), few different words (B), many capitals (C), odd signs (D), and a text that a
document with a smaller id has too (E). A to D are column expressions. E is existential: documents left-semi join the smallest
id of every repeated text on hash, exact text and smaller id. Its rows are united with the other marks, rows of one document
collapse to one combination of five bits, and an order is then read off at most 32 counts a part.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumplake.session import broadcast_within, stage

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]

#: The limits of the conditions and the characters of words.
MIN_WORDS = 50
MIN_DISTINCT_PCT = 65
MAX_CAPITALS_PCT = 5
BLANKS = r"[\x20\x09-\x0D]+"
SIGNS = r"[#$%&*|]"

#: Rows of one text that one task compares; a text with more is dealt to several.
ROWS_A_TASK = 20_000


def text_bits(text: Column) -> Column:
    """Bits 1, 2, 4, 8 of conditions A to D."""
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), BLANKS)  # no word: one empty string, which changes no condition
    n = F.size(words).cast("long")
    few = n < MIN_WORDS
    dull = 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PCT * n
    length = F.length(text).cast("long")
    loud = 100 * (length - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > MAX_CAPITALS_PCT * length
    bits = [few, dull, loud, text.rlike(SIGNS)]
    return reduce(add, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(bits)])


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("h"), text.alias("text"))


def later_copies(docs: DataFrame, marked: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Rows (doc_id, part, h) whose exact text a row with a smaller id has.

    ``marked`` holds doc_id and h of every row. Only rows whose hash occurs under two ids bring their texts to the join; its
    other side has one row per repeated text, with the smallest id. A text with very many rows is split by ids, its row repeated per split.
    """
    repeated = marked.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    repeated = stage(repeated.where("low < high").select("h", F.ceil(F.col("n") / rows_a_task).cast("int").alias("splits")), "repeated")
    repeated, _ = broadcast_within(repeated)
    rows = _rows(docs).where("doc_id IS NOT NULL").join(repeated, "h")
    firsts = rows.groupBy("h", "splits", "text").agg(F.min("doc_id").alias("first_id"))
    firsts = firsts.select("h", "text", "first_id", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"))
    rows = rows.withColumn("split", F.pmod(F.xxhash64("doc_id"), F.col("splits")).cast("int"))
    later = (rows.h == firsts.h) & (rows.split == firsts.split) & (rows.text == firsts.text) & (firsts.first_id < rows.doc_id)
    return rows.join(firsts, later, "left_semi").select("doc_id", "part", "h")


def failures(docs: DataFrame) -> DataFrame:
    """Per doc_id, part and text hash: ``bits`` of the five conditions and the number ``n`` of its rows."""
    rows = _rows(docs).select("doc_id", "part", "h", text_bits(F.col("text")).alias("bits"))
    marked = stage(rows, "filter-marks")
    copies = later_copies(docs, marked).withColumns({"bits": F.lit(16), "n": F.lit(0)})
    every = marked.withColumn("n", F.lit(1)).unionByName(copies)
    return every.groupBy("doc_id", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))


def _sum(field: str, where: str) -> Column:
    return F.expr(f"aggregate(combos, 0L, (s, c) -> s + IF({where}, c.{field}, 0L))")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of documents per part, order of the filters and step.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic (a document is good or toxic if any of its labels
    says so). Out: part, filter_order, step and kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts are empty, null sources the part ''. Every row counts, repeated rows too; rows with equal ids are no copies of each other.
    Rows without an id count, are never E and mark none. Texts of any length are read whole, in the JVM. An empty table gives no rows;
    other columns of the inputs are ignored, and ties cannot arise.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    fails = stage(failures(docs), "filter-fails")
    with_id = fails.where("doc_id IS NOT NULL").join(known, "doc_id", "left")
    without = fails.where("doc_id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    combos = with_id.unionByName(without).groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    parts = combos.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("combos"))
    steps = parts.select("part", "combos", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    bit = "shiftleft(1, ascii({}) - ascii('A'))"
    before = F.expr(f"aggregate(filter(split(left(filter_order, step - 1), ''), x -> x <> ''), 0, (m, x) -> m | {bit.format('x')})")
    steps = steps.withColumns({"before": before, "bit": F.expr(bit.format("substring(filter_order, step, 1)"))})
    here = "c.bits & before = 0 AND c.bits & bit != 0"
    # Of the orders of a document's k failed filters one in k starts with a given one.
    return steps.select(
        "part", "filter_order", "step", _sum("n", "c.bits & (before | bit) = 0").alias("kept"), _sum("n", here).alias("removed"),
        _sum("n", "c.bits & before != 0 AND c.bits & bit != 0").alias("redundant"), _sum("n", "c.bits = bit").alias("unique_fails"),
        _sum("good", here).alias("good_lost"), _sum("toxic", here).alias("toxic_lost"),
        F.expr(f"aggregate(combos, 0L, (s, c) -> s + IF(c.bits & bit != 0, c.n * {len(ORDERS)} div bit_count(c.bits), 0L))").alias("shapley"))
