"""PII by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Base entities come from the four patterns below. They are the seeds: the word before a seed and its kind make a lexical
pattern. Every other token that could be an identifier of that kind (``SHAPES``, which the base patterns miss) is an
instance of the pattern of the word before it. Rounds of scoring go over the graph of patterns and distinct values: the confidence of a
pattern is the mean confidence of its values (seeds have 1), smoothed by one; a pattern with enough seed values
and confidence is promoted; the confidence of a value is that of any promoted pattern being right. Values that
reach ``CONFIDENCE`` are personal data wherever they stand, unless a base span overlaps them.

Only texts' spans and words leave the scan, never the texts. A word or value that is in a third of all rows is an aggregate, summed before it is shuffled.

Defined results: a null or empty text has no spans; repeated rows give a row each; offsets are code points, ends exclusive; matches that fail their check
are dropped and not tried again elsewhere; an empty table gives no rows. Columns of the input go, but for ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumplake.llm.frames import text_or_empty
from dumplake.session import stage

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns. The start conditions and possessive repeats find the same matches as the plain forms, in time
# that follows the length of the text also for very long words and digit runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this sign has no match.
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
CHECKS = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), x -> length(trim(LEADING '0' FROM x)) <= 3 AND coalesce(try_cast(trim(LEADING '0' FROM x) AS int), 0) <= 255)",
    "card": "length(regexp_replace(m, '[ -]', '')) BETWEEN 13 AND 19 AND luhn_check(regexp_replace(m, '[ -]', ''))",
    "phone": "length(regexp_replace(m, '[^0-9]', '')) BETWEEN 9 AND 15",
}
#: Tokens that may be an identifier of a kind, though no base pattern says so.
SHAPES = {
    "email": r"length(m) <= 64 AND m RLIKE '^[A-Za-z0-9._%+-]+(@|[(]at[)])[A-Za-z0-9-]+$'",
    "ip": r"length(m) <= 64 AND m RLIKE '^[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{0,4}){3,7}$'",
    "card": r"length(m) <= 64 AND m RLIKE '^[0-9]+([._/][0-9]+)*$' AND length(regexp_replace(m, '[^0-9]', '')) BETWEEN 13 AND 19",
    "phone": r"length(m) <= 64 AND m RLIKE '^[(]?[0-9]+([-.)/]+[0-9]+){1,5}$' AND length(regexp_replace(m, '[^0-9]', '')) BETWEEN 9 AND 12",
}
_TOKEN = r"(?<!\S)\S*(?:[0-9@]|[(]at[)])\S*"
_BLOCK = 512
SEEDS, CONFIDENCE, ROUNDS = 3, 0.8, 3


def _quote(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _running(lengths: str) -> Column:
    """Sums of all numbers before each of an array; blocks keep it linear for very long arrays."""
    step = "aggregate({0}, named_struct('s', 0L, 'o', cast(array() AS array<bigint>)), (a, v) -> named_struct('s', a.s + {1}, 'o', array_append(a.o, a.s)))"
    inner = step.format("b", "cast(v AS bigint)")
    blocks = f"transform(sequence(0, greatest(cast(ceil(size({lengths}) / {_BLOCK}.0) AS int) - 1, 0)), i -> slice({lengths}, i * {_BLOCK} + 1, {_BLOCK}))"
    parts = f"transform({blocks}, b -> {inner})"
    bases = step.format("p", "v.s") + ".o"
    return F.expr(f"transform(array({parts}), p -> flatten(zip_with(p, {bases}, (x, y) -> transform(x.o, v -> v + y))))[0]")


def _found(rows: DataFrame, pattern: str, sign: str | None, out: str) -> DataFrame:
    """Add ``out``: an array of start, end, m (the match) and left (the text before it, from the match before on)."""
    text = f"CASE WHEN contains(_text, '{sign}') THEN _text ELSE '' END" if sign else "_text"
    rows = rows.withColumns({"_m": F.expr(f"regexp_extract_all({text}, {_quote(pattern)}, 0)"), "_g": F.expr(f"split({text}, {_quote(pattern)}, -1)")})
    # Most texts have no match; for them nothing is added up.
    rows = rows.withColumn("_l", F.expr("zip_with(_m, slice(_g, 1, size(_m)), (m, g) -> length(m) + length(g))"))
    rows = rows.withColumn("_s", F.when(F.size("_m") > 0, _running("_l")))
    pairs = "zip_with(_m, slice(_g, 1, size(_m)), (m, g) -> named_struct('m', m, 'g', g))"
    spans = (f"CASE WHEN size(_m) > 0 THEN zip_with({pairs}, _s, (x, s) -> named_struct("
             "'start', s + length(x.g), 'end', s + length(x.g) + length(x.m), 'm', x.m, 'left', x.g)) END")
    return rows.withColumn(out, F.expr(spans)).drop("_m", "_g", "_l", "_s")


#: The last word before a span, lower-cased, or nothing if it has no letter or a digit.
_WORD = "lower(substring_index(substring_index(substring_index(trim(TRAILING ' \\n\\t\\r' FROM x.left), ' ', -1), '\\n', -1), '\\t', -1))"


def _words(name: str, kind: str, check: str) -> str:
    """Checked spans of a kind: kind, start, end, value, and the pattern's word."""
    return (f"transform(filter(coalesce({name}, array()), x -> {check}), "
            f"x -> named_struct('kind', {KINDS.index(kind)}, 'start', x.start, 'end', x.end, 'value', xxhash64(x.m), 'word', {_WORD}))")


def _of(x: str, check: str) -> str:
    """A check on ``m`` as one on the match of ``x``."""
    return check.replace("(m,", f"({x}.m,").replace("(m)", f"({x}.m)").replace("m RLIKE", f"{x}.m RLIKE")


def scan(docs: DataFrame) -> DataFrame:
    """``_row, doc_id, base, other``: base spans and tokens that may be identifiers, with the word before each."""
    rows = docs.select("doc_id", text_or_empty().alias("_text"))
    columns = []
    for kind in KINDS:
        rows = _found(rows, PATTERNS[kind], SIGNS[kind], f"_{kind}")
        columns.append(_words(f"_{kind}", kind, _of("x", CHECKS[kind])))
    rows = _found(rows, _TOKEN, None, "_token")
    rows = rows.drop("_text")
    # Punctuation around a token is not part of it.
    bare = r"regexp_replace(x.m, '^[\"\'<\\[{]+|[\"\'>\\]},;:!?.]+$', '')"
    rows = rows.withColumn("_token", F.expr(
        f"transform(_token, x -> named_struct('start', x.start + length(regexp_extract(x.m, '^[\"\\'<\\\\[{{]+', 0)), 'm', {bare}, 'left', x.left))"))
    rows = rows.withColumn("_token", F.expr("transform(_token, x -> named_struct('start', x.start, 'end', x.start + length(x.m), 'm', x.m, 'left', x.left))"))
    other = [_words("_token", kind, _of("x", SHAPES[kind])) for kind in KINDS]
    lexical = r"filter({0}, x -> x.word RLIKE '^[^0-9]*\\p{{L}}[^0-9]*$')"
    return rows.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id",
        F.expr(f"concat({', '.join(columns)})").alias("base"), F.expr(lexical.format(f"concat({', '.join(other)})")).alias("other"))


def score(edges: DataFrame, seeds: int = SEEDS, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """``kind, value, conf`` of all values from ``kind, word, value, seed`` (distinct but for seed)."""
    values = edges.groupBy("kind", "value").agg(F.max("seed").cast("double").alias("conf"))
    for _ in range(rounds):
        patterns = edges.join(values, ["kind", "value"]).groupBy("kind", "word").agg(
            F.sum("seed").alias("seeds"), (F.sum("conf") / (F.count("*") + 1)).alias("conf"))
        promoted = patterns.where((F.col("seeds") >= seeds) & (F.col("conf") >= confidence)).select("kind", "word", F.least("conf", F.lit(0.999)).alias("p"))
        values = stage(edges.join(promoted, ["kind", "word"], "left").groupBy("kind", "value").agg(
            F.greatest(F.max("seed").cast("double"), 1 - F.exp(F.sum(F.log(1 - F.coalesce("p", F.lit(0.0)))))).alias("conf")), "pii-values")
    return values


def find(docs: DataFrame, seeds: int = SEEDS, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, the number of base spans by kind, the hash of the base spans, and all spans as text."""
    rows = stage(scan(docs), "pii-spans")
    one = lambda name, seed: rows.select(F.explode(name).alias("x")).where("x.word RLIKE r'^[^0-9]*\\p{L}[^0-9]*$'").select("x.kind", "x.word", "x.value", F.lit(seed).alias("seed"))
    edges = one("base", 1).union(one("other", 0)).groupBy("kind", "word", "value").agg(F.max("seed").alias("seed"))
    known = score(stage(edges, "pii-graph"), seeds, confidence, rounds).where(F.col("conf") >= confidence).select("kind", "value")
    unseen = rows.select("_row", F.explode("other").alias("x")).select("_row", "x.kind", "x.value", "x.start", "x.end").join(known, ["kind", "value"], "left_semi")
    added = unseen.groupBy("_row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    text = "array_join(transform(array_sort({0}), x -> concat_ws(':', element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), x.kind + 1), x.start, x.end)), ',')"
    out = rows.join(added, "_row", "left").select(
        "doc_id", F.expr("transform(base, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))").alias("base"),
        F.expr("filter(coalesce(added, array()), a -> NOT exists(base, b -> a.start < b.end AND b.start < a.end))").alias("more"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) AS bigint)").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return out.select(
        "doc_id", *counts, F.sha2(F.expr(text.format("base")), 256).alias("base_sha256"), F.expr(text.format("concat(base, more)")).alias("spans"))
