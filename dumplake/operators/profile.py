"""File profiles, created tables and previews, before anything is loaded."""

from __future__ import annotations

import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrow import segments
from ..functions.text import trim
from ..session import stage
from ..sources.catalog import extension
from ..sources.lines import line_blocks, number_lines

# Size classes as (name, below bytes, share of memory, label).
SIZE_CLASSES = (
    ("tiny", 10 * 1024**2, 0.15, "Tiny (<10MB)"),
    ("small", 50 * 1024**2, 0.20, "Small (<50MB)"),
    ("medium", 500 * 1024**2, 0.40, "Medium (<500MB)"),
    ("large", 2 * 1024**3, 0.60, "Large (<2GB)"),
    ("massive", None, 0.75, "Massive (2GB+)"),
)

# Patterns for bulk inserts and created tables, and the line length of an empty file.
BULK_INSERT = r"(?i)INSERT\s+INTO\s+\S+\s+(?:\([^)]+\)\s+)?VALUES\s*\([^)]+\)\s*,"
CREATE_TABLE = r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"']?([a-zA-Z_][a-zA-Z0-9_]*)[`\"']?\s*\("
DEFAULT_LINE_BYTES = 200.0


def size_class(size: Column, is_gzip: Column) -> Column:
    """Size class as a struct (category, category_label, target_ram_usage)."""

    def entry(k: int) -> Column:
        name, _, share, label = SIZE_CLASSES[k]
        return F.struct(F.lit(name).alias("category"), F.lit(label).alias("category_label"), F.lit(share).alias("target_ram_usage"))

    out = entry(4)
    for k in range(3, -1, -1):
        out = F.when(size < SIZE_CLASSES[k][1], entry(k)).otherwise(out)
    return F.when(is_gzip | (size == 0), entry(2)).otherwise(out)


def profile_files(lines: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """One profile per file from all its lines: line count, size class, bulk inserts.

    ``sizes`` (file, size) are the stored sizes of a catalogue; without it the text bytes
    count. The text is read twice, once to count and once for the bulk pattern.
    """
    blocks = line_blocks(lines)
    totals = blocks.groupBy("file").agg(F.sum("bytes").alias("text_bytes"), F.sum("lines").alias("n_lines"))
    bulk = matches_across_lines(lines, BulkInserts(), blocks).groupBy("file").agg(F.count("*").alias("bulk"))
    if sizes is not None:
        totals = totals.join(sizes.select("file", F.col("size").alias("stored")), "file", "left")
    else:
        totals = totals.withColumn("stored", F.col("text_bytes"))
    is_gzip = extension(F.col("file")) == "gz"
    size = F.when(is_gzip, 0).otherwise(F.coalesce("stored", F.lit(0)))
    mean = F.when(F.col("n_lines") > 0, F.col("text_bytes") / F.col("n_lines")).otherwise(DEFAULT_LINE_BYTES)
    shaped = totals.join(bulk, "file", "left").select(
        "file", size.cast("long").alias("file_size"), is_gzip.alias("is_gzip"),
        mean.alias("avg_bytes_per_line"), F.col("bulk").isNotNull().alias("is_bulk_insert"),
        size_class(size, is_gzip).alias("cls"),
    )
    estimate = F.when(F.col("file_size") > 0, F.ceil(F.round(F.col("file_size") / F.col("avg_bytes_per_line"), 6)))
    return shaped.select(
        "file", "file_size", "cls.category", "cls.category_label", estimate.cast("long").alias("estimated_lines"),
        "avg_bytes_per_line", "is_bulk_insert", "cls.target_ram_usage", "is_gzip",
        (F.col("is_gzip") | (F.col("file_size") == 0)).alias("is_estimate"),
    )


# A chunk is whole lines, each with its line feed. At its end a match that is under way can only be where a line feed may
# stand, so a few numbered places describe it, and they, not the text, go from chunk to chunk and from block to block.
FOUND, DEAD = -1, 0


class BulkInserts:
    """``BULK_INSERT`` as steps from a keyword on.

    Places: 1 blanks after INSERT, 2 after INTO, 3 after the name, 4 in the columns, 5 after them, 6 after VALUES, 7 in the values, 8 after them.
    """

    start, word, places, once = re.compile(rb"(?i)INSERT(?=\s)"), "INSERT", 8, True
    _words = {1: re.compile(rb"(?i)INTO(?=\s)"), 2: re.compile(rb"\S+"), 3: re.compile(rb"(?i)VALUES"), 5: re.compile(rb"(?i)VALUES")}
    _next = {1: 2, 2: 3, 3: 6, 5: 6}

    def run(self, text: "_Chunk", at: int, place: int, name: str | None = None) -> tuple[int, str | None]:
        """Where a match stands at the end of the text, from ``at`` on."""
        data = text.data
        while True:
            if place in (4, 7):
                close = text.next_close(at)
                if close < 0:
                    return place, None
                if close == at and data[at - 1 : at] == b"(":
                    return DEAD, None
                at = close + 1
                if place == 4 and not data[at : at + 1].isspace():
                    return DEAD, None
                place += 1
            at = _BLANKS.match(data, at).end()
            if at == len(data):
                return place, None
            if place == 8:
                return (FOUND if data[at] == 44 else DEAD), None
            if data[at] == 40 and place in (3, 6):
                place, at = place + 1, at + 1
            elif place in self._next and (m := self._words[place].match(data, at)):
                place, at = self._next[place], m.end()
            else:
                return DEAD, None


class CreatedTables:
    """``CREATE_TABLE`` as steps from a keyword on.

    Places: blanks after 1 CREATE, 2 TABLE, 3 IF (which may be the name), 4 NOT, 5 EXISTS, 6 the name.
    """

    start, word, places, once = re.compile(rb"(?i)CREATE(?=\s)"), "CREATE", 6, False
    _words = {1: re.compile(rb"(?i)TABLE(?=\s)"), 3: re.compile(rb"(?i)NOT(?=\s)"), 4: re.compile(rb"(?i)EXISTS(?=\s)")}
    _next = {1: 2, 3: 4, 4: 5}
    _name = re.compile(rb"([`\"']?)([a-zA-Z_][a-zA-Z0-9_]*)([`\"']?)")

    def run(self, text: "_Chunk", at: int, place: int, name: str | None = None) -> tuple[int, str | None]:
        data = text.data
        while True:
            at = _BLANKS.match(data, at).end()
            if at == len(data):
                return place, name
            if place in (3, 6) and data[at] == 40:
                return FOUND, name
            if place in (2, 5):
                m = self._name.match(data, at)
                if not m:
                    return DEAD, None
                name, at = m[2].decode(), m.end()
                place = 3 if place == 2 and name.upper() == "IF" and not m[1] and not m[3] else 6
            elif place in self._next and (m := self._words[place].match(data, at)):
                place, at = self._next[place], m.end()
            else:
                return DEAD, None


_BLANKS = re.compile(rb"\s*")


class _Chunk:
    """Text with a look ahead for closing parentheses that never scans a stretch twice."""

    def __init__(self, data: bytes):
        self.data, self._from, self._close = data, 0, -2

    def next_close(self, at: int) -> int:
        if self._close == -2 or at < self._from or -1 < self._close < at:
            self._from, self._close = at, self.data.find(b")", at)
        return self._close


class _Block:
    """What is known of a block so far: matches under way that began in it, and what became of those that may have entered it."""

    def __init__(self, machine):
        self.machine = machine
        self.own: dict[int, tuple[int, str | None]] = {}   # place: first line, name
        self.entered: dict[int, tuple[int, str | None]] = {k: (k, None) for k in range(1, machine.places + 1)}
        self.found: list[tuple[int, str | None]] = []

    def idle(self) -> bool:
        return not self.own and all(place < 1 for place, _ in self.entered.values())

    def read(self, data: bytes, line: int) -> None:
        chunk, own = _Chunk(data), {}

        def keep(place, first, name):
            if place == FOUND:
                self.found.append((first, name))
            elif place != DEAD and first < own.get(place, (first + 1,))[0]:
                own[place] = (first, name)

        for k, (place, name) in self.entered.items():
            if place > 0:
                self.entered[k] = self.machine.run(chunk, 0, place, name)
        for place, (first, name) in self.own.items():
            after, named = self.machine.run(chunk, 0, place, name)
            keep(after, first, named)
        at, seen = 0, line
        for m in self.machine.start.finditer(data):
            if self.machine.once and self.found:
                break
            place, name = self.machine.run(chunk, m.end(), 1)
            if place != DEAD:
                seen += data.count(b"\n", at, m.start())
                at = m.start()
                keep(place, seen, name)
        self.own = own


_MATCHES = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("match", pa.string()), ("block", pa.int64()), ("state", pa.string())])


def matches_across_lines(lines: DataFrame, machine, blocks: DataFrame | None = None) -> DataFrame:
    """``file, pos, match``: where the matches of ``machine`` begin in the text of each file, over any number of lines and blocks.

    With ``machine.once`` at most the first of a block is given. Texts are searched as bytes, whatever their encoding.
    """

    def search(batches):
        key, block = None, None

        def ended():
            return {"file": key[0], "block": key[1], "state": json.dumps([list(block.own.items()), list(block.entered.items())])}

        for batch in batches:
            out = []
            for here, part in segments(batch):
                if here != key:
                    if key:
                        out.append(ended())
                    key, block = here, _Block(machine)
                value = part.column("value")
                if block.idle() and (machine.once and block.found or not pc.any(pc.match_substring(value, machine.word, ignore_case=True)).as_py()):
                    continue
                block.read(b"\n".join(value.cast(pa.binary()).to_pylist()) + b"\n", part.column("line_no")[0].as_py())
                found = block.found[:1] if machine.once else block.found
                out += [{"file": key[0], "pos": line, "match": name} for line, name in found]
                block.found = block.found[:1] if machine.once else []
            yield pa.RecordBatch.from_pylist(out, schema=_MATCHES)
        if key:
            yield pa.RecordBatch.from_pylist([ended()], schema=_MATCHES)

    def fold(batches):
        """Matches that begin in one block of a file and end in a later one; blocks come together and in order."""
        file, alive = None, {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["file"] != file:
                    file, alive = r["file"], {}
                own, entered = json.loads(r["state"])
                entered, after = dict(entered), {place: tuple(v) for place, v in own}
                for place, (first, name) in alive.items():
                    now, named = entered[place]
                    if now == FOUND:
                        out.append({"file": file, "pos": first, "match": named or name})
                    elif now != DEAD and first < after.get(now, (first + 1,))[0]:
                        after[now] = (first, named or name)
                alive = after
            yield pa.RecordBatch.from_pylist(out, schema=_MATCHES)

    numbered = number_lines(lines, blocks).select("file", "block", "line_no", "value")
    shape = "file string, pos long, match string, block long, state string"
    rows = stage(numbered.mapInArrow(search, shape), "line-matches")
    edges = rows.filter("block is not null").repartition("file").sortWithinPartitions("file", "block")
    return rows.filter("block is null").select("file", "pos", "match").union(edges.mapInArrow(fold, shape).select("file", "pos", "match"))


def created_tables(texts: DataFrame, order: str = "pos", text: str = "text") -> DataFrame:
    """Distinct tables created per file, with the place they first appear.

    Give it statements (comments do not match), or numbered lines for a raw text scan.
    """
    names = F.regexp_extract_all(text, F.lit(CREATE_TABLE), F.lit(1))
    found = texts.filter(F.col(text).rlike(CREATE_TABLE)).select(
        "file", F.col(order).alias("pos"), F.posexplode(names).alias("i", "table_name"))
    first = F.min(F.struct("pos", "i"))
    return found.groupBy("file", "table_name").agg(first.alias("first")).select(
        "file", "table_name", F.col("first.pos").alias("first_pos"))


def created_tables_raw(lines: DataFrame) -> DataFrame:
    """Created tables by text alone, comments included, also where a name stands on a line of its own."""
    found = matches_across_lines(lines, CreatedTables())
    return found.groupBy("file", F.col("match").alias("table_name")).agg(F.min("pos").alias("first_pos"))


def has_create_table(wanted: DataFrame, created: DataFrame) -> DataFrame:
    """Rows of (file, table_name) whose file creates the table, whatever the case."""
    have = created.select("file", F.lower("table_name").alias("_t"))
    return wanted.join(have, (wanted["file"] == have["file"]) & (F.lower(wanted["table_name"]) == have["_t"]), "left_semi")


def reset_tables(spark: SparkSession, created: DataFrame, file: str) -> dict[str, list[str]]:
    """Drop every table one file creates. Runs DDL: call it on purpose only."""
    names = [r.table_name for r in created.filter(F.col("file") == file).orderBy("first_pos").collect()]
    result: dict[str, list[str]] = {"dropped": [], "errors": []}
    for name in names:
        try:
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
            result["dropped"].append(name)
        except Exception as problem:  # one table's failure does not stop the others
            result["errors"].append(f"table {name} stays: {problem}")
    return result


def preview_lines(lines: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` lines of each file."""
    return number_lines(lines).filter(F.col("line_no") <= n).select("file", "line_no", "value")


def preview_statements(preview: DataFrame, most: int = 10) -> DataFrame:
    """Statements in the preview by line ends alone: no quotes, no delimiters but ``;``."""
    bare = trim(F.col("value"))
    skipped = bare.isin("", "0") | bare.startswith("--") | bare.startswith("#") | bare.startswith("/*")
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    kept = preview.filter(~skipped).withColumn("ends", bare.endswith(";"))
    numbered = kept.withColumn("query_no", F.coalesce(F.sum(F.col("ends").cast("int")).over(order), F.lit(0)) + 1)
    parts = F.array_sort(F.collect_list(F.struct("line_no", "value")))
    text = F.array_join(F.transform(parts, lambda p: p["value"]), "\n")
    grouped = numbered.groupBy("file", "query_no").agg(trim(text).alias("query"), F.max("ends").alias("complete"))
    return grouped.filter(F.col("complete") & (F.col("query_no") <= most)).select("file", "query_no", "query")


def count_lines(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file").agg(F.count("*").alias("total_lines"))
