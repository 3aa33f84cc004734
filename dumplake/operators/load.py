"""Rows of INSERT statements as typed tables, with schemas from the dump's own DDL."""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import as_bytes, as_text, stretches
from ..functions.literals import DECLARATION, literal_text, number_text
from ..functions.text import trim
from ..functions.tuples import STRETCH_BYTES, advance, cut_lists, cut_part, summarise
from ..session import broadcast_within, stage

_CREATE = r"(?is)^CREATE\s+(?:TEMPORARY\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?((?:`(?:[^`]|``)+`|\"[^\"]+\"|[^\s`\"(.]+)(?:\.(?:`(?:[^`]|``)+`|[^\s`\"(.]+))?)\s*\((.*)\)[^)]*$"
_KEY_WORDS = r"(?i)^(?:PRIMARY|UNIQUE|KEY|INDEX|FULLTEXT|SPATIAL|CONSTRAINT|FOREIGN|CHECK)\b"

# Spark types by DDL type name.
TYPES = {
    "tinyint": T.ByteType(), "smallint": T.ShortType(), "mediumint": T.IntegerType(), "int": T.IntegerType(),
    "integer": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(),
    "real": T.DoubleType(), "bool": T.BooleanType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "datetime": T.TimestampNTZType(), "timestamp": T.TimestampNTZType(), "year": T.ShortType(),
    "blob": T.BinaryType(), "tinyblob": T.BinaryType(), "mediumblob": T.BinaryType(), "longblob": T.BinaryType(),
    "binary": T.BinaryType(), "varbinary": T.BinaryType(),
}

# Types an UNSIGNED column widens to.
UNSIGNED = {
    "tinyint": T.ShortType(), "smallint": T.IntegerType(), "mediumint": T.IntegerType(),
    "int": T.LongType(), "integer": T.LongType(), "bigint": T.DecimalType(20, 0),
}


# A quoted name may hold any character, its quote doubled; a bare one ends at a blank, dot, comma or parenthesis.
_PART = r"(?:`(?:[^`]|``)++`|\"(?:[^\"]|\"\")++\"|[^\s`\"'(),.]++)"
_NAME = rf"{_PART}(?:\s*\.\s*{_PART})?"

# Verb, options, table and columns of a statement with a VALUES list. VALUES stands right after the name or
# the columns, so the same word inside a string is never taken for it.
_HEAD = (rf"(?is)^(INSERT|REPLACE)\b((?:\s+(?:LOW_PRIORITY|DELAYED|HIGH_PRIORITY|IGNORE)\b)*+)(?:\s+INTO\b)?\s*({_NAME})\s*"
         rf"(?:\(((?:`(?:[^`]|``)*+`|[^)`])*+)\)\s*)?VALUES?\s*(?=\()")


def unquoted(c: Column) -> Column:
    """A name without its quotes, lower-cased."""
    name = F.btrim(c, F.lit(" \t\n\r"))
    inner = F.substring(name, F.lit(2), F.length(name) - 2)
    return F.lower(F.when(name.startswith("`"), F.replace(inner, F.lit("``"), F.lit("`"))).when(
        name.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(name))


def bare_name(c: Column) -> Column:
    """A table name without quotes and database, lower-cased."""
    return unquoted(F.regexp_extract(c, rf"({_PART})\s*$", 1))


def table_columns(statements: DataFrame) -> DataFrame:
    """Columns declared by CREATE TABLE statements: file, table, ordinal, name, type, key."""
    # The staged keyword lets a load leave all other texts unread.
    statements = statements.filter("keyword = 'CREATE'") if "keyword" in statements.columns else statements
    ddl = statements.filter(F.col("text").rlike(_CREATE))
    body = F.regexp_extract("text", _CREATE, 2)
    parts = F.transform(F.regexp_extract_all(body, F.lit(DECLARATION), F.lit(1)), lambda p: trim(p))
    keys = F.filter(parts, lambda p: p.rlike(r"(?i)^(?:CONSTRAINT\s+\S+\s+)?PRIMARY\s+KEY"))
    key_text = F.regexp_extract(F.try_element_at(keys, F.lit(1)), r"(?is)KEY[^(]*\((.*)\)", 1)
    key_columns = F.transform(F.regexp_extract_all(key_text, F.lit(rf"({_PART})(?:\s*\(\d+\))?\s*(?:ASC|DESC)?\s*(?:,|$)"), F.lit(1)), unquoted)
    columns = F.filter(parts, lambda p: ~p.rlike(_KEY_WORDS) & (p != ""))
    spread = ddl.select(
        "file", "pos", bare_name(F.regexp_extract("text", _CREATE, 1)).alias("table"),
        key_columns.alias("keys"), F.posexplode(columns).alias("ordinal", "decl"),
    )
    shape = rf"^({_PART})\s+([A-Za-z]+)\s*(\([^)]*\))?(.*)$"
    name = unquoted(F.regexp_extract("decl", "(?s)" + shape, 1))
    rest = F.regexp_extract("decl", "(?s)" + shape, 4)
    return spread.select(
        "file", "pos", "table", "ordinal", name.alias("column"),
        F.lower(F.regexp_extract("decl", "(?s)" + shape, 2)).alias("type"),
        F.regexp_extract("decl", "(?s)" + shape, 3).alias("arguments"),
        rest.rlike(r"(?i)\bUNSIGNED\b").alias("unsigned"),
        (F.array_contains(F.coalesce("keys", F.array()), name) | rest.rlike(r"(?i)\bPRIMARY\s+KEY\b")).alias("is_key"),
    )


def _spark_type(kind: str, arguments: str, unsigned: bool) -> T.DataType:
    numbers = [int(n) for n in re.findall(r"\d+", arguments or "")]
    if kind in ("decimal", "numeric", "dec"):
        precision, scale = (numbers + [10, 0])[0], numbers[1] if len(numbers) > 1 else 0
        # What a Spark decimal cannot hold stays text.
        return T.DecimalType(precision, scale) if scale <= precision <= 38 else T.StringType()
    if unsigned and kind in UNSIGNED:
        return UNSIGNED[kind]
    return TYPES.get(kind, T.StringType())


def table_schemas(statements: DataFrame, table: str | None = None) -> dict[str, tuple[T.StructType, list[str]]]:
    """Schema and primary key of each table (or of one) from its first CREATE TABLE.

    Brings only the declared columns to the driver.
    """
    columns = table_columns(statements)
    columns = columns if table is None else columns.filter(F.col("table") == table.lower())
    first = columns.groupBy("table").agg(F.min(F.struct("file", "pos")).alias("_first"))
    rows = columns.join(first, "table").filter(F.col("_first") == F.struct("file", "pos")).orderBy("table", "ordinal").collect()
    out: dict[str, tuple[T.StructType, list[str]]] = {}
    for r in rows:
        schema, key = out.setdefault(r["table"], (T.StructType(), []))
        schema.add(r["column"], _spark_type(r["type"], r["arguments"], r["unsigned"]))
        key += [r["column"]] if r["is_key"] else []
    return out


def table_schema(statements: DataFrame, table: str) -> tuple[T.StructType, list[str]]:
    """Schema and primary key of one table."""
    found = table_schemas(statements, table)
    if not found:
        raise ValueError(f"no CREATE TABLE for {table}")
    return found[table.lower()]


def _heads(rows: DataFrame, kept: list[str]) -> DataFrame:
    """``rows`` with what stands before their VALUES list, and ``rest``, the list and all after it (null: no list)."""
    text = F.col("text")
    found = rows.select(*kept, "text", F.regexp_extract(text, _HEAD, 0).alias("_head"))
    head = F.col("_head")
    listed = head != ""
    whole = F.concat(head, F.lit("("))  # the pattern looks ahead to the first parenthesis
    names = F.regexp_extract(whole, _HEAD, 4)
    columns = F.transform(F.regexp_extract_all(names, F.lit(rf"({_PART})"), F.lit(1)), unquoted)
    return found.select(
        *kept, F.when(listed, bare_name(F.regexp_extract(whole, _HEAD, 3))).alias("table"), F.upper(F.regexp_extract(whole, _HEAD, 1)).alias("verb"),
        F.upper(F.regexp_extract(whole, _HEAD, 2)).alias("options"), F.when(names != "", columns).alias("names"),
        F.when(listed, F.substring(text, F.length(head) + 1, F.length(text))).alias("rest"))


def _cut(batches):
    for batch in batches:
        rest = batch.num_columns - 1
        for part in stretches(batch, rest, STRETCH_BYTES):
            yield pa.RecordBatch.from_arrays([*part.columns[:rest], *cut_lists(part.column(rest))], names=[*batch.schema.names[:-1], "tuples", "after"])


def _cut_rows(rows: DataFrame) -> DataFrame:
    """Replace ``rest``, the last column, by the literals of its tuples and what follows them."""
    schema = T.StructType(rows.schema.fields[:-1]).add("tuples", T.ArrayType(T.ArrayType(T.StringType()))).add("after", "string")
    return rows.mapInArrow(_cut, schema)


_KEYS = ["file", "stmt", "pos"]


def _summaries(batches):
    for batch in batches:
        found = [summarise(as_bytes(batch.column(3), i)) for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([json.dumps(f) for f in found], pa.string())], names=[*_KEYS, "summary"])


def _entries(batches):
    """State, depth and whether the list is over at the start of each part; parts of a statement come together and in order."""
    key, now = None, (0, 0, False)
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if (r["file"], r["stmt"]) != key:
                key, now = (r["file"], r["stmt"]), (0, 0, False)
            out.append({**{k: r[k] for k in _KEYS}, "state": now[0], "depth": now[1], "over": now[2]})
            state, depth, over = advance(json.loads(r["summary"]), now[0], now[1])
            now = (state, depth, now[2] or over)
        yield pa.RecordBatch.from_pylist(out, schema=_ENTRIES)


_ENTRIES = pa.schema([("file", pa.string()), ("stmt", pa.int64()), ("pos", pa.int64()), ("state", pa.int32()), ("depth", pa.int64()), ("over", pa.bool_())])


def _cut_parts(batches):
    for batch in batches:
        for few in stretches(batch, 3, STRETCH_BYTES):
            out = {k: [] for k in ("lead", "list", "open", "after")}
            for i, (state, depth, over) in enumerate(zip(*[c.to_pylist() for c in few.columns[4:]])):
                text = as_bytes(few.column(3), i)
                cut = (b"", b"", b"", text) if over else cut_part(text, state, depth)
                for column, piece in zip(out.values(), cut):
                    column.append(piece or None)
            yield pa.RecordBatch.from_arrays([*few.columns[:3], *[as_text(c) for c in out.values()]], names=[*_KEYS, *out])


def _lists_in_parts(parts: DataFrame, kept: list[str]) -> DataFrame:
    """Rows like those of whole statements from the parts of statements that are too long for one row.

    Parts are summarised on their own, one short row each is folded along a statement, and each part is cut from its true state.
    Only a tuple that lies on a border is put together from its pieces.
    """
    first = parts.filter("pos = stmt")
    heads = stage(_heads(first, [*kept, "stmt"]).drop("rest"), "list-heads")
    rest = _heads(first, ["file", "stmt", "pos"]).select(*_KEYS, "rest")
    lines = rest.filter("rest is not null").union(
        parts.filter("pos > stmt").join(F.broadcast(heads.filter("table is not null").select("file", "stmt")), ["file", "stmt"], "left_semi").select(*_KEYS, "text"))
    summary = lines.mapInArrow(_summaries, "file string, stmt long, pos long, summary string").repartition("file", "stmt").sortWithinPartitions(*_KEYS)
    entries = stage(summary.mapInArrow(_entries, "file string, stmt long, pos long, state int, depth long, over boolean"), "list-entries")
    placed = lines.join(broadcast_within(entries)[0], _KEYS)
    cut = stage(placed.select(*_KEYS, "rest", "state", "depth", "over").mapInArrow(
        _cut_parts, "file string, stmt long, pos long, lead string, list string, open string, after string"), "list-parts")
    # A tuple on a border: the part that opens it, and the leads of the parts up to the one that closes it.
    group = F.sum(F.col("open").isNotNull().cast("long")).over(Window.partitionBy("file", "stmt").orderBy("pos"))
    numbered = cut.select(*_KEYS, F.col("open").isNotNull().alias("opens"), F.col("lead").isNotNull().alias("leads"), group.alias("n"))
    texts = cut.filter("open is not null").select(*_KEYS, F.lit(1).alias("turn"), F.col("open").alias("t")).union(
        cut.filter("lead is not null").select(*_KEYS, F.lit(0), "lead"))
    pieces = texts.join(numbered, _KEYS).withColumn("n", F.when(F.col("turn") == 1, F.col("n")).otherwise(F.col("n") - F.col("opens").cast("long")))
    parts_of = F.array_sort(F.collect_list(F.struct("pos", "turn", "t")))
    joined = pieces.groupBy("file", "stmt", "n").agg(
        F.min("pos").alias("pos"), F.array_join(F.transform(parts_of, lambda p: p["t"]), "\n").alias("rest"))
    chunks = cut.filter("list is not null").select(*_KEYS, F.lit(0).alias("turn"), F.col("list").alias("rest")).union(
        joined.select(*_KEYS, F.lit(1), "rest"))
    done = stage(_cut_rows(chunks).withColumnRenamed("after", "unclosed").withColumn("n", F.size("tuples").cast("long")), "list-tuples")
    along = Window.partitionBy("file", "stmt").orderBy("pos", "turn")
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = done.select(*_KEYS, "turn", before.alias("first_item"), (F.row_number().over(along) == 1).alias("head"))
    afters = F.array_sort(F.collect_list(F.struct("pos", "turn", "t")))
    after = cut.select(*_KEYS, F.lit(2).alias("turn"), F.col("after").alias("t")).union(done.select(*_KEYS, "turn", "unclosed")).filter("t <> ''")
    after = after.groupBy("file", "stmt").agg(F.array_join(F.transform(afters, lambda p: p["t"]), "\n").alias("after"))
    rows = done.join(firsts, [*_KEYS, "turn"]).select("file", "stmt", "tuples", "first_item", "head")
    # The tuples of one statement may be most of the table: the short heads go to them, not they to their head.
    heads = stage(heads.join(after, ["file", "stmt"], "left"), "list-ends")
    empty = heads.join(done.select("file", "stmt").distinct(), ["file", "stmt"], "left_anti")
    full = rows.join(broadcast_within(heads)[0], ["file", "stmt"]).unionByName(empty, allowMissingColumns=True)
    shown = {"pos": F.col("stmt"), "part": F.lit(0)}
    return full.select(
        *[shown.get(c, F.col(c)).alias(c) for c in kept], "table", "verb", "options", "names",
        F.coalesce("tuples", F.expr("CAST(array() AS array<array<string>>)")).alias("tuples"), F.coalesce("after", F.lit("")).alias("after"),
        F.coalesce("first_item", F.lit(0).cast("long")).alias("first_item"), F.coalesce("head", F.lit(True)).alias("head"))


def value_lists(statements: DataFrame) -> DataFrame:
    """Statements with a VALUES list: table, columns, mode, the literals of their tuples and what follows the tuples.

    mode: 'insert', 'ignore', 'replace' or 'update' (ON DUPLICATE KEY UPDATE). Rows that start like an INSERT or REPLACE
    but have no such list have a null ``table``. Tuples may be of any length and nested to any depth. A statement in parts gives a
    row per stretch of its tuples, ``first_item`` being the number of tuples before it; its first row has ``head`` set.
    """
    kept = [c for c in ("file", "pos", "part", "error") if c in statements.columns]
    starts = F.col("text").rlike(r"(?i)^(?:INSERT|REPLACE)\b")
    in_parts = "part" in statements.columns and "stmt" in statements.columns
    whole = statements.filter(starts & (F.col("part") == 0) if in_parts else starts)
    found = _cut_rows(_heads(whole, kept)).withColumns({"first_item": F.lit(0).cast("long"), "head": F.lit(True)})
    if in_parts and not (parts := statements.filter("part > 0")).isEmpty():
        long = parts.filter((F.col("pos") == F.col("stmt")) & starts).select("file", "stmt")
        found = found.unionByName(_lists_in_parts(parts.join(F.broadcast(long), ["file", "stmt"], "left_semi"), kept))
    after = F.btrim("after", F.lit(" \t\n\r;"))
    mode = F.when(F.col("verb") == "REPLACE", "replace").when(after.rlike(r"(?is)^(?:AS\s.*)?ON\s+DUPLICATE\s+KEY\s+UPDATE\b"), "update").when(
        F.col("options").contains("IGNORE"), "ignore").otherwise("insert")
    return found.select(*kept, "table", mode.alias("mode"), after.alias("after"), "names", "tuples", "first_item", "head")


def list_tuples(lists: DataFrame) -> DataFrame:
    """One row per value tuple of ``value_lists``, with its literals as text."""
    spread = lists.filter("table is not null").select(
        "file", "pos", "table", (F.col("mode") == "ignore").alias("is_ignore"), "mode", "names", "first_item", F.posexplode("tuples").alias("item", "items"))
    return spread.withColumn("item", F.col("first_item") + F.col("item")).drop("first_item")


def insert_tuples(statements: DataFrame) -> DataFrame:
    """One row per value tuple of INSERT and REPLACE statements, with its literals as text."""
    return list_tuples(value_lists(statements))


def text_schemas(lists: DataFrame, known: list[str]) -> dict[str, tuple[T.StructType, list[str]]]:
    """Schemas of text columns for the tables of ``value_lists`` that are not ``known``.

    Columns are those the statements name, in the order of the dump, or col_1 to the longest tuple where none names any.
    Brings one row per table and column list to the driver.
    """
    width = F.array_max(F.transform("tuples", lambda t: F.size(t)))
    rows = lists.filter(F.col("table").isNotNull() & ~F.col("table").isin(list(known))).groupBy("table", "names").agg(
        F.min(F.struct("file", "pos")).alias("at"), F.max(width).alias("width")).orderBy("table", "at").collect()
    columns: dict[str, list[str]] = {}
    for r in rows:
        named = columns.setdefault(r["table"], [])
        named += [n for n in dict.fromkeys(r["names"] or []) if n not in named]
    for r in rows:
        if not columns[r["table"]]:
            columns[r["table"]] = [f"col_{k + 1}" for k in range(max(x["width"] or 0 for x in rows if x["table"] == r["table"]))]
    return {t: (T.StructType([T.StructField(c, T.StringType()) for c in names]), []) for t, names in columns.items()}


def _typed(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BinaryType):
        hexed = F.unhex(F.substring(text, F.lit(3), F.length(text)))
        return F.when(text.rlike("(?i)^0x[0-9a-f]*$"), hexed).otherwise(text.cast("binary"))
    return text.try_cast(kind)


def _value(item: Column, kind: T.DataType) -> Column:
    if not isinstance(kind, T.NumericType):
        return _typed(literal_text(item), kind)
    text = number_text(item)
    word = F.upper(text)
    return F.coalesce(text.try_cast(kind), F.when(word == "TRUE", F.lit(1)).when(word == "FALSE", F.lit(0)).cast(kind))


def _items(schema: T.StructType) -> list[Column]:
    """The literal of each column of ``schema`` in a row of ``insert_tuples``, null where the statement does not name it."""
    out = []
    for k, field in enumerate(schema.fields):
        named = F.array_position("names", field.name.lower()).cast("int")
        index = F.when(F.col("names").isNull(), F.lit(k + 1)).otherwise(named)
        out.append(F.when(index > 0, F.try_element_at("items", index)))
    return out


def typed_rows(tuples: DataFrame, schema: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``insert_tuples`` of one table, cast to ``schema``; values that do not cast (such as zero dates) are null."""
    values = [_value(item, f.dataType).alias(f.name) for item, f in zip(_items(schema), schema.fields)]
    return tuples.select(*keep, *values)


def load_rows(statements: DataFrame, table: str, schema: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """All rows that INSERT and REPLACE statements give for ``table``, cast to ``schema``.

    ``keep`` adds columns of ``insert_tuples`` (file, pos, item, is_ignore, mode).
    """
    tuples = insert_tuples(statements).filter(F.col("table") == table.lower())
    return typed_rows(tuples, schema, keep)


def storable(schema: T.StructType) -> Column:
    """Whether a row of ``insert_tuples`` has a value for each column it names, and names only columns of ``schema``."""
    known = F.array(*[F.lit(f.name.lower()) for f in schema.fields]) if schema.fields else F.expr("CAST(array() AS array<string>)")
    named = (F.size("items") == F.size("names")) & (F.size(F.array_except("names", known)) == 0)
    return F.when(F.col("names").isNull(), F.size("items") == len(schema.fields)).otherwise(named)


def rejects(statements: DataFrame, schemas: dict[str, T.StructType], lists: DataFrame | None = None) -> DataFrame:
    """What a load cannot store as it stands: file, pos, item, table, column, reason.

    Statements without a readable VALUES list, what follows one unread, labels; and of tuples: tables and columns that are not in
    ``schemas``, numbers of values that do not fit, values that do not cast. Rows with a failed cast are stored with a null; the others
    here, but for labels, are not stored. Without any schema only statements are checked. One plan for any number of tables: their
    columns come as a joined row of names and types.
    """
    none = F.lit(None)
    lists = value_lists(statements) if lists is None else lists
    shape = ("file", "pos")
    odd = F.when(F.col("table").isNull(), "no VALUES list").when(
        (F.col("after") != "") & (F.col("mode") != "update") & ~F.col("after").rlike(r"(?is)^(?:AS\s.*)?ON\s+DUPLICATE\b"), "unread text after the values")
    out = lists.filter(F.col("head") & odd.isNotNull()).select(
        *shape, none.cast("long").alias("item"), "table", none.cast("string").alias("column"), odd.alias("reason"))
    if "error" in statements.columns:
        out = out.union(statements.filter("error is not null").select(*shape, none.cast("long"), none.cast("string"), none.cast("string"), "error"))
    if not schemas:
        return out
    declared = statements.sparkSession.createDataFrame(
        [(t.lower(), [f.name.lower() for f in s.fields], [f.dataType.simpleString() for f in s.fields]) for t, s in schemas.items()],
        "table string, _columns array<string>, _types array<string>")
    rows = list_tuples(lists).join(broadcast_within(declared)[0], "table", "left")

    def problem(column, reason):
        return F.struct(column.cast("string").alias("column"), reason.cast("string").alias("reason"))

    unknown = F.transform(F.array_except("names", "_columns"), lambda c: problem(c, F.lit("no such column")))
    wanted = F.coalesce(F.size("names"), F.size("_columns"))
    wanted = F.when(F.col("names").isNull(), F.size("_columns")).otherwise(wanted)
    wrong = F.array(problem(none, F.format_string("%d values for %d columns", F.size("items"), wanted)))
    kinds = {f.dataType.simpleString(): f.dataType for s in schemas.values() for f in s.fields if not isinstance(f.dataType, T.StringType)}

    def failed(field, k):
        named = F.array_position("names", field["_columns"]).cast("int") - 1
        item = F.get("items", F.when(F.col("names").isNull(), k).otherwise(F.when(named >= 0, named)))
        bad = F.lit(False)
        for name, kind in kinds.items():
            bad = F.when(field["_types"] == name, _value(item, kind).isNull()).otherwise(bad)
        given = item.isNotNull() & (F.trim(item) != "")
        return F.when(given & bad & literal_text(item).isNotNull(), problem(field["_columns"], F.concat(F.lit("no "), field["_types"])))

    casts = F.filter(F.transform(F.arrays_zip("_columns", "_types"), failed), lambda x: x.isNotNull())
    found = F.when(F.col("_columns").isNull(), F.array(problem(none, F.lit("table without columns")))).when(F.size(unknown) > 0, unknown).when(
        F.size("items") != wanted, wrong).otherwise(casts)
    bad = rows.select(*shape, "item", "table", F.explode(found).alias("b"))
    return out.union(bad.select(*shape, "item", "table", "b.column", "b.reason"))


def first_per_key(rows: DataFrame, key: list[str], order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """INSERT IGNORE: of the rows with one key keep the first, and none that ``existing`` holds. A null in a key never collides.

    ``min_by`` over whole rows aggregates before the shuffle, so a hot key stays small.
    """
    rest = [c for c in rows.columns if c not in key]
    known = reduce(and_, [F.col(k).isNotNull() for k in key])
    first = rows.filter(known).groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    kept = first.select(*[F.col("_row")[c].alias(c) if c in rest else F.col(c) for c in rows.columns])
    kept = kept.join(existing.select(*key), key, "left_anti") if existing is not None else kept
    return kept.select(*rows.columns).unionByName(rows.filter(~known))


def resolve_keys(rows: DataFrame, key: list[str], order: tuple[str, ...] = ("file", "pos", "item")) -> DataFrame:
    """The rows a table holds after a load in dump order, from rows with their ``mode``.

    An IGNORE row gives way to any earlier row with its key. A REPLACE row, or one with ON DUPLICATE KEY UPDATE, takes the place of
    the earlier rows with its key (the update's own expressions are not evaluated: the row given last stays). A null in a key never collides.
    """
    known = reduce(and_, [F.col(k).isNotNull() for k in key])
    at = F.struct(*order)
    per = rows.filter(known).groupBy(*key).agg(
        F.min(at).alias("_first"), F.max(F.when(F.col("mode").isin("replace", "update"), at)).alias("_last"), F.count("*").alias("_n")).filter("_n > 1")
    joined = rows.filter(known).join(per, key, "left").withColumn("_at", at)
    stays = F.col("_n").isNull() | (
        ((F.col("mode") != "ignore") | (F.col("_at") == F.col("_first"))) & (F.col("_last").isNull() | (F.col("_at") >= F.col("_last"))))
    return joined.filter(stays).select(*rows.columns).unionByName(rows.filter(~known))
