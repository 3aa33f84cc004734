"""Registered queries over dumps rendered from the given tables.

The tables hold no dumps, so each query renders a table as dump lines (or files) first and
then runs the operators over all of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literals import quote
from ..operators.batches import BatchOptions, batch_stats, commit_groups
from ..operators.csvrows import csv_inserts, csv_records, csv_rows, valid_table_name
from ..operators.inserts import analyse_inserts, statement_counts
from ..operators.load import first_per_key, insert_tuples, load_rows, table_columns
from ..operators.profile import (
    count_lines, created_tables, created_tables_raw, has_create_table, preview_lines, preview_statements, profile_files,
)
from ..operators.scan import ScanOptions, scan
from ..operators.sessions import line_sessions
from ..operators.statements import accepted, quality, split_statements
from ..session import stage, stage_path
from ..sinks import write_dump
from ..sources.lines import read_lines
from ..sources.render import insert_text, statement_lines, table_lines, values_text
from .jobs import Loaded, csv_dump, load_dump, load_table, optimise
from .registry import query, table

# Statements per block of rendered lines, by how long their text is.
SHORT, LONG = 50_000, 500


def _text_columns(df: DataFrame) -> DataFrame:
    """Timestamps as text, so that they compare without a time zone."""
    return df.select(*[
        F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def _reload(df: DataFrame, name: str, key: str, per_block: int) -> DataFrame:
    split = split_statements(table_lines(df, name, key, per_block))
    return _text_columns(load_rows(analyse_inserts(accepted(split.statements)), name, df.schema))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders")
def load_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Table to dump lines to statements to typed rows."""
    return _reload(table(spark, sf, "orders"), "orders", "o_orderkey", SHORT)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def load_customer(spark: SparkSession, sf: str) -> DataFrame:
    return _reload(table(spark, sf, "customer"), "customer", "c_custkey", SHORT)


@query("SELECT event_id, CAST(ts AS VARCHAR) AS ts, user_id, event_type, value, props FROM events")
def load_events(spark: SparkSession, sf: str) -> DataFrame:
    """Strings that hold double quotes."""
    return _reload(table(spark, sf, "events"), "events", "event_id", SHORT)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def load_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Strings that run over many lines and blocks."""
    return _reload(table(spark, sf, "documents"), "documents", "doc_id", LONG)


@query("SELECT page_id, url, html FROM pages")
def load_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _reload(table(spark, sf, "pages"), "pages", "page_id", LONG)


@query("SELECT conv_id, turn, role, text FROM conversations")
def load_conversations(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "conversations")
    keyed = conv.withColumn("ord", F.col("conv_id") * 10_000 + F.col("turn"))
    split = split_statements(table_lines(keyed, "conversations", "ord", 10_000 * LONG, columns=conv.columns))
    return load_rows(analyse_inserts(accepted(split.statements)), "conversations", conv.schema)


def _per_line(df: DataFrame, file: Column, key: str, text: Column) -> DataFrame:
    return df.select(file.alias("file"), F.col(key).cast("long").alias("ord"), text.alias("text"))


def _document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as one dump per language."""
    docs = table(spark, sf, "documents")
    text = F.concat(F.lit("INSERT INTO `documents` VALUES ("), F.col("doc_id").cast("string"), F.lit(", "), quote(F.col("text")), F.lit(");"))
    return statement_lines(_per_line(docs, F.concat("lang", F.lit(".sql")), "doc_id", text), LONG)


_DOC_TEXT = "'INSERT INTO `documents` VALUES (' || doc_id || ', ''' || replace(replace(text, '\\', '\\\\'), '''', '\\''') || ''')'"
_DOC_LINES = "(1 + length(text) - length(replace(text, chr(10), '')))"


@query(f"""
WITH d AS (SELECT lang || '.sql' AS file, doc_id, {_DOC_TEXT} AS body, {_DOC_LINES} AS n FROM documents)
SELECT file, CAST(sum(n) OVER (PARTITION BY file ORDER BY doc_id) - n + 1 AS BIGINT) AS first_line,
       CAST(sum(n) OVER (PARTITION BY file ORDER BY doc_id) AS BIGINT) AS last_line,
       CAST(n AS INTEGER) AS n_lines, CAST(octet_length(encode(body)) AS BIGINT) AS n_bytes, md5(body) AS text_md5
FROM d
""")
def statements_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Where each statement lies and exactly what it says."""
    got = split_statements(_document_lines(spark, sf)).statements
    return got.select("file", "first_line", "last_line", "n_lines", "n_bytes", F.md5("text").alias("text_md5"))


@query(f"""
WITH d AS (SELECT lang || '.sql' AS file, {_DOC_LINES} AS n FROM documents),
s AS (
  SELECT file, '' AS start_state, CASE WHEN n = 1 THEN '' ELSE '''' END AS end_state, n = 1 AS is_end, 1 AS k FROM d
  UNION ALL SELECT file, '''', '''', false, n - 2 FROM d WHERE n > 2
  UNION ALL SELECT file, '''', '', true, 1 FROM d WHERE n > 1)
SELECT file, start_state, end_state, is_end, CAST(sum(k) AS BIGINT) AS n_lines FROM s GROUP BY ALL
""")
def line_states(spark: SparkSession, sf: str) -> DataFrame:
    """Quote state before and after every physical line."""
    lines = scan(_document_lines(spark, sf)).lines()
    return lines.groupBy("file", "start_state", "end_state", "is_end").agg(F.count("*").alias("n_lines"))


_GUARD_BYTES = 20_000


@query(f"""
SELECT lang || '.sql' AS file, count(*) AS all_statements, count(*) FILTER (WHERE octet_length(encode({_DOC_TEXT})) + 2 > {_GUARD_BYTES}) AS over_size,
  CAST(sum(octet_length(encode({_DOC_TEXT}))) AS BIGINT) AS n_bytes
FROM documents GROUP BY lang
""")
def size_guards(spark: SparkSession, sf: str) -> DataFrame:
    """A byte limit labels the statements over it; all of them survive whole."""
    got = split_statements(_document_lines(spark, sf), max_bytes=_GUARD_BYTES).statements
    return got.groupBy("file").agg(F.count("*").alias("all_statements"), F.count("error").alias("over_size"), F.sum("n_bytes").alias("n_bytes"))


_SESSION_LINES = 300


@query(f"""
WITH RECURSIVE d AS (SELECT lang || '.sql' AS file, doc_id, {_DOC_LINES} AS n FROM documents),
ends AS (SELECT file, CAST(sum(n) OVER (PARTITION BY file ORDER BY doc_id) AS BIGINT) AS line FROM d),
s(file, session, first_line, last_line) AS (
  SELECT file, CAST(1 AS BIGINT), CAST(1 AS BIGINT), coalesce(min(line) FILTER (WHERE line >= {_SESSION_LINES}), max(line)) FROM ends GROUP BY file
  UNION ALL
  SELECT s.file, s.session + 1, s.last_line + 1,
         (SELECT coalesce(min(line) FILTER (WHERE line >= s.last_line + {_SESSION_LINES}), max(line)) FROM ends e WHERE e.file = s.file)
  FROM s WHERE s.last_line < (SELECT max(line) FROM ends e WHERE e.file = s.file))
SELECT file, session, first_line, last_line, last_line - first_line + 1 AS n_lines FROM s
""")
def sessions_of_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Slices of 300 lines that never end inside a string."""
    lines = scan(_document_lines(spark, sf)).lines()
    return line_sessions(lines, _SESSION_LINES)


@query("""
SELECT 'customer.sql' AS file, c_custkey + 1 AS pos, '`customer`' AS "table", 'INSERT INTO `customer` VALUES' AS prefix,
  '(' || c_custkey || ', ''' || c_name || ''', ' || c_nationkey || ', ''' || c_mktsegment || ''')' AS "values",
  1 AS n_sets, false AS is_ignore, 'insert_single' AS kind, 'INSERT' AS keyword
FROM customer
""")
def insert_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Table, prefix and values of simple INSERTs."""
    customer = table(spark, sf, "customer").drop("c_acctbal")
    got = split_statements(table_lines(customer, "customer", "c_custkey", SHORT)).statements
    return analyse_inserts(got).select("file", "pos", "table", "prefix", "values", "n_sets", "is_ignore", "kind", "keyword")


def _mixed(key: Column) -> Column:
    k = key.cast("string")
    forms = [
        F.concat(F.lit("INSERT INTO Shop.`Orders` VALUES ("), k, F.lit(", 'x');")),
        F.concat(F.lit("insert into t (a, b) values ("), k, F.lit(",1),("), k, F.lit(",2);")),
        F.concat(F.lit("REPLACE INTO t VALUES ("), k, F.lit(");")),
        F.concat(F.lit("INSERT INTO t VALUES ("), k, F.lit(") ON DUPLICATE KEY UPDATE a = 1;")),
        F.concat(F.lit("INSERT INTO t\nSELECT * FROM u WHERE id = "), k, F.lit(";")),
        F.concat(F.lit("INSERT IGNORE t VALUES ("), k, F.lit("), ("), k, F.lit(");")),
        F.concat(F.lit("UPDATE t SET a = 'INSERT INTO t VALUES (1)' WHERE id = "), k, F.lit(";")),
        F.concat(F.lit("INSERT INTO t VALUES ('some),(data', "), k, F.lit(");")),
    ]
    out = forms[-1]
    for i, form in enumerate(forms[:-1]):
        out = F.when(key % 8 == i, form).otherwise(out)
    return out


@query("""
WITH k AS (SELECT o_orderkey % 8 AS m FROM orders)
SELECT CASE WHEN m IN (0, 5) THEN 'insert_single' WHEN m IN (1, 7) THEN 'insert_extended' ELSE 'other' END AS kind,
  CASE WHEN m = 2 THEN 'REPLACE' WHEN m = 6 THEN 'UPDATE' ELSE 'INSERT' END AS keyword,
  CASE WHEN m = 0 THEN 'shop.`orders`' WHEN m IN (1, 5, 7) THEN 't' END AS "table",
  CASE m WHEN 0 THEN 'INSERT INTO Shop.`Orders` VALUES' WHEN 1 THEN 'insert into t (a, b) VALUES'
         WHEN 5 THEN 'INSERT IGNORE t VALUES' WHEN 7 THEN 'INSERT INTO t VALUES' END AS prefix,
  CASE WHEN m IN (0, 5) THEN 1 WHEN m IN (1, 7) THEN 2 END AS n_sets,
  CASE WHEN m IN (0, 1, 5, 7) THEN m = 5 END AS is_ignore, count(*) AS n
FROM k GROUP BY ALL
""")
def insert_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Single, extended and complex INSERTs and other statements told apart."""
    orders = table(spark, sf, "orders")
    lines = statement_lines(_per_line(orders, F.lit("mixed.sql"), "o_orderkey", _mixed(F.col("o_orderkey"))), SHORT)
    got = analyse_inserts(split_statements(lines).statements)
    return got.groupBy("kind", "keyword", "table", "prefix", "n_sets", "is_ignore").agg(F.count("*").alias("n"))


@query("""
WITH k AS (SELECT o_orderkey % 8 AS m FROM orders)
SELECT CASE WHEN m = 2 THEN 'REPLACE' WHEN m = 6 THEN 'UPDATE' ELSE 'INSERT' END AS keyword,
  CASE WHEN m IN (0, 5) THEN 'insert_single' WHEN m IN (1, 7) THEN 'insert_extended' ELSE 'other' END AS kind,
  count(*) AS n_statements, CAST(sum(CASE WHEN m = 4 THEN 2 ELSE 1 END) AS BIGINT) AS n_lines
FROM k GROUP BY ALL
""")
def dry_run_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What a load would execute, by keyword and kind."""
    orders = table(spark, sf, "orders")
    lines = statement_lines(_per_line(orders, F.lit("mixed.sql"), "o_orderkey", _mixed(F.col("o_orderkey"))), SHORT)
    return statement_counts(accepted(split_statements(lines).statements)).select("keyword", "kind", "n_statements", "n_lines")


def _order_lines(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return table_lines(orders, "orders", "o_orderkey", SHORT)


_ORDER_VALUES = "'(' || o_orderkey || ', ' || o_custkey || ', ''' || o_orderstatus || ''', ''' || o_orderpriority || ''')'"


@query(f"""
WITH r AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS rn, {_ORDER_VALUES} AS v FROM orders)
SELECT (rn - 1) // 2000 * 2000 + 1 AS batch_start, count(*) AS n_rows,
  md5('INSERT INTO `orders` VALUES ' || string_agg(v, ', ' ORDER BY rn) || ';') AS text_md5
FROM r GROUP BY 1
""")
def batch_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of single-row INSERTs as multi-row INSERTs of 2000 rows."""
    done = optimise(_order_lines(spark, sf))
    return done.output.select("batch_start", "n_rows", F.md5("text").alias("text_md5"))


_CAP = BatchOptions(60, 2_000)


@query(f"""
WITH RECURSIVE r AS (
  SELECT row_number() OVER (ORDER BY c_custkey) AS rn,
    length('(' || c_custkey || ', ''' || c_name || ''', ''' || repeat(c_mktsegment, CAST(1 + c_custkey % 5 AS INTEGER)) || ''')') AS len FROM customer),
a AS (SELECT rn, len, CASE WHEN rn <= 100 THEN round(sum(len) OVER (ORDER BY rn) / rn) END AS av FROM r),
e AS (SELECT rn, len, greatest(1, least({_CAP.batch_size}, floor({_CAP.max_bytes} / (last_value(av IGNORE NULLS) OVER (ORDER BY rn) + 2)))) AS eff FROM a),
w(rn, batch_start, cnt, bytes) AS (
  SELECT rn, rn, 1, len + 2 FROM e WHERE rn = 1
  UNION ALL
  SELECT e.rn, CASE WHEN w.cnt >= e.eff OR w.bytes + e.len + 2 > {_CAP.max_bytes} THEN e.rn ELSE w.batch_start END,
    CASE WHEN w.cnt >= e.eff OR w.bytes + e.len + 2 > {_CAP.max_bytes} THEN 1 ELSE w.cnt + 1 END,
    CASE WHEN w.cnt >= e.eff OR w.bytes + e.len + 2 > {_CAP.max_bytes} THEN e.len + 2 ELSE w.bytes + e.len + 2 END
  FROM w JOIN e ON e.rn = w.rn + 1)
SELECT CAST(batch_start AS BIGINT) AS batch_start, count(*) AS n_rows FROM w GROUP BY batch_start
""")
def batch_byte_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Batches where the byte cap and the adaptive size decide."""
    customer = table(spark, sf, "customer")
    wide = F.expr("repeat(c_mktsegment, int(1 + c_custkey % 5))")
    rows = customer.select("c_custkey", "c_name", wide.alias("seg"))
    done = optimise(table_lines(rows, "customer", "c_custkey", SHORT), _CAP)
    return done.output.select("batch_start", "n_rows")


def _event_statements(spark: SparkSession, sf: str) -> DataFrame:
    """Events as INSERTs into a table per type; errors as UPDATEs in between."""
    events = table(spark, sf, "events")
    key = F.col("event_id").cast("string")
    insert = F.concat(F.lit("INSERT INTO `"), "event_type", F.lit("` VALUES ("), key, F.lit(", "), F.col("user_id").cast("string"), F.lit(");"))
    update = F.concat(F.lit("UPDATE `users` SET `bad` = 1 WHERE `id` = "), F.col("user_id").cast("string"), F.lit(";"))
    text = F.when(F.col("event_type") == "error", update).otherwise(insert)
    return statement_lines(_per_line(events, F.lit("events.sql"), "event_id", text), SHORT)


_EVENT_RUNS = """
WITH s AS (SELECT row_number() OVER (ORDER BY event_id) AS rn, event_type, event_id, user_id, event_type = 'error' AS other FROM events),
m AS (SELECT *, CASE WHEN other OR event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY rn) THEN 1 ELSE 0 END AS opens FROM s),
g AS (SELECT *, sum(opens) OVER (ORDER BY rn) AS grp, max(CASE WHEN opens = 1 THEN rn END) OVER (ORDER BY rn) AS run FROM m),
b AS (SELECT *, run + (rn - run) // 3 * 3 AS batch_start FROM g)
"""


@query(_EVENT_RUNS + """
SELECT run AS run_start, '`' || any_value(event_type) || '`' AS "table", count(*) AS n_rows FROM g WHERE NOT other GROUP BY run
""")
def runs_by_table(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of consecutive INSERTs with one prefix, other statements in between."""
    done = optimise(_event_statements(spark, sf), BatchOptions(3))
    runs = done.batched.filter("run_start is not null")
    return runs.groupBy("run_start").agg(F.first("table").alias("table"), F.count("*").alias("n_rows"))


@query(_EVENT_RUNS + """
SELECT batch_start, CASE WHEN NOT any_value(other) THEN count(*) END AS n_rows,
  CASE WHEN any_value(other) THEN 'UPDATE `users` SET `bad` = 1 WHERE `id` = ' || any_value(user_id)
  ELSE 'INSERT INTO `' || any_value(event_type) || '` VALUES ' || string_agg('(' || event_id || ', ' || user_id || ')', ', ' ORDER BY rn) || ';' END AS text,
  CAST((row_number() OVER (ORDER BY batch_start) - 1) // 4 AS BIGINT) AS commit_group
FROM b GROUP BY batch_start
""")
def batched_output(spark: SparkSession, sf: str) -> DataFrame:
    """Batches and passed-through statements merged in order, in commit groups of four."""
    done = optimise(_event_statements(spark, sf), BatchOptions(3))
    return commit_groups(done.output, 4).select("batch_start", "n_rows", "text", "commit_group")


@query(_EVENT_RUNS + """,
c AS (SELECT count(*) FILTER (WHERE NOT other) AS r, count(DISTINCT batch_start) FILTER (WHERE NOT other) AS q,
  sum(length('(' || event_id || ', ' || user_id || ')')) FILTER (WHERE NOT other) AS bytes FROM b),
f AS (SELECT length('(' || event_id || ', ' || user_id || ')') AS len FROM s WHERE NOT other ORDER BY rn LIMIT 100)
SELECT 'events.sql' AS file, 3 AS batch_size, CAST(16777216 AS BIGINT) AS max_batch_bytes, r AS rows_batched, q AS queries_executed,
  CAST(bytes AS BIGINT) AS bytes_processed, round(r / q, 1) AS reduction_ratio, round(least(0.99, 1 - q / r), 3) AS batch_efficiency,
  CAST((SELECT round(avg(len)) FROM f) AS INTEGER) AS avg_row_size, 3 AS effective_batch_size, CAST(0 AS BIGINT) AS extended_insert_count
FROM c
""")
def batch_statistics(spark: SparkSession, sf: str) -> DataFrame:
    done = optimise(_event_statements(spark, sf), BatchOptions(3))
    return batch_stats(done.output, done.per_file, done.options)


@query(_EVENT_RUNS + """,
o AS (SELECT batch_start, any_value(other) AS other, CASE WHEN any_value(other) THEN length('UPDATE `users` SET `bad` = 1 WHERE `id` = ' || any_value(user_id)) + 2
  ELSE length('INSERT INTO `' || any_value(event_type) || '` VALUES ' || string_agg('(' || event_id || ', ' || user_id || ')', ', ') || ';') + 1 END AS size
  FROM b GROUP BY batch_start)
SELECT 'events.sql' AS file, (SELECT count(*) FROM events) AS lines_processed, count(*) AS queries_written, CAST(sum(size) AS BIGINT) AS output_size,
  (SELECT count(*) FROM s WHERE NOT other) AS inserts_batched, count(*) FILTER (WHERE NOT other) AS batched_queries_executed,
  round((SELECT count(*) FROM s WHERE NOT other) / count(*) FILTER (WHERE NOT other), 1) AS reduction_ratio, CAST(0 AS BIGINT) AS extended_insert_count
FROM o
""")
def optimiser_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and sizes of a whole optimiser run."""
    return optimise(_event_statements(spark, sf), BatchOptions(3)).statistics()


@query("""
SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1
""")
def ignore_keeps_first(spark: SparkSession, sf: str) -> DataFrame:
    """INSERT IGNORE: of the rows with one key the first is stored."""
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    split = split_statements(table_lines(events, "last_seen", "event_id", SHORT, ignore=True))
    rows = load_rows(analyse_inserts(accepted(split.statements)), "last_seen", events.schema, keep=("pos", "item"))
    return first_per_key(rows, ["user_id"], ["pos", "item"]).drop("pos", "item")


def _ddl(df: DataFrame, file: Column, key: str, name: Column) -> DataFrame:
    """A DROP and a CREATE TABLE per row."""
    text = F.concat(
        F.lit("DROP TABLE IF EXISTS `old_"), name, F.lit("`;\nCREATE TABLE IF NOT EXISTS `"), name,
        F.lit("` (\n  `id` INT UNSIGNED NOT NULL AUTO_INCREMENT,\n  `price` DECIMAL(10,2) DEFAULT '0.00' COMMENT 'a, b (c)',\n"
              "  `order note` TEXT,\n  PRIMARY KEY (`id`),\n  KEY `k` (`price`)\n) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;"))
    return statement_lines(_per_line(df, file, key, text), LONG)


@query("""
WITH d AS (SELECT lang || '.sql' AS file, source AS table_name, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
SELECT file, table_name, CAST(min(rn - 1) * 8 + 2 AS BIGINT) AS first_pos FROM d GROUP BY file, table_name
""")
def created_table_names(spark: SparkSession, sf: str) -> DataFrame:
    """Tables each dump creates, once each, with the line they first appear on."""
    docs = table(spark, sf, "documents")
    return created_tables(split_statements(_ddl(docs, F.concat("lang", F.lit(".sql")), "doc_id", F.col("source"))).statements)


@query("""
WITH d AS (SELECT lang || '.sql' AS file, source AS table_name, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
SELECT file, table_name, CAST(min(rn - 1) * 6 + 2 AS BIGINT) AS first_pos FROM d GROUP BY file, table_name
""")
def created_table_names_raw(spark: SparkSession, sf: str) -> DataFrame:
    """The same by text alone, with names on lines of their own."""
    docs = table(spark, sf, "documents")
    text = F.concat(F.lit("-- next\nCREATE TABLE\n\n  `"), F.col("source"), F.lit("`\n(\n`id` INT);"))
    return created_tables_raw(statement_lines(_per_line(docs, F.concat("lang", F.lit(".sql")), "doc_id", text), LONG))


@query("""
WITH w AS (SELECT DISTINCT lang || '.sql' AS file, upper(source) AS table_name FROM documents WHERE doc_id % 2 = 0
           UNION SELECT DISTINCT lang || '.sql', 'none_' || source FROM documents)
SELECT file, table_name FROM w WHERE table_name NOT LIKE 'none%'
""")
def dumps_that_create(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted tables that the dump itself creates."""
    docs = table(spark, sf, "documents")
    file = F.concat("lang", F.lit(".sql")).alias("file")
    created = created_tables(split_statements(_ddl(docs, file, "doc_id", F.col("source"))).statements)
    even = docs.filter("doc_id % 2 = 0").select(file, F.upper("source").alias("table_name"))
    none = docs.select(file, F.concat(F.lit("none_"), "source").alias("table_name"))
    return has_create_table(even.union(none).distinct(), created)


@query("""
WITH t AS (SELECT 'ddl.sql' AS file, 's_' || s_suppkey AS "table" FROM supplier),
c AS (SELECT * FROM (VALUES (0, 'id', 'int', '', true, true), (1, 'price', 'decimal', '(10,2)', false, false), (2, 'order note', 'text', '', false, false))
      v(ordinal, "column", type, arguments, unsigned, is_key))
SELECT file, "table", ordinal, "column", type, arguments, unsigned, is_key FROM t, c
""")
def declared_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns, types and keys that CREATE TABLE statements declare."""
    supplier = table(spark, sf, "supplier")
    name = F.concat(F.lit("s_"), F.col("s_suppkey").cast("string"))
    return table_columns(split_statements(_ddl(supplier, F.lit("ddl.sql"), "s_suppkey", name)).statements).drop("pos")


def _csv_lines(df: DataFrame, file: str, key: str, fields: list[Column]) -> DataFrame:
    return statement_lines(_per_line(df, F.lit(file), key, F.concat_ws(",", *fields)), SHORT)


def _enclosed(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


@query("SELECT event_id, user_id, event_type, props FROM events")
def csv_rows_events(spark: SparkSession, sf: str) -> DataFrame:
    """CSV with enclosed fields and doubled enclosures to typed rows."""
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "props")
    fields = [F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type"), _enclosed(F.col("props"))]
    return csv_rows(csv_records(_csv_lines(events, "events.csv", "event_id", fields)), events.schema)


@query(r"""
SELECT p_partkey + 1 AS pos, 'INSERT INTO `part` VALUES (''' || p_partkey || ''',''' || p_name || ', \"big\"'',''' || p_brand || ''','''')' AS text
FROM part
""")
def csv_insert_text(spark: SparkSession, sf: str) -> DataFrame:
    """CSV records as INSERT statements, quoted and with slashes."""
    part = table(spark, sf, "part")
    fields = [F.col("p_partkey").cast("string"), _enclosed(F.concat("p_name", F.lit(', "big"'))), F.col("p_brand"), F.lit("")]
    records = csv_records(_csv_lines(part, "part.csv", "p_partkey", fields))
    return csv_inserts(records, "part").select("pos", "text")


@query("""
WITH r AS (SELECT row_number() OVER (ORDER BY p_partkey) AS rn, '(''' || p_partkey || ''',''' || p_name || ''')' AS v FROM part)
SELECT (rn - 1) // 500 * 500 + 1 AS batch_start, count(*) AS n_rows, md5('INSERT INTO `part` VALUES ' || string_agg(v, ', ' ORDER BY rn) || ';') AS text_md5
FROM r GROUP BY 1
""")
def csv_to_dump(spark: SparkSession, sf: str) -> DataFrame:
    """CSV lines as a dump of multi-row INSERTs."""
    part = table(spark, sf, "part")
    done = csv_dump(_csv_lines(part, "part.csv", "p_partkey", [F.col("p_partkey").cast("string"), F.col("p_name")]), "part", batches=BatchOptions(500))
    return done.output.select("batch_start", "n_rows", F.md5("text").alias("text_md5"))


@query("SELECT p_partkey + 2 * (p_partkey + 1) + 1 AS line_no, p_name AS name FROM part")
def csv_line_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Blank and comment lines are no records; numbers count all lines."""
    part = table(spark, sf, "part")
    text = F.concat(F.lit("# note\n  \n"), F.col("p_name"), F.lit(";"), F.col("p_brand"))
    records = csv_records(statement_lines(_per_line(part, F.lit("p.csv"), "p_partkey", text), SHORT))
    return records.select("line_no", F.split(F.col("fields")[0], ";")[0].alias("name"))


@query(r"SELECT p_name AS name, regexp_full_match(p_name, '[A-Za-z0-9_$]+') AS valid, count(*) AS n FROM part GROUP BY ALL")
def csv_table_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_name").alias("name"), valid_table_name(F.col("p_name")).alias("valid")).groupBy(
        "name", "valid").agg(F.count("*").alias("n"))


@query(f"""
WITH l AS (SELECT o_orderstatus || '.sql' AS file, length({_ORDER_VALUES}) + 30 + CASE WHEN o_orderstatus = 'F' THEN 6 ELSE 0 END AS size FROM orders),
p AS (SELECT file, CAST(sum(size) AS BIGINT) AS total, count(*) AS n FROM l GROUP BY file)
SELECT file, total AS file_size, CASE WHEN total < 10485760 THEN 'tiny' WHEN total < 52428800 THEN 'small' WHEN total < 524288000 THEN 'medium'
    WHEN total < 2147483648 THEN 'large' ELSE 'massive' END AS category,
  n AS estimated_lines, round(total / n, 6) AS avg_bytes_per_line, file = 'F.sql' AS is_bulk_insert
FROM p
""")
def file_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Size class, line count and bulk flag of each dump."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    values = values_text(orders, orders.columns)
    more = F.when(F.col("o_orderstatus") == "F", F.lit(", (NL)")).otherwise(F.lit(""))
    text = F.concat(F.lit("INSERT INTO `orders` VALUES "), values, more, F.lit(";"))
    lines = statement_lines(_per_line(orders, F.concat("o_orderstatus", F.lit(".sql")), "o_orderkey", text), SHORT)
    got = profile_files(lines)
    return got.select("file", "file_size", "category", "estimated_lines", F.round("avg_bytes_per_line", 6).alias("avg_bytes_per_line"), "is_bulk_insert")


@query("""
WITH d AS (SELECT lang || '.sql' AS file, unnest(string_split(text, chr(10))) AS value, doc_id FROM documents)
SELECT file, count(*) AS total_lines FROM d GROUP BY file
""")
def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_lines(_document_lines(spark, sf))


_PREVIEW = """
WITH s AS (SELECT c_nationkey || '.sql' AS file, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn, c_name FROM customer),
l AS (SELECT file, (rn - 1) * 3 + 1 AS line_no, '-- customer ' || c_name AS value, rn FROM s
      UNION ALL SELECT file, (rn - 1) * 3 + 2, 'INSERT INTO c', rn FROM s
      UNION ALL SELECT file, (rn - 1) * 3 + 3, 'VALUES (''' || c_name || ''');', rn FROM s)
"""


def _preview_source(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    text = F.concat(F.lit("-- customer "), "c_name", F.lit("\nINSERT INTO c\nVALUES ('"), "c_name", F.lit("');"))
    file = F.concat(F.col("c_nationkey").cast("string"), F.lit(".sql"))
    return statement_lines(_per_line(customer, file, "c_custkey", text), SHORT)


@query(_PREVIEW + "SELECT file, line_no, value FROM l WHERE line_no <= 50")
def first_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 lines of every dump."""
    return preview_lines(_preview_source(spark, sf))


@query(_PREVIEW + """
SELECT file, CAST(rn AS INTEGER) AS query_no, 'INSERT INTO c' || chr(10) || 'VALUES (''' || c_name || ''');' AS query FROM s WHERE rn <= 10 AND rn * 3 <= 50
""")
def first_statements(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten statements in the preview of every dump."""
    return preview_statements(preview_lines(_preview_source(spark, sf))).withColumn("query_no", F.col("query_no").cast("int"))


def _customer_files(spark: SparkSession, sf: str, text: Column) -> DataFrame:
    """One small dump per customer."""
    customer = table(spark, sf, "customer")
    return statement_lines(_per_line(customer, F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".sql")), "c_custkey", text), SHORT)


@query("""
SELECT 'c' || c_custkey || '.sql' AS file, 'SELECT ''' || c_name || '''' AS text, false AS is_tail FROM customer
UNION ALL SELECT 'c' || c_custkey || '.sql', CASE c_custkey % 4 WHEN 0 THEN 'insert into t values (' WHEN 1 THEN '/*!40101 SET x */' ELSE 'Commit' END || c_custkey, true
FROM customer WHERE c_custkey % 4 < 3
""")
def undelimited_tails(spark: SparkSession, sf: str) -> DataFrame:
    """Text after the last delimiter is kept if it starts like SQL."""
    k = F.col("c_custkey")
    tail = F.when(k % 4 == 0, "insert into t values (").when(k % 4 == 1, "/*!40101 SET x */").when(k % 4 == 2, "Commit").otherwise("(1, 2), (3")
    text = F.concat(F.lit("SELECT '"), "c_name", F.lit("';\n"), tail, k.cast("string"))
    return accepted(split_statements(_customer_files(spark, sf, text)).statements).select("file", "text", "is_tail")


@query("""
SELECT 'c' || c_custkey || '.sql' AS file, CAST(2 AS BIGINT) AS n_lines,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_statements, CAST(0 AS BIGINT) AS n_errors, c_custkey % 3 <> 0 AS has_tail,
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '''' ELSE '"' END AS end_state,
  CASE WHEN c_custkey % 3 > 0 THEN 'End of file reached with unclosed string. The dump file may be corrupted or truncated.' END AS problem
FROM customer
""")
def truncated_dumps(spark: SparkSession, sf: str) -> DataFrame:
    """Per file: counts, and whether it ends inside a string."""
    k = F.col("c_custkey")
    second = F.when(k % 3 == 0, F.lit("SELECT 2;")).when(k % 3 == 1, F.lit("it's;\nSELECT 2;")).otherwise(F.lit('say "x;\nSELECT 2;'))
    text = F.when(k % 3 == 0, F.concat(F.lit("SELECT 1;\n"), second)).otherwise(second)
    return quality(split_statements(_customer_files(spark, sf, text)))


@query("""
SELECT 'c' || c_custkey || '.sql' AS file, unnest([
  'CREATE PROCEDURE p' || c_custkey || '()' || chr(10) || 'BEGIN' || chr(10) || '  SELECT ''DELIMITER ;'';' || chr(10) || 'END',
  'SELECT ''' || c_name || '''']) AS text FROM customer
""")
def delimiter_changes(spark: SparkSession, sf: str) -> DataFrame:
    """DELIMITER lines hold for what follows, not inside strings."""
    text = F.concat(
        F.lit("DELIMITER //\nCREATE PROCEDURE p"), F.col("c_custkey").cast("string"),
        F.lit("()\nBEGIN\n  SELECT 'DELIMITER ;';\nEND//\ndelimiter ;\nSELECT '"), "c_name", F.lit("';"))
    return split_statements(_customer_files(spark, sf, text)).statements.select("file", "text")


_COMMENTED = """
SELECT dialect, 'c' || c_custkey || '.sql' AS file,
  CASE dialect WHEN 'import' THEN '' ELSE '--' || chr(10) END || 'ALTER TABLE t' || chr(10) || '  ADD c ''# no' || chr(10) || '-- comment' || chr(10) || c_name || '''' AS text
FROM customer, (VALUES ('import'), ('cli')) v(dialect)
"""


@query(_COMMENTED)
def comment_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Comment lines go, in both dialects; the same text inside strings stays."""
    text = F.concat(F.lit("--\n-- head\n# note\n\nALTER TABLE t\n  -- inner\n  ADD c '# no\n-- comment\n"), "c_name", F.lit("';"))
    lines = _customer_files(spark, sf, text)
    parts = [
        split_statements(lines, ScanOptions(d)).statements.select(F.lit(d).alias("dialect"), "file", "text") for d in ("import", "cli")
    ]
    return parts[0].unionByName(parts[1])


def _dump_files(spark: SparkSession, df: DataFrame, name: str, key: str, compression: str) -> str:
    """Write a table as dump files to the shared folder; give the folder."""
    path = stage_path(spark, f"dump-{name}")
    write_dump(df.select(F.lit(name).alias("file"), F.col(key).cast("long").alias("pos"), insert_text(df, name).alias("text")), path, compression)
    return path


def _from_files(spark: SparkSession, sf: str, name: str, key: str, compression: str) -> DataFrame:
    df = table(spark, sf, name)
    split = split_statements(read_lines(spark, _dump_files(spark, df, name, key, compression)))
    return _text_columns(load_rows(analyse_inserts(accepted(split.statements)), name, df.schema))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders")
def plain_files(spark: SparkSession, sf: str) -> DataFrame:
    """Write dump files, read them back split by split, load the rows."""
    return _from_files(spark, sf, "orders", "o_orderkey", "none")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def gzip_files(spark: SparkSession, sf: str) -> DataFrame:
    return _from_files(spark, sf, "documents", "doc_id", "gzip")


@query("SELECT event_id, CAST(ts AS VARCHAR) AS ts, user_id, event_type, value, props FROM events")
def bzip2_files(spark: SparkSession, sf: str) -> DataFrame:
    return _from_files(spark, sf, "events", "event_id", "bzip2")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def optimised_files(spark: SparkSession, sf: str) -> DataFrame:
    """Dump, optimise, write, read the multi-row INSERTs back, load: the table again."""
    df = table(spark, sf, "customer")
    done = optimise(read_lines(spark, _dump_files(spark, df, "customer", "c_custkey", "none")), BatchOptions(100))
    path = stage_path(spark, "optimised")
    write_dump(stage(done.output, "output"), path, "bzip2")
    again = split_statements(read_lines(spark, path))
    return load_rows(analyse_inserts(accepted(again.statements)), "customer", df.schema)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def load_long_inserts(spark: SparkSession, sf: str) -> DataFrame:
    """INSERTs that run over more than 300 lines, one tuple a line."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    group = F.floor(F.col("l_orderkey") / 400)
    row = F.struct("l_orderkey", "l_linenumber", values_text(items, items.columns).alias("v"))
    per = items.groupBy(group.alias("ord")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    text = F.concat(F.lit("INSERT INTO `lineitem` VALUES\n"), F.array_join(F.transform("rows", lambda r: r["v"]), ",\n"), F.lit(";"))
    lines = statement_lines(_per_line(per, F.lit("lineitem.sql"), "ord", text), LONG)
    return load_rows(accepted(split_statements(lines).statements), "lineitem", items.schema)


_HOSTILE = " x SELECT y ON DUPLICATE KEY UPDATE a = VALUES (a)),(1); INSERT INTO t VALUES ("


@query(f"SELECT doc_id, '{_HOSTILE}' || text AS text FROM documents")
def load_hostile_text(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that hold the words of other statements."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit(_HOSTILE), "text").alias("text"))
    return _reload(docs, "documents", "doc_id", LONG)


def _order_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders inserted, every third replaced later, every fifth given again with ON DUPLICATE KEY UPDATE, every seventh ignored."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    key = F.col("o_orderkey").cast("string")
    ddl = "CREATE TABLE `my-orders$` (`order key` INT NOT NULL, `st` VARCHAR(9), PRIMARY KEY (`order key`));"
    first = F.concat(F.lit("INSERT INTO `my-orders$` (`order key`, `st`) VALUES ("), key, F.lit(", '"), "o_orderstatus", F.lit("');"))
    again = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("\nREPLACE INTO `my-orders$` VALUES ("), key, F.lit(", 'replaced');"))).otherwise("")
    more = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("\ninsert into `my-orders$` values ("), key, F.lit(", 'updated') on duplicate key update st = values(st);"))).otherwise("")
    late = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("\nINSERT IGNORE INTO `my-orders$` VALUES ("), key, F.lit(", 'ignored');"))).otherwise("")
    text = F.concat(F.when(F.col("o_orderkey") == orders.agg(F.min("o_orderkey")).first()[0], ddl + "\n").otherwise(""), first, again, more, late)
    return statement_lines(_per_line(orders, F.lit("orders.sql"), "o_orderkey", text), SHORT)


@query("""
SELECT o_orderkey AS "order key", CASE WHEN o_orderkey % 5 = 0 THEN 'updated' WHEN o_orderkey % 3 = 0 THEN 'replaced' ELSE o_orderstatus END AS st FROM orders
""")
def load_replace(spark: SparkSession, sf: str) -> DataFrame:
    """REPLACE, ON DUPLICATE KEY UPDATE and INSERT IGNORE in dump order, with a quoted table name and the dump's own schema."""
    got = load_table(split_statements(_order_changes(spark, sf)), "my-orders$")
    return got.select(F.col("order key").cast("long").alias("order key"), "st")


@query("SELECT 's_' || s_suppkey || '-$ x' AS name, s_suppkey AS n FROM supplier")
def load_named_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of tables with any quoted name, and calls nested five deep."""
    supplier = table(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("INSERT INTO `db`.`s_"), key, F.lit("-$ x` (`a b`, `c`) VALUES ("), key, F.lit(", A(B(C(D(E(1))))));"))
    tuples = insert_tuples(split_statements(statement_lines(_per_line(supplier, F.lit("s.sql"), "s_suppkey", text), SHORT)).statements)
    return tuples.filter(F.size("items") == 2).select(F.col("table").alias("name"), F.trim(F.col("items")[0]).cast("long").alias("n"))


@query("""
SELECT NULL AS id, event_type, event_id FROM events UNION ALL
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1
""")
def ignore_auto_increment(spark: SparkSession, sf: str) -> DataFrame:
    """INSERT IGNORE with a key that is null never gives way; with a key the first row stays."""
    events = table(spark, sf, "events")
    event, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    row = lambda k: F.concat(F.lit("INSERT IGNORE INTO t VALUES ("), k, F.lit(", '"), "event_type", F.lit("', "), event, F.lit(");"))
    ddl = F.lit("CREATE TABLE t (id BIGINT NOT NULL AUTO_INCREMENT PRIMARY KEY, event_type TEXT, event_id BIGINT);\n")
    text = F.concat(F.when(F.col("event_id") == events.agg(F.min("event_id")).first()[0], ddl).otherwise(""), row(F.lit("NULL")), F.lit("\n"), row(user))
    split = split_statements(statement_lines(_per_line(events, F.lit("t.sql"), "event_id", text), SHORT))
    return load_table(split, "t")


def _whole_dump(spark: SparkSession, sf: str) -> Loaded:
    """Customers by nation, one table each, some of them with values that do not fit."""
    customer = table(spark, sf, "customer")
    nation, key = F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")
    first = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) == 1
    ddl = F.concat(F.lit("CREATE TABLE n_"), nation, F.lit(" (id INT, name TEXT, day DATE);\n"))
    values = F.when(F.col("c_custkey") % 4 == 0, F.concat(key, F.lit(", 'zero', '0000-00-00'"))).when(
        F.col("c_custkey") % 4 == 1, F.concat(key, F.lit(", 'short'"))).otherwise(F.concat(key, F.lit(", 'fine', '2024-01-02'")))
    text = F.concat(F.when(first, ddl).otherwise(""), F.lit("INSERT INTO n_"), nation, F.lit(" VALUES ("), values, F.lit(");"))
    text = F.when(F.col("c_custkey") % 10 == 3, F.concat(text, F.lit("\nINSERT INTO n_0 SELECT 1;"))).otherwise(text)
    return load_dump(split_statements(statement_lines(_per_line(customer, F.lit("all.sql"), "c_custkey", text), SHORT)))


@query("""
SELECT 'n_' || c_nationkey AS name, count(*) FILTER (WHERE c_custkey % 4 <> 1) AS n, CAST(sum(c_custkey) FILTER (WHERE c_custkey % 4 <> 1) AS BIGINT) AS ids,
  count(*) FILTER (WHERE c_custkey % 4 > 1) AS days FROM customer GROUP BY c_nationkey
""")
def load_whole_dump(spark: SparkSession, sf: str) -> DataFrame:
    """All tables of a dump, each with its own schema."""
    frames = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("id").alias("ids"), F.count("day").alias("days"))
              for name, df in _whole_dump(spark, sf).tables.items()]
    return reduce(DataFrame.unionAll, frames)


@query("""
SELECT 'n_' || c_nationkey AS "table", CASE c_custkey % 4 WHEN 0 THEN 'day' END AS "column",
  CASE c_custkey % 4 WHEN 0 THEN 'no date' ELSE '2 values for 3 columns' END AS reason, count(*) AS n
FROM customer WHERE c_custkey % 4 < 2 GROUP BY ALL
UNION ALL SELECT NULL, NULL, 'no VALUES list', count(*) FROM customer WHERE c_custkey % 10 = 3 HAVING count(*) > 0
""")
def load_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """What a load of a whole dump could not store as it stands."""
    return _whole_dump(spark, sf).rejects.groupBy("table", "column", "reason").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, o_orderstatus || repeat(' (it''s),', CAST(o_orderkey % 3 AS INTEGER)) AS st, CAST(o_totalprice AS DOUBLE) AS price FROM orders
""")
def load_huge_insert(spark: SparkSession, sf: str) -> DataFrame:
    """All orders in one INSERT that comes in very many parts, with strings and calls over the borders of parts and splits."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey").cast("string")
    status = F.concat("o_orderstatus", F.repeat(F.lit(" (it\\'s),"), (F.col("o_orderkey") % 3).cast("int")))
    row = F.concat(F.lit("("), key, F.lit(",\n'"), status, F.lit("', "), F.col("o_totalprice").cast("string"), F.lit(", f(g((((1, ')'))))))"))
    least, most = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    text = F.concat(F.when(F.col("o_orderkey") == least, "INSERT INTO `orders` (k, st, price, c) VALUES\n").otherwise(""), row,
                    F.when(F.col("o_orderkey") == most, ";").otherwise(","))
    split = split_statements(statement_lines(_per_line(orders, F.lit("huge.sql"), "o_orderkey", text), SHORT), row_bytes=1 << 16)
    schema = T.StructType().add("k", "long").add("st", "string").add("price", "double").add("c", "string")
    return load_rows(accepted(split.statements), "orders", schema).filter(F.trim("c") == "f(g((((1, ')')))))").select(
        F.col("k").alias("o_orderkey"), "st", "price")


def _data_only(spark: SparkSession, sf: str) -> Loaded:
    """Suppliers as a dump without any CREATE TABLE: with and without column lists, and rows that do not fit them."""
    supplier = table(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    named = F.concat(F.lit("INSERT INTO named (id, name) VALUES ("), key, F.lit(", '"), "s_name", F.lit("');\nINSERT INTO named (nation, id) VALUES ("),
                     F.col("s_nationkey").cast("string"), F.lit(", "), key, F.lit(");"))
    bare = F.concat(F.lit("\nINSERT INTO bare VALUES ("), key, F.lit(", NULL), ('"), "s_name", F.lit("', 2);"))
    more = F.when(F.col("s_suppkey") % 3 == 0, F.lit("\nINSERT INTO named (id) VALUES (1, 2);")).otherwise("")
    return load_dump(split_statements(statement_lines(_per_line(supplier, F.lit("data.sql"), "s_suppkey", F.concat(named, bare, more)), SHORT)))


@query("""
SELECT 'named' AS name, CAST(s_suppkey AS VARCHAR) AS a, s_name AS b, NULL AS c FROM supplier
UNION ALL SELECT 'named', CAST(s_suppkey AS VARCHAR), NULL, CAST(s_nationkey AS VARCHAR) FROM supplier
UNION ALL SELECT 'bare', CAST(s_suppkey AS VARCHAR), NULL, NULL FROM supplier UNION ALL SELECT 'bare', s_name, '2', NULL FROM supplier
""")
def load_without_ddl(spark: SparkSession, sf: str) -> DataFrame:
    """Tables a dump fills but does not create, as text: columns named by the statements, or numbered."""
    tables = _data_only(spark, sf).tables
    named, bare = tables["named"], tables["bare"]
    return named.select(F.lit("named").alias("name"), F.col("id").alias("a"), F.col("name").alias("b"), F.col("nation").alias("c")).union(
        bare.select(F.lit("bare"), "col_1", "col_2", F.lit(None).cast("string")))


@query("""
SELECT 't' AS "table", 'nope' AS "column", 'no such column' AS reason, count(*) AS n FROM supplier WHERE s_suppkey % 2 = 0 HAVING count(*) > 0
UNION ALL SELECT 't', 'id', 'no int', count(*) FROM supplier WHERE s_suppkey % 2 = 1 HAVING count(*) > 0
UNION ALL SELECT 'u', NULL, '1 values for 2 columns', count(*) FROM supplier WHERE s_suppkey % 5 = 1 HAVING count(*) > 0
""")
def load_unknown_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns a table does not have, values it cannot take, and rows that do not fit a table without CREATE TABLE."""
    supplier = table(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    ddl = F.when(F.col("s_suppkey") == supplier.agg(F.min("s_suppkey")).first()[0], "CREATE TABLE t (id INT, name TEXT);\n").otherwise("")
    row = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("INSERT INTO t (id, nope) VALUES ("), key, F.lit(", 'x');"))).otherwise(
        F.concat(F.lit("INSERT INTO t VALUES ('k"), key, F.lit("', 'x');")))
    other = F.when(F.col("s_suppkey") % 5 == 1, F.lit("\nINSERT INTO u (a, b) VALUES (1);")).otherwise(F.lit("\nINSERT INTO u (a, b) VALUES (1, 2);"))
    split = split_statements(statement_lines(_per_line(supplier, F.lit("t.sql"), "s_suppkey", F.concat(ddl, row, other)), SHORT))
    return load_dump(split).rejects.groupBy("table", "column", "reason").agg(F.count("*").alias("n"))


@query("""
SELECT c_nationkey || '.sql' AS file, c_nationkey % 2 = 0 AS is_bulk_insert, CAST(2 * count(*) + 2 AS BIGINT) AS n_lines FROM customer GROUP BY c_nationkey
""")
def bulk_inserts_over_many_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One INSERT a nation whose first tuple runs over all its lines, in bytes that are no UTF-8; only every other one has a second tuple."""
    customer = table(spark, sf, "customer")
    file = F.concat(F.col("c_nationkey").cast("string"), F.lit(".sql"))
    ends = customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"))
    rows = customer.join(F.broadcast(ends), "c_nationkey")
    body = F.concat(F.col("c_name").cast("binary"), F.lit(bytearray(b" \xe9\n\xff ")), F.col("c_name").cast("binary")).cast("string")
    after = F.when(F.col("c_nationkey") % 2 == 0, "\n'), (2);").otherwise("\n');")
    text = F.concat(F.when(F.col("c_custkey") == F.col("lo"), "INSERT INTO t VALUES ('\n").otherwise(""), body, F.when(F.col("c_custkey") == F.col("hi"), after).otherwise(""))
    lines = statement_lines(_per_line(rows, file, "c_custkey", text), SHORT)
    return profile_files(lines).select("file", "is_bulk_insert", F.col("estimated_lines").alias("n_lines"))
