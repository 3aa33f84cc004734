"""Registered queries for rules that others only pass by: newlines, marks, long messages, history on disk, advice from real dumps."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as h
from ..operators.diagnose import advise, error_message
from ..operators.profile import created_tables, created_tables_raw
from ..operators.progress import progress
from ..operators.statements import split_statements
from ..session import stage_path
from ..snapshots import Table, change, publish, published
from ..sources.render import statement_lines
from ..streaming.ingest import CHUNKS, ProgressLog, observed, split_stream, stream_log
from .dump_queries import SHORT, _customer_files, _ddl, _per_line, _whole_dump
from .jobs import REJECTS, publish_dump
from .log_queries import _chunk_source, _chunks, _error, _history
from .registry import ORACLE, query, table


@query("""
SELECT 'SELECT ''' || p_name || chr(10) || p_brand || chr(10) || chr(10) || p_type || chr(10) || '''' AS text, count(*) AS n, CAST(3 AS BIGINT) AS n_lines FROM part GROUP BY ALL
""")
def newline_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """CR, CRLF and LF become LF inside a statement; only LF ends a physical line."""
    part = table(spark, sf, "part")
    text = F.concat(F.lit("SELECT '"), "p_name", F.lit("\r\n"), "p_brand", F.lit("\r\r\n"), "p_type", F.lit("\r';\r"))
    split = split_statements(statement_lines(_per_line(part, F.lit("p.sql"), "p_partkey", text), SHORT))
    return split.statements.groupBy("text", F.col("n_lines").cast("long").alias("n_lines")).agg(F.count("*").alias("n"))


@query("SELECT 'c' || c_custkey || '.sql' AS file, 'SELECT ''' || c_name || '''' AS text FROM customer")
def byte_order_marks(spark: SparkSession, sf: str) -> DataFrame:
    """A mark at the start of a file goes, and the line behind it is read as it stands."""
    customer_text = F.concat(F.lit("\ufeffSELECT '"), "c_name", F.lit("';"))
    return split_statements(_customer_files(spark, sf, customer_text)).statements.select("file", "text")


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(html, '[^\x00-\x7F]', '?', 'g') AS q FROM pages)
SELECT page_id, 'SQL Error at line 7:' || chr(10) || 'Query: ' || CASE WHEN length(q) > 500 THEN q[1:500] || '...' ELSE q END || chr(10) || 'MySQL Error: gone' AS message FROM p
""")
def long_error_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of statements that are longer than what is shown of them."""
    statement = F.regexp_replace("html", r"[^\x00-\x7F]", "?")
    return table(spark, sf, "pages").select("page_id", error_message(F.lit(7), statement, F.lit("gone")).alias("message"))


@query(ORACLE["error_advice"])
def error_advice_of_dumps(spark: SparkSession, sf: str) -> DataFrame:
    """Failed loads joined to the tables that the statements of their dumps create."""
    docs = table(spark, sf, "documents")
    file = F.concat("lang", F.lit(".sql"))
    created = created_tables(split_statements(_ddl(docs.filter("doc_id % 2 = 0"), file, "doc_id", F.col("source"))).statements)
    failed = docs.select(F.col("doc_id").cast("string").alias("id"), file.alias("filename"),
                         _error(F.col("doc_id") % 5, F.col("source"), F.col("doc_id")).alias("error"))
    return advise(failed, created).select("id", "filename", "table_name", "error_kind", "has_create_table", "action")


def _kept_history(spark: SparkSession, sf: str) -> str:
    """The history written in two appends."""
    path, rows = stage_path(spark, "history"), _history(spark, sf)
    h.append_history(rows.filter(F.crc32("id") % 2 == 0), path)
    h.append_history(rows.filter(F.crc32("id") % 2 == 1), path)
    return path


@query(ORACLE["history_summary"])
def history_appended(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of a history that was appended to on disk and read back."""
    return h.summary(h.read_history(spark, _kept_history(spark, sf)))


@query(ORACLE["history_without"])
def history_deleted_on_disk(spark: SparkSession, sf: str) -> DataFrame:
    """An entry deleted from a history on disk; deleting it again finds nothing."""
    path = _kept_history(spark, sf)
    found = [h.delete_entry(spark, path, "imp_5"), h.delete_entry(spark, path, "imp_5")]
    return h.read_history(spark, path).select("id", "success").filter(F.lit(found == [True, False]))


@query("SELECT CAST(0 AS BIGINT) AS total_imports, CAST(0 AS BIGINT) AS total_queries, CAST(0 AS BIGINT) AS total_bytes, count(*) AS rows_before FROM events")
def history_cleared(spark: SparkSession, sf: str) -> DataFrame:
    """A history emptied on disk has a summary of zeros."""
    path = _kept_history(spark, sf)
    before = h.read_history(spark, path).count()
    h.clear_history(spark, path)
    return h.summary(h.read_history(spark, path)).select("total_imports", "total_queries", "total_bytes", F.lit(before).cast("long").alias("rows_before"))


@query("""
WITH e AS (SELECT 'imp_' || event_id AS id, event_id FROM events), top AS (SELECT id FROM e WHERE event_id <> 5 ORDER BY event_id DESC LIMIT 1)
SELECT id, false AS late FROM e WHERE event_id NOT IN (5, 6) UNION ALL SELECT 'late_' || id, true FROM top
""")
def history_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A history after two appends, a delete, and a delete during which another writer appends: no change is lost."""
    path = _kept_history(spark, sf)
    h.delete_entry(spark, path, "imp_5")
    number = F.expr("cast(substring(id, 5) as bigint)")
    late = h.newest(h.read_history(spark, path).withColumn("ts", F.timestamp_seconds(number)), 1)
    late = late.withColumn("id", F.concat(F.lit("late_"), "id"))
    first: list[bool] = []

    def step(now, write):
        kept = write(h.without(now.read(spark, "history"), "imp_6"))
        if not first:
            first.append(True)
            h.append_history(late, path)
        return {"history": Table((kept,), h.SCHEMA, "json")}

    change(spark, path, step, fmt="json")
    return h.read_history(spark, path).select("id", F.col("id").startswith("late_").alias("late"))


@query(ORACLE["load_whole_dump"])
def publish_whole_dump(spark: SparkSession, sf: str) -> DataFrame:
    """All tables of a dump, published at once and read back from one version; a load before it that fails half way shows nothing."""
    base, loaded = stage_path(spark, "published"), _whole_dump(spark, sf)
    name, rows = next(iter(loaded.tables.items()))
    broken = loaded.tables | {name: rows.withColumn("id", F.raise_error(F.lit("write failed")).cast(rows.schema["id"].dataType))}
    try:
        publish(broken, base)
    except Exception as error:
        if "write failed" not in str(error) or published(spark, base):
            raise
    publish_dump(loaded, base)
    tables = published(spark, base)
    tables.pop(REJECTS)
    frames = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum("id").alias("ids"), F.count("day").alias("days")) for n, df in tables.items()]
    return reduce(DataFrame.unionAll, frames)


@query("""
WITH c AS (SELECT length('INSERT INTO `c` VALUES (' || c_custkey || ', ''it\\''s' || chr(10) || c_name || ';' || chr(10) || ''')') + 2 AS b FROM customer)
SELECT count(*) AS queries_done, count(*) AS queries_total, CAST(count(*) * 3 AS BIGINT) AS lines_done, CAST(sum(b) AS BIGINT) AS bytes_done,
  CAST(100 AS DOUBLE) AS pct_done, true AS each_once FROM c
""")
def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress over the log of a stream that fails between write and commit and goes on: its last row, and whether every batch is logged once."""
    source, failed = _chunks(spark, sf), []
    log, out, check = (stage_path(spark, n) for n in ("log", "streamed", "check"))
    sizes = spark.read.schema(CHUNKS).parquet(source).agg(F.sum(F.octet_length("data")).alias("size"), F.count_if("is_last").alias("dumps")).first()

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number and not failed:
            failed.append(number)
            raise InterruptedError("stopped after the write")

    def run() -> None:
        events = ProgressLog(spark, log, "chunked_dumps")
        job = observed(_chunk_source(spark, source), split_stream).writeStream.queryName("chunked_dumps").foreachBatch(keep)
        try:
            job.option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        finally:
            events.wait()

    try:
        run()
    except StreamingQueryException:
        run()
    rows = progress(stream_log(spark, log, sizes["size"], sizes["dumps"]))
    last = rows.agg(F.max("seq").alias("s"), F.count("*").alias("n"), F.count_distinct("run_id").alias("runs"))
    once = last.first()
    each_once = once.n == once.s + 1 and once.runs == 2
    return rows.filter("finished").select("queries_done", "queries_total", "lines_done", "bytes_done", "pct_done", F.lit(each_once).alias("each_once"))


@query("""
WITH f AS (SELECT 'c' || c_custkey || '.sql' AS file, c_name, c_custkey FROM customer)
SELECT file, CASE WHEN c_custkey % 2 = 0 THEN 'in_comment' ELSE 'real_' || c_custkey END AS table_name, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 3 END AS BIGINT) AS first_pos FROM f
""")
def created_tables_in_raw_text(spark: SparkSession, sf: str) -> DataFrame:
    """Raw text lists tables in comments too, and those whose statement runs over lines."""
    key = F.col("c_custkey").cast("string")
    text = F.when(F.col("c_custkey") % 2 == 0, F.lit("-- CREATE TABLE in_comment (id INT)\nSELECT 1;")).otherwise(
        F.concat(F.lit("SELECT 1;\n\nCREATE\nTABLE IF NOT\n EXISTS\n`real_"), key, F.lit("`\n\n(id INT);")))
    return created_tables_raw(_customer_files(spark, sf, text))
