"""Registered queries over load logs, histories, catalogues and streams made from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..functions.format import format_bytes, format_clock, format_duration, number_format
from ..functions.literals import quote
from ..operators import history as h
from ..operators import progress as p
from ..operators.diagnose import advise, error_message
from ..operators.profile import size_class
from ..session import stage_path
from ..sinks import write_dump
from ..sources.catalog import allowed_files, clean_name, describe_files, list_files, new_arrivals
from ..sources.lines import read_lines
from ..sources.render import insert_text
from ..streaming.ingest import ingest_dumps, live_statistics, split_stream
from .registry import query, table

_SIZE = 2_000_000


def _load_log(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a log of load slices, one import per customer."""
    orders = table(spark, sf, "orders")
    so_far = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)

    def total(c: str) -> Column:
        return F.sum(F.expr(c)).over(so_far).cast("long")

    log = orders.select(
        F.col("o_custkey").alias("import_id"), F.lit(0).cast("long").alias("run_id"), F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").alias("ts"), F.lit(_SIZE).cast("long").alias("file_size"),
        total("100 + o_orderkey % 50").alias("lines"), total("10 + o_orderkey % 7").alias("queries"),
        total("cast(floor(o_totalprice) as bigint)").alias("bytes"), (F.col("o_orderkey") * 7 % 100).cast("int").alias("memory_pct"),
        (F.col("o_custkey") % 10 == 0).alias("is_gzip"),
    )
    return log.withColumn("finished", F.col("bytes") >= _SIZE)


_LOG = f"""
WITH log AS (SELECT o_custkey AS import_id, o_orderkey AS seq, o_custkey % 10 = 0 AS is_gzip, {_SIZE} AS file_size,
  CAST(sum(100 + o_orderkey % 50) OVER w AS BIGINT) AS lines, CAST(sum(10 + o_orderkey % 7) OVER w AS BIGINT) AS queries,
  CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER w AS BIGINT) AS bytes
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
m AS (SELECT *, bytes >= file_size AS finished FROM log),
e AS (SELECT *, NOT is_gzip AND NOT finished AND bytes > 0 AS guess, ceil(file_size / (bytes / lines)) AS le, ceil(file_size / (bytes / queries)) AS qe FROM m),
f AS (SELECT *, first_value(CASE WHEN guess AND bytes / file_size * 100 >= 5 THEN le END IGNORE NULLS) OVER w AS lf,
  first_value(CASE WHEN guess AND bytes / file_size * 100 >= 5 THEN qe END IGNORE NULLS) OVER w AS qf,
  lines - first_value(lines) OVER w AS lines_this, bytes - first_value(bytes) OVER w AS bytes_this
  FROM e WINDOW w AS (PARTITION BY import_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT *, CAST(CASE WHEN finished THEN lines WHEN guess THEN coalesce(lf, le) END AS BIGINT) AS lines_total,
  CAST(CASE WHEN finished THEN queries WHEN guess THEN coalesce(qf, qe) END AS BIGINT) AS queries_total,
  CASE WHEN NOT is_gzip THEN CASE WHEN finished THEN 100.0 ELSE least(100.0, round(bytes * 10000 / file_size) / 100) END END AS pct_done,
  CAST(CASE WHEN finished THEN 0 WHEN NOT is_gzip THEN greatest(0, file_size - bytes) END AS BIGINT) AS bytes_togo FROM f)
"""


@query(_LOG + """
SELECT import_id, seq, finished, lines_this, lines AS lines_done, lines_total, CASE WHEN lines_total IS NOT NULL THEN greatest(0, lines_total - lines) END AS lines_togo,
  queries AS queries_done, queries_total, bytes_this, bytes AS bytes_done, bytes_togo, CAST(pct_done AS DOUBLE) AS pct_done,
  CAST(CASE WHEN NOT is_gzip THEN CASE WHEN finished THEN 0.0 ELSE greatest(0.0, round(100 - pct_done, 2)) END END AS DOUBLE) AS pct_togo,
  round(bytes / 1024, 2) AS kb_done, round(bytes_togo / 1048576, 2) AS mb_togo, lf IS NOT NULL AS estimates_frozen
FROM t
""")
def progress_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Progress of every load slice with frozen estimates."""
    return p.progress(_load_log(spark, sf)).select(
        "import_id", "seq", "finished", "lines_this", "lines_done", "lines_total", "lines_togo", "queries_done", "queries_total",
        "bytes_this", "bytes_done", "bytes_togo", "pct_done", "pct_togo", "kb_done", "mb_togo", "estimates_frozen")


@query("""
WITH e AS (SELECT user_id AS import_id, event_id AS seq, epoch_us(ts) / 1e6 AS t, 100 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS lines FROM events),
d AS (SELECT *, t - lag(t) OVER w AS dt, t - first_value(t) OVER w AS whole, lines - lag(lines) OVER w AS dl, lines - first_value(lines) OVER w AS al FROM e
  WINDOW w AS (PARTITION BY import_id ORDER BY seq))
SELECT import_id, seq, round(CASE WHEN dt > 0 THEN dl / dt ELSE 0 END, 6) AS speed_lps, round(CASE WHEN whole > 0 THEN al / whole ELSE 0 END, 6) AS speed_overall FROM d
""")
def load_speed(spark: SparkSession, sf: str) -> DataFrame:
    """Lines per second of each slice and overall."""
    events = table(spark, sf, "events")
    lines = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) * 100
    log = events.select(F.col("user_id").alias("import_id"), F.col("event_id").alias("seq"), "ts", lines.alias("lines"))
    return p.with_speed(log).select("import_id", "seq", F.round("speed_lps", 6).alias("speed_lps"), F.round("speed_overall", 6).alias("speed_overall"))


@query("""
WITH s AS (SELECT user_id AS import_id, event_id AS seq, value AS s, CAST(event_id * 7 % 100 AS INTEGER) AS mem FROM events),
w AS (SELECT *, count(*) OVER f AS n, avg(s) OVER f AS mean, avg(mem) OVER f AS avg_mem, coalesce(var_samp(s) OVER f, 0) AS var,
  (s + lag(s) OVER (PARTITION BY import_id ORDER BY seq)) / 2 AS recent, (first_value(s) OVER f + nth_value(s, 2) OVER f) / 2 AS earlier
  FROM s WINDOW f AS (PARTITION BY import_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
r AS (SELECT *, CASE WHEN n < 3 THEN 'collecting_samples' WHEN avg_mem < 30 AND var < 0.1 * mean * mean THEN 'ram_underutilized'
  WHEN avg_mem > 70 THEN 'memory_pressure' WHEN n >= 4 AND earlier > 0 AND recent < earlier * 0.7 THEN 'speed_degradation' ELSE 'optimal' END AS reason FROM w)
SELECT import_id, seq, n AS n_samples, round(mean, 4) AS avg_speed, round(var, 6) AS speed_variance, round(avg_mem, 4) AS avg_memory, reason,
  CASE WHEN reason = 'ram_underutilized' THEN 'increase' WHEN reason IN ('memory_pressure', 'speed_degradation') THEN 'decrease' ELSE 'stable' END AS action,
  CASE WHEN n < 3 THEN 'calculating' WHEN earlier = 0 THEN 'stable' WHEN recent / earlier > 1.1 THEN 'increasing' WHEN recent / earlier < 0.9 THEN 'decreasing' ELSE 'stable' END AS trend
FROM r
""")
def speed_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling statistics, adaptation signal and trend of the last five samples."""
    events = table(spark, sf, "events")
    samples = events.select(F.col("user_id").alias("import_id"), F.col("event_id").alias("seq"), F.col("value").alias("speed_lps"),
                            (F.col("event_id") * 7 % 100).cast("int").alias("memory_pct"))
    got = p.adaptation(samples)
    return got.select("import_id", "seq", "n_samples", F.round("avg_speed", 4).alias("avg_speed"), F.round("speed_variance", 6).alias("speed_variance"),
                      F.round("avg_memory", 4).alias("avg_memory"), "reason", "action", "trend")


@query(_LOG + """,
x AS (SELECT import_id, seq, pct_done, 10 * row_number() OVER (PARTITION BY import_id ORDER BY seq) AS elapsed FROM t),
y AS (SELECT *, CASE WHEN pct_done > 0 THEN (100 - pct_done) / (pct_done / elapsed) END AS now FROM x)
SELECT import_id, seq, round(CASE WHEN pct_done > 0 THEN avg(now) OVER (PARTITION BY import_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END, 4) AS eta_seconds FROM y
""")
def time_left(spark: SparkSession, sf: str) -> DataFrame:
    """Estimated seconds left, averaged over the last five estimates."""
    rows = p.progress(_load_log(spark, sf))
    timed = rows.withColumn("elapsed", F.row_number().over(Window.partitionBy("import_id").orderBy("seq")) * 10)
    return p.eta(timed).select("import_id", "seq", F.round("eta_seconds", 4).alias("eta_seconds"))


@query("""
SELECT o_custkey AS import_id, o_orderkey AS seq, max(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS shown_lines_done FROM orders
""")
def shown_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Shown values never fall."""
    orders = table(spark, sf, "orders")
    rows = orders.select(F.col("o_custkey").alias("import_id"), F.col("o_orderkey").alias("seq"), F.floor("o_totalprice").alias("lines_done"))
    return p.monotone(rows, "lines_done").drop("lines_done")


@query("""
WITH r AS (SELECT o_orderkey AS seq, o_totalprice / 200000 AS ratio FROM orders)
SELECT seq, ratio, CAST(floor(ratio * 100) AS INTEGER) AS percentage, CASE WHEN ratio > 0.8 THEN 'decrease' WHEN ratio < 0.5 THEN 'increase' END AS action,
  CAST(CASE WHEN ratio > 0.8 THEN 0.8 WHEN ratio < 0.5 THEN 1.2 END AS DOUBLE) AS factor, CASE WHEN ratio > 0.8 THEN 'memory_high' WHEN ratio < 0.5 THEN 'memory_low' END AS reason
FROM r
""")
def memory_rule(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return orders.select(F.col("o_orderkey").alias("seq"), p.memory_pressure(F.col("o_totalprice"), F.lit(200000.0)).alias("m")).select("seq", "m.*")


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a history of loads; errors are failed loads."""
    events = table(spark, sf, "events")
    return events.select(
        F.concat(F.lit("imp_"), F.col("event_id").cast("string")).alias("id"), F.concat("event_type", F.lit(".sql")).alias("filename"), "ts",
        (F.col("event_id") % 100).alias("queries_executed"), (F.col("event_id") % 1000).alias("lines_processed"),
        F.floor(F.col("value") * 10000).cast("long").alias("bytes_processed"), (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", "failed").alias("error"), F.col("value").alias("duration"))


_HISTORY = """
WITH h AS (SELECT 'imp_' || event_id AS id, event_type || '.sql' AS filename, ts, event_id % 100 AS queries_executed,
  CAST(floor(value * 10000) AS BIGINT) AS bytes_processed, event_type <> 'error' AS success, value AS duration FROM events)
"""


def _size_sql(x: str) -> str:
    def part(k: int, unit: str) -> str:
        return f"regexp_replace(CAST(round({x} / {float(1024**k)}, 2) AS VARCHAR), '\\.0$', '') || ' {unit}'"
    return (f"CASE WHEN {x} >= 1073741824 THEN {part(3, 'GB')} WHEN {x} >= 1048576 THEN {part(2, 'MB')} "
            f"WHEN {x} >= 1024 THEN {part(1, 'KB')} ELSE {part(0, 'B')} END")


@query(_HISTORY + "SELECT id, filename, queries_executed, success FROM h ORDER BY ts DESC, id DESC LIMIT 20")
def history_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty newest loads."""
    return h.newest(_history(spark, sf)).select("id", "filename", "queries_executed", "success")


@query(_HISTORY + "SELECT id FROM h ORDER BY ts DESC, id DESC LIMIT 50")
def history_retained(spark: SparkSession, sf: str) -> DataFrame:
    return h.retain(_history(spark, sf), 50).select("id")


@query(_HISTORY + f"""
SELECT count(*) AS total_imports, count(*) FILTER (WHERE success) AS successful_imports, count(*) FILTER (WHERE NOT success) AS failed_imports,
  CAST(sum(queries_executed) AS BIGINT) AS total_queries, CAST(sum(bytes_processed) AS BIGINT) AS total_bytes, {_size_sql('CAST(sum(bytes_processed) AS DOUBLE)')} AS total_bytes_formatted,
  round(avg(duration), 2) AS avg_duration, arg_max(id, (ts, id)) AS last_import FROM h
""")
def history_summary(spark: SparkSession, sf: str) -> DataFrame:
    return h.summary(_history(spark, sf))


@query(_HISTORY + "SELECT id, success FROM h WHERE id <> 'imp_5'")
def history_without(spark: SparkSession, sf: str) -> DataFrame:
    return h.without(_history(spark, sf), "imp_5").select("id", "success")


@query(_HISTORY + f"""
SELECT id, {_size_sql('CAST(bytes_processed AS DOUBLE)')} AS size_formatted, round(duration, 2) AS duration FROM h
""")
def history_entries(spark: SparkSession, sf: str) -> DataFrame:
    return h.entries(_history(spark, sf)).select("id", "size_formatted", "duration")


@query(f"""
WITH s AS (SELECT o_orderkey, floor(o_totalprice) * o_orderkey AS b, o_totalprice / 50 AS t FROM orders),
u AS (SELECT *, CAST(floor(t) AS BIGINT) AS w FROM s)
SELECT o_orderkey, {_size_sql('b')} AS size, CASE WHEN t < 60 THEN regexp_replace(CAST(round(t, 1) AS VARCHAR), '\\.0$', '') || 's'
  WHEN w // 60 < 60 THEN (w // 60) || 'm ' || (w % 60) || 's' ELSE (w // 3600) || 'h ' || (w // 60 % 60) || 'm' END AS duration,
  printf('%02d:%02d', w // 60, w % 60) AS clock, printf('%02d:%02d:%02d', w // 3600, w % 3600 // 60, w % 60) AS long_clock FROM u
""")
def sizes_and_times(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes and durations as text."""
    orders = table(spark, sf, "orders")
    t = F.col("o_totalprice") / 50
    return orders.select("o_orderkey", format_bytes(F.floor("o_totalprice") * F.col("o_orderkey")).alias("size"),
                         format_duration(t).alias("duration"), format_clock(t).alias("clock"), format_clock(t, True).alias("long_clock"))


def _error(k: Column, source: Column, id_: Column) -> Column:
    zz = F.concat(F.lit("zz"), id_.cast("string"))
    return (
        F.when(k == 0, F.concat(F.lit("Table '"), source, F.lit("' already exists")))
        .when(k == 1, F.concat(F.lit("Table '"), zz, F.lit("' doesn't exist")))
        .when(k == 2, F.concat(F.lit("SQL Error at line 3: table `"), F.upper(source), F.lit("` doesn't exist")))
        .when(k == 3, F.concat(F.lit("Table "), zz, F.lit(" already exists")))
        .otherwise(F.lit("Lost connection"))
    )


@query("""
WITH d AS (SELECT doc_id, lang || '.sql' AS filename, source, doc_id % 5 AS k FROM documents),
c AS (SELECT DISTINCT lang || '.sql' AS filename, source FROM documents WHERE doc_id % 2 = 0),
e AS (SELECT d.*, CASE k WHEN 0 THEN source WHEN 2 THEN upper(source) WHEN 4 THEN NULL ELSE 'zz' || doc_id END AS table_name,
  CASE WHEN k IN (0, 3) THEN 'already exists' WHEN k IN (1, 2) THEN 'doesn''t exist' END AS error_kind FROM d)
SELECT CAST(doc_id AS VARCHAR) AS id, e.filename, table_name, error_kind, c.source IS NOT NULL AS has_create_table,
  CASE WHEN error_kind = 'already exists' AND c.source IS NOT NULL THEN 'drop table and restart' WHEN error_kind = 'already exists' THEN 'drop table by hand or use another file'
  WHEN c.source IS NOT NULL THEN 'restart from the beginning' WHEN error_kind IS NOT NULL THEN 'create table by hand before the load' END AS action
FROM e LEFT JOIN c ON c.filename = e.filename AND c.source = lower(e.table_name)
""")
def error_advice(spark: SparkSession, sf: str) -> DataFrame:
    """Failed loads joined to the tables their dumps create."""
    docs = table(spark, sf, "documents")
    file = F.concat("lang", F.lit(".sql"))
    created = docs.filter("doc_id % 2 = 0").select(file.alias("file"), F.col("source").alias("table_name")).distinct()
    failed = docs.select(F.col("doc_id").cast("string").alias("id"), file.alias("filename"),
                         _error(F.col("doc_id") % 5, F.col("source"), F.col("doc_id")).alias("error"))
    return advise(failed, created).select("id", "filename", "table_name", "error_kind", "has_create_table", "action")


@query("""
SELECT page_id, 'SQL Error at line ' || page_id || ':' || chr(10) || 'Query: SELECT ''' || url || '''' || chr(10) || 'MySQL Error: no table' AS message FROM pages
""")
def error_messages(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    statement = F.concat(F.lit("SELECT "), quote(F.col("url")))
    return pages.select("page_id", error_message(F.col("page_id"), statement, F.lit("no table")).alias("message"))


@query("""
WITH f AS (SELECT c_name || CASE c_custkey % 6 WHEN 0 THEN '.sql' WHEN 1 THEN '.SQL.GZ' WHEN 2 THEN '.bz2' WHEN 3 THEN '.csv' WHEN 4 THEN '.txt' ELSE '' END AS name,
  c_custkey * 100000 AS size FROM customer)
SELECT name, size, CASE WHEN name LIKE '%.sql' THEN 'sql' WHEN name LIKE '%GZ' THEN 'gz' WHEN name LIKE '%bz2' THEN 'bz2' ELSE 'csv' END AS ext,
  CASE WHEN name LIKE '%.sql' THEN 'SQL' WHEN name LIKE '%GZ' THEN 'GZip' WHEN name LIKE '%bz2' THEN 'BZ2' ELSE 'CSV' END AS type,
  CASE WHEN name LIKE '%GZ' THEN 'gzip' WHEN name LIKE '%bz2' THEN 'bz2' ELSE 'none' END AS compression, size > 104857600 AS is_large
FROM f WHERE NOT (name LIKE '%.txt' OR name NOT LIKE '%.%')
""")
def catalogue_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Allowed files with type, compression and size labels."""
    customer = table(spark, sf, "customer")
    k = F.col("c_custkey") % 6
    ext = F.when(k == 0, ".sql").when(k == 1, ".SQL.GZ").when(k == 2, ".bz2").when(k == 3, ".csv").when(k == 4, ".txt").otherwise("")
    files = customer.select(F.concat(F.lit("/in/"), "c_name", ext).alias("path"), (F.col("c_custkey") * 100000).alias("size"))
    return allowed_files(describe_files(files)).select("name", "size", "ext", "type", "compression", "is_large")


@query("SELECT 'gz' AS ext, 'GZip' AS type, 'gzip' AS compression, true AS all_sized, count(*) AS n_lines FROM orders")
def catalogue_of_files(spark: SparkSession, sf: str) -> DataFrame:
    """Written dump files, listed without reading them, joined to their line counts."""
    orders = table(spark, sf, "orders")
    path = stage_path(spark, "catalogue")
    write_dump(orders.select(F.lit("orders").alias("file"), F.col("o_orderkey").alias("pos"), insert_text(orders, "orders").alias("text")), path, "gzip")
    counts = read_lines(spark, path).groupBy(F.substring_index("file", "/", -1).alias("name")).agg(F.count("*").alias("n"))
    files = list_files(spark, path).join(counts, "name")
    return files.groupBy("ext", "type", "compression").agg(F.bool_and(F.col("size") > 0).alias("all_sized"), F.sum("n").cast("long").alias("n_lines"))


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(replace(regexp_extract(url || ' é..sql', '[^/]*$'), ' ', '_'), '[^\p{L}\p{N}\-_.]', '', 'g'), '\.{2,}', '.', 'g') AS name FROM pages
""")
def clean_names(spark: SparkSession, sf: str) -> DataFrame:
    """File names made safe."""
    return table(spark, sf, "pages").select("page_id", clean_name(F.concat("url", F.lit(" é..sql"))).alias("name"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_files(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a listing that a former listing did not have."""
    return new_arrivals(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), on="doc_id")


@query("""
WITH s AS (SELECT o_orderkey, floor(o_totalprice) * o_orderkey AS size, o_orderkey % 7 = 0 AS gz FROM orders)
SELECT o_orderkey, CASE WHEN gz OR size = 0 THEN 'medium' WHEN size < 10485760 THEN 'tiny' WHEN size < 52428800 THEN 'small' WHEN size < 524288000 THEN 'medium'
  WHEN size < 2147483648 THEN 'large' ELSE 'massive' END AS category,
  CAST(CASE WHEN gz OR size = 0 THEN 0.4 WHEN size < 10485760 THEN 0.15 WHEN size < 52428800 THEN 0.2 WHEN size < 524288000 THEN 0.4
  WHEN size < 2147483648 THEN 0.6 ELSE 0.75 END AS DOUBLE) AS target_ram_usage FROM s
""")
def size_classes(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    size = F.floor("o_totalprice") * F.col("o_orderkey")
    return orders.select("o_orderkey", size_class(size, F.col("o_orderkey") % 7 == 0).alias("c")).select("o_orderkey", "c.category", "c.target_ram_usage")


def _chunks(spark: SparkSession, sf: str) -> str:
    """Customers as chunked dumps, one per nation; every chunk ends inside a statement."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    order = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    text = F.concat(F.lit("INSERT INTO `c` VALUES ("), F.col("c_custkey").cast("string"), F.lit(", 'it\\'s\n"), "c_name", F.lit(";\n');\n"))
    half = F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))
    rest = F.substring(text, F.floor(F.length(text) / 2).cast("int") + 1, F.length(text))
    no = F.row_number().over(order)
    own = F.when(no == 1, text).otherwise(rest)
    data = F.concat(own, F.coalesce(F.lead(half).over(order), F.lit("")))
    path = stage_path(spark, "chunks")
    rows = customer.select(
        F.col("c_nationkey").cast("string").alias("dump_id"), (no - 1).cast("long").alias("seq"),
        F.lead("c_custkey").over(order).isNull().alias("is_last"), data.cast("binary").alias("data"))
    rows.repartition(4, F.col("seq") % 4).write.parquet(path)
    return path


_CHUNK_ROWS = "dump_id string, seq long, is_last boolean, data binary"


def _chunk_source(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(_CHUNK_ROWS).option("maxFilesPerTrigger", 2).parquet(path)


@query("""
SELECT CAST(c_nationkey AS VARCHAR) AS dump_id, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) * 3 + 1 AS BIGINT) AS pos,
  'INSERT INTO `c` VALUES (' || c_custkey || ', ''it\\''s' || chr(10) || c_name || ';' || chr(10) || ''')' AS text, false AS is_tail
FROM customer
""")
def stream_chunked_dumps(spark: SparkSession, sf: str) -> DataFrame:
    """Stateful splitting of chunked dumps whose chunks arrive out of order."""
    found, out = split_stream(_chunk_source(spark, _chunks(spark, sf))), stage_path(spark, "streamed")
    job = found.writeStream.format("parquet").option("checkpointLocation", stage_path(spark, "check")).option("path", out)
    job.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out).select("dump_id", "pos", "text", "is_tail")


@query("""
SELECT CAST(c_nationkey AS VARCHAR) AS dump_id, count(*) AS queries, count(*) AS inserts, CAST(count(*) * 3 AS BIGINT) AS lines, CAST(0 AS BIGINT) AS errors FROM customer GROUP BY c_nationkey
""")
def stream_live_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Statement counts per dump, kept up to date in the query that splits the arriving chunks."""
    found, out = live_statistics(split_stream(_chunk_source(spark, _chunks(spark, sf)))), stage_path(spark, "live")
    job = found.writeStream.format("parquet").option("checkpointLocation", stage_path(spark, "check")).option("path", out)
    job.trigger(availableNow=True).start().awaitTermination()
    counts = ["queries", "inserts", "lines", "errors"]
    latest = spark.read.schema(found.schema).parquet(out).groupBy("dump_id").agg(F.max(F.struct(*counts)).alias("now"))
    return latest.select("dump_id", *[f"now.{c}" for c in counts])


@query("""
SELECT CAST(c_nationkey AS VARCHAR) AS dump_id, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) * 3 + 1 AS BIGINT) AS pos,
  'INSERT INTO `c` VALUES (' || c_custkey || ', ''it\\''s' || chr(10) || c_name || ';' || chr(10) || ''')' AS text, false AS is_tail
FROM customer
""")
def stream_stop_resume(spark: SparkSession, sf: str) -> DataFrame:
    """The same statements, once each, by a query that fails after it wrote a batch and before it could commit it, and is started again."""
    path, out, check, failed = _chunks(spark, sf), stage_path(spark, "streamed"), stage_path(spark, "check"), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if not failed:
            failed.append(number)
            raise InterruptedError("stopped after the write")

    def run() -> None:
        job = split_stream(_chunk_source(spark, path)).writeStream.foreachBatch(keep).option("checkpointLocation", check)
        job.trigger(availableNow=True).start().awaitTermination()

    try:
        run()
    except StreamingQueryException:
        run()
    return spark.read.parquet(out).select("dump_id", "pos", "text", "is_tail")


@query("""
WITH c AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT CAST(c_nationkey AS VARCHAR) AS dump_id, CAST((rn - 1) * 3 + 1 AS BIGINT) AS pos, NULL AS error FROM c WHERE c_nationkey % 5 > 0 OR rn = 1
UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 3, 'Chunk 1 did not arrive in time; ' || (n - 2) || ' later chunks were not read' FROM c WHERE c_nationkey % 5 = 0 AND rn = 1 AND n > 1
""")
def stream_lost_chunk(spark: SparkSession, sf: str) -> DataFrame:
    """Of every fifth dump a chunk never comes: what came before it stays, and once time went on an error row ends the dump."""
    path, out, check = stage_path(spark, "chunks"), stage_path(spark, "streamed"), stage_path(spark, "check")
    rows = spark.read.schema(_CHUNK_ROWS).parquet(_chunks(spark, sf)).withColumn("arrived", F.timestamp_seconds(F.lit(1_700_000_000)))
    rows.filter(~((F.col("dump_id").cast("int") % 5 == 0) & (F.col("seq") == 1))).write.parquet(path)

    def run() -> DataFrame:
        chunks = spark.readStream.schema(_CHUNK_ROWS + ", arrived timestamp").option("maxFilesPerTrigger", 2).parquet(path)
        found = split_stream(chunks, wait="30 days")
        job = found.writeStream.format("parquet").option("checkpointLocation", check).option("path", out)
        job.trigger(availableNow=True).start().awaitTermination()
        return found

    run()
    late = spark.range(1).select(
        F.lit("late").alias("dump_id"), F.lit(0).cast("long").alias("seq"), F.lit(True).alias("is_last"),
        F.lit("SELECT 1;").cast("binary").alias("data"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("arrived"))
    late.write.mode("append").parquet(path)
    return spark.read.schema(run().schema).parquet(out).filter("dump_id <> 'late'").select("dump_id", "pos", "error")


@query("SELECT 'INSERT' AS keyword, count(*) AS n FROM orders")
def stream_arriving_dumps(spark: SparkSession, sf: str) -> DataFrame:
    """Dump files split as they arrive, one batch scan per micro-batch."""
    orders = table(spark, sf, "orders")
    path, target = stage_path(spark, "arriving"), stage_path(spark, "arrived")
    write_dump(orders.select(F.lit("orders").alias("file"), F.col("o_orderkey").alias("pos"), insert_text(orders, "orders").alias("text")), path)
    ingest_dumps(spark, path, target, stage_path(spark, "check"), max_files=2).awaitTermination()
    return spark.read.parquet(f"{target}/statements").groupBy("keyword").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, format('{:,}', o_orderkey * 7919) AS whole, format('{:,.2f}', o_totalprice) AS price FROM orders
""")
def formatted_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers with commas between thousands."""
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", number_format(F.col("o_orderkey") * 7919).alias("whole"), number_format(F.col("o_totalprice"), 2).alias("price"))
