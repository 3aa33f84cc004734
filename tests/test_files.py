import bz2
import gzip
import json
import os
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from dumplake.operators import history as h
from dumplake.operators.diagnose import advise, error_message, parse_errors
from dumplake.operators.profile import (
    created_tables, created_tables_raw, has_create_table, preview_lines, preview_statements, profile_files, reset_tables,
)
from dumplake.operators.scan import scan
from dumplake.operators.sessions import line_sessions
from dumplake.operators.statements import split_statements
from dumplake.plans.jobs import optimise_files
from dumplake.sinks import dump_text, save_table, write_dump
from dumplake.sources.catalog import clean_name, list_files, new_arrivals
from dumplake.sources.lines import number_lines, read_lines

SHOP = """-- A small shop

CREATE TABLE IF NOT EXISTS `goods` (
  `id` INT PRIMARY KEY,
  `name` VARCHAR(99)
);
INSERT INTO `goods` VALUES (1, 'one');
INSERT INTO `goods` VALUES (2, 'two');
-- between
INSERT INTO `goods` VALUES (3, 'three');
CREATE INDEX i ON `goods` (`name`);
INSERT INTO `goods` VALUES (4, 'four');
INSERT IGNORE INTO `goods` VALUES (5, 'five');
INSERT IGNORE INTO `goods` VALUES (6, 'six');
UPDATE `goods` SET `name` = 'x' WHERE `id` > 3;
"""

OPTIMISED = """CREATE TABLE IF NOT EXISTS `goods` (
  `id` INT PRIMARY KEY,
  `name` VARCHAR(99)
);
INSERT INTO `goods` VALUES (1, 'one'), (2, 'two'), (3, 'three');
CREATE INDEX i ON `goods` (`name`);
INSERT INTO `goods` VALUES (4, 'four');
INSERT IGNORE INTO `goods` VALUES (5, 'five'), (6, 'six');
UPDATE `goods` SET `name` = 'x' WHERE `id` > 3;
"""


def read_back(path, opener=open):
    names = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    return "".join(opener(os.path.join(path, n), "rt").read() for n in names)


@pytest.mark.parametrize("name,pack", [("a__sql", str.encode), ("a__gz", lambda t: gzip.compress(t.encode())), ("a__bz2", lambda t: bz2.compress(t.encode()))])
def test_optimised_dump(spark, dump, name, pack):
    path = dump(**{name: pack(SHOP)})
    out = os.path.join(tempfile.mkdtemp(prefix="dumplake-test-"), "out")
    stats = optimise_files(spark, path, out).first()
    assert read_back(out) == OPTIMISED
    assert (stats.lines_processed, stats.queries_written, stats.inserts_batched, stats.batched_queries_executed) == (15, 6, 6, 3)
    assert stats.output_size == len(OPTIMISED)
    with pytest.raises(Exception):
        optimise_files(spark, path, out)
    optimise_files(spark, path, out, force=True, compression="gzip")
    assert read_back(out, gzip.open) == OPTIMISED


def test_safe_delimiters_read_back_whole(spark, dump, folder):
    text = "DELIMITER //\nCREATE PROCEDURE p()\nBEGIN\n  SELECT 1;\nEND//\nDELIMITER ;\nSELECT 2;\n"
    statements = split_statements(read_lines(spark, dump(a__sql=text))).statements
    out = os.path.join(folder, "safe")
    write_dump(statements, out, safe_delimiters=True)
    again = split_statements(read_lines(spark, out)).statements.orderBy("pos").collect()
    assert [r.text for r in again] == ["CREATE PROCEDURE p()\nBEGIN\n  SELECT 1;\nEND", "SELECT 2"]


def test_catalogue_and_new_arrivals(spark, dump):
    path = dump(b__sql="x", A__SQL="x", c__gz=b"x", d__txt="x", e__csv="x", noext="x")
    files = list_files(spark, path)
    assert [(r.name, r.type) for r in files.collect()] == [("A.SQL", "SQL"), ("b.sql", "SQL"), ("c.gz", "GZip"), ("e.csv", "CSV")]
    known = files.filter("name <> 'c.gz'")
    assert [r.name for r in new_arrivals(files, known).collect()] == ["c.gz"]


@pytest.mark.parametrize("name,clean", [
    ("../../etc/my dump.sql", "my_dump.sql"), ("a..b...sql", "a.b.sql"), ("été$%.sql", "été.sql"), ("...", "upload.sql"), ("", "upload.sql"),
    ("x" * 300 + ".SQL", "x" * 251 + ".sql"), ("y" * 300, "y" * 255), ("dir/", "dir"),
])
def test_clean_names(spark, name, clean):
    assert spark.createDataFrame([(name,)], "n string").select(clean_name(F.col("n"))).first()[0] == clean


def test_numbered_lines_across_splits(spark, dump):
    text = "".join(f"line {i}\n" for i in range(2000))
    path = dump(a__sql=text, b__sql=text[:500])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    try:
        rows = number_lines(read_lines(spark, path)).filter(F.col("file").endswith("a.sql")).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.line_no, r.value) for r in rows] == [(i + 1, f"line {i}") for i in range(2000)]
    assert [r.bucket for r in rows] == sorted(r.bucket for r in rows)


def test_profile(spark, dump):
    late = "SELECT 1;\n" * 200_000 + "INSERT\nINTO t\nVALUES (1),\n(2);\n"
    path = dump(a__sql="INSERT INTO t VALUES (1), (2);\n" * 10, b__sql="no newline", c__gz=gzip.compress(b"x\ny\n"), d__sql=late)
    sizes = list_files(spark, path).select(F.col("path").alias("file"), "size")
    got = {os.path.basename(r.file): r for r in profile_files(read_lines(spark, path), sizes).collect()}
    a, c = got["a.sql"], got["c.gz"]
    assert (a.file_size, a.category, a.estimated_lines, a.avg_bytes_per_line, a.is_bulk_insert) == (310, "tiny", 10, 31.0, True)
    assert (got["d.sql"].is_bulk_insert, got["d.sql"].estimated_lines) == (True, 200_004) and not got["b.sql"].is_bulk_insert
    assert (c.category, c.estimated_lines, c.is_gzip, c.is_estimate, c.file_size) == ("medium", None, True, True, 0)


def test_created_tables(spark, dump):
    text = ("DROP TABLE old_table;\nCREATE TABLE `users` (\n id INT);\nCREATE TABLE IF NOT EXISTS posts (id INT);\n"
            "create table \"quoted\" (id INT);\nCREATE TABLE users (id INT);\n-- CREATE TABLE hidden (id INT);\nCREATE TABLE `1bad` (id INT);\n")
    path = dump(a__sql=text)
    created = created_tables(split_statements(read_lines(spark, path)).statements)
    assert [(r.table_name, r.first_pos) for r in created.orderBy("first_pos").collect()] == [("users", 2), ("posts", 4), ("quoted", 5)]
    raw = created_tables_raw(read_lines(spark, path)).orderBy("first_pos").collect()
    assert [r.table_name for r in raw] == ["users", "posts", "quoted", "hidden"]
    file = created.first().file
    wanted = spark.createDataFrame([(file, "POSTS"), (file, "nothing")], "file string, table_name string")
    assert [r.table_name for r in has_create_table(wanted, created).collect()] == ["POSTS"]


@pytest.mark.parametrize("size", ["150", "1k"])
def test_created_tables_across_lines_and_splits(spark, dump, size):
    text = "".join(f"-- {i}\nCREATE  TABLE{chr(10) * (i % 4 + 1)} IF NOT\nEXISTS `t{i}`\n\n (id INT);\n" for i in range(24))
    path = dump(a__sql=text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = created_tables_raw(read_lines(spark, path)).orderBy("first_pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(m[1], text.count("\n", 0, m.start()) + 1) for m in re.finditer(r"CREATE\s+TABLE\s+IF\s+NOT\s+EXISTS\s+`(\w+)`\s*\(", text)]
    assert len(want) == 24 and [(r.table_name, r.first_pos) for r in got] == want


def test_reset_drops_only_created_tables(spark, dump):
    spark.sql("CREATE TABLE IF NOT EXISTS dl_reset_a (id INT) USING parquet")
    created = created_tables(split_statements(read_lines(spark, dump(a__sql="CREATE TABLE dl_reset_a (id INT);\n"))).statements)
    assert reset_tables(spark, created, created.first().file) == {"dropped": ["dl_reset_a"], "errors": []}
    assert not spark.catalog.tableExists("dl_reset_a")


def test_table_sink_appends_or_empties(spark):
    rows = spark.range(3)
    try:
        save_table(rows, "dl_sink")
        save_table(rows, "dl_sink")
        assert spark.table("dl_sink").count() == 6
        save_table(rows, "dl_sink", empty_first=True)
        assert spark.table("dl_sink").count() == 3
    finally:
        spark.sql("DROP TABLE IF EXISTS dl_sink")


def test_preview(spark, dump):
    text = "-- c\nSELECT 1;\n/* x */\nSELECT 'a;\nb';\n" + "".join(f"SELECT {i};\n" for i in range(100))
    lines = preview_lines(read_lines(spark, dump(a__sql=text)), 500)
    assert lines.count() == 105
    got = [r["query"] for r in preview_statements(lines).orderBy("query_no").collect()]
    assert got[:3] == ["SELECT 1;", "SELECT 'a;", "b';"] and len(got) == 10


@pytest.mark.parametrize("length,chunk", [(5, 40), (7, 10), (1, 13), (50, 64)])
def test_sessions_match_the_loop(spark, dump, length, chunk):
    rng = random.Random(length)
    text = "".join(rng.choice(["SELECT 1;\n", "SELECT 'a\n", "b';\n", "c\n"]) for _ in range(400))
    lines = scan(read_lines(spark, dump(a__sql=text))).lines()
    states = [r.end_state for r in lines.orderBy("line_no").collect()]
    want, at = [], 0
    while at < len(states):
        end = at
        while end < len(states) and (end - at < length or states[end - 1] != ""):
            end += 1
        want.append((at + 1, end))
        at = end
    got = line_sessions(lines, length, chunk).orderBy("session").collect()
    assert [(r.first_line, r.last_line) for r in got] == want
    assert [r.session for r in got] == list(range(1, len(want) + 1))


def test_history_folder(spark, folder):
    path = os.path.join(folder, "history")
    assert h.read_history(spark, path).count() == 0
    assert h.summary(h.read_history(spark, path)).first().total_imports == 0
    loads = spark.range(60).select(
        F.concat(F.lit("imp_"), "id").alias("id"), F.lit("a.sql").alias("filename"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("queries_executed"),
        F.lit(1).alias("lines_processed"), F.lit(2048).alias("bytes_processed"), (F.col("id") % 2 == 0).alias("success"), F.lit(None).alias("error"), F.lit(1.234).alias("duration"))
    h.append_history(loads, path)
    assert [r.id for r in h.newest(h.read_history(spark, path), 2).collect()] == ["imp_59", "imp_58"]
    row = h.summary(h.read_history(spark, path)).first()
    assert (row.total_imports, row.failed_imports, row.total_bytes_formatted, row.avg_duration, row.last_import) == (60, 30, "120 KB", 1.23, "imp_59")
    assert h.delete_entry(spark, path, "imp_59") and not h.delete_entry(spark, path, "imp_59")
    h.trim_history(spark, path, 50)
    assert h.read_history(spark, path).count() == 50
    h.append_history(loads.filter("id = 'imp_59'"), path, keep=50)
    assert h.read_history(spark, path).count() == 50 and h.newest(h.read_history(spark, path), 1).first().id == "imp_59"
    h.clear_history(spark, path)
    assert h.read_history(spark, path).count() == 0
    assert [n for n in os.listdir(folder) if n.startswith("history")] == ["history"]
    broken = os.path.join(folder, "array.json")
    with open(broken, "w") as out:
        out.write(json.dumps([{"id": "x", "success": True}, {"id": "y", "success": False}]))
    assert h.read_history_array(spark, broken).count() == 2


def test_errors(spark):
    rows = [("f", "Table 'a' already exists"), ("f", "Table `b` doesn't exist"), ("f", "table c already exists"), ("f", "Lost connection")]
    failed = spark.createDataFrame(rows, "filename string, error string")
    assert [(r.table_name, r.error_kind) for r in parse_errors(failed).collect()] == [
        ("a", "already exists"), ("b", "doesn't exist"), ("c", "already exists"), (None, None)]
    created = spark.createDataFrame([("f", "A")], "file string, table_name string")
    got = {r.table_name: r.action for r in advise(failed, created).collect()}
    assert got == {"a": "drop table and restart", "b": "create table by hand before the load", "c": "drop table by hand or use another file", None: None}
    text = spark.range(1).select(error_message(F.lit(7), F.lit("x" * 600), F.lit("bad"))).first()[0]
    assert text == "SQL Error at line 7:\nQuery: " + "x" * 500 + "...\nMySQL Error: bad"


def test_dump_text(spark):
    df = spark.createDataFrame([(" a ",), ("b;",)], "t string")
    assert [r[0] for r in df.select(dump_text(F.col("t"))).collect()] == ["a;", "b;"]
