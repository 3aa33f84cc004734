import bz2
import gzip
import os
import random

import pytest
from sequential import split

from dumplake.operators.scan import ScanOptions, scan
from dumplake.operators.statements import accepted, quality, split_statements
from dumplake.sources.lines import read_lines

WORDS = ["'", "''", '"', "\\", ";", "//", ";\n", "//\n", "\n", "\n", "-- ", "--\n", "#", "DELIMITER //\n", "delimiter ;\n",
         "DELIMITER 0\n", "DELIMITER\n", " ", "\t", "0", "0;\n", "INSERT INTO t VALUES (1)", "\r\n", "\r", "é", "it\\'s"]


def read(spark, path, options=None, **kw):
    got = split_statements(read_lines(spark, path), options, **kw)
    rows = got.statements.orderBy("file", "pos").collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(os.path.basename(r.file), []).append(r)
    return got, by_file


@pytest.mark.parametrize("dialect,strict", [("import", False), ("cli", False), ("import", True)])
def test_random_dumps_match_sequential_reading(spark, dump, dialect, strict):
    rng = random.Random(f"{dialect}{strict}")
    texts = {f"f{i}__sql": "".join(rng.choice(WORDS) for _ in range(rng.randint(0, 140))) for i in range(20)}
    path = dump(**texts)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128")
    try:
        got, by_file = read(spark, path, ScanOptions(dialect, strict), max_lines=10**6)
        states = {os.path.basename(r.file): r.end_state for r in got.files.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, text in texts.items():
        name = name.replace("__", ".")
        statements, tail, state = split(text, dialect, strict)
        rows = by_file.get(name, [])
        assert [(r.pos, r.text) for r in rows if not r.is_tail] == statements, (name, text)
        assert [r.text for r in rows if r.is_tail] == ([tail] if tail else []), (name, text)
        if text:
            assert states[name] == state


def test_lines_and_blocks_across_many_splits(spark, dump):
    body = "".join(f"INSERT INTO t VALUES ({i}, 'line {i}\nmore; -- no comment\n# still text');\n-- c\n" for i in range(400))
    path = dump(a__sql=body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        scanned = scan(read_lines(spark, path))
        assert scanned.blocks.count() > 10
        rows = scanned.lines().orderBy("line_no").collect()
        got, by_file = read(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line_no for r in rows] == list(range(1, 1601))
    assert [r.value for r in rows] == body.split("\n")[:-1]
    assert [r.start_state for r in rows[:4]] == ["", "'", "'", ""]
    assert len(by_file["a.sql"]) == 400
    assert by_file["a.sql"][7].first_line == 29 and by_file["a.sql"][7].last_line == 31


def test_block_table_joined_by_shuffle(spark, dump, monkeypatch):
    import dumplake.operators.scan as module
    text = "".join(f"INSERT INTO t VALUES ({i}, 'a\nb');\n-- x\n" for i in range(300))
    path = dump(a__sql=text, b__sql=text[7:])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        _, by_hash = read(spark, path)
        monkeypatch.setattr(module, "broadcast_within", lambda df: (df.hint("merge"), False))
        _, by_merge = read(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert by_hash == by_merge and len(by_hash["a.sql"]) == 300


def test_compressed_files_read_alike(spark, dump):
    text = "".join(f"INSERT INTO t VALUES ({i}, 'a\nb');\n" for i in range(300))
    path = dump(p__sql=text, g__gz=gzip.compress(text.encode()), b__bz2=bz2.compress(text.encode()))
    _, by_file = read(spark, path)
    assert len(by_file) == 3
    assert len({tuple((r.pos, r.text) for r in rows) for rows in by_file.values()}) == 1


@pytest.mark.parametrize("mark", [b"\xef\xbb\xbf", b"\x00\x00\xfe\xff", b"\xff\xfe\x00\x00", b"\xfe\xff", b"\xff\xfe"])
def test_byte_order_mark_is_stripped_from_first_line_only(spark, dump, mark):
    path = dump(a__sql=mark + b"-- head\nSELECT 1;\n", b__sql=mark + b"SELECT 'x';\nSELECT 2;\n", c__sql=mark + b"DELIMITER //\nA;\nB//\n")
    _, by_file = read(spark, path)
    assert [r.text for r in by_file["a.sql"]] == ["SELECT 1"]
    assert [r.text for r in by_file["b.sql"]] == ["SELECT 'x'", "SELECT 2"]
    assert [r.text for r in by_file["c.sql"]] == ["A;\nB"]


def test_rules_of_note(spark, dump):
    path = dump(
        one_line__sql="SELECT 1; SELECT 2;\n", comment_after__sql="SELECT 1; -- x\nSELECT 2;\n",
        pma__sql="--\n-- Indexes\n--\nALTER TABLE `t`\n  ADD KEY (`a`);\n", dashes__sql="--x\n;\n", cond__sql="/*!40101 SET x=1 */;\n",
    )
    _, imported = read(spark, path)
    assert [r.text for r in imported["one_line.sql"]] == ["SELECT 1; SELECT 2"]
    assert [r.text for r in imported["comment_after.sql"]] == ["SELECT 1; -- x\nSELECT 2"]
    assert [r.text for r in imported["pma.sql"]] == ["ALTER TABLE `t`\n  ADD KEY (`a`)"]
    assert [r.text for r in imported["dashes.sql"]] == ["--x"]
    assert [r.text for r in imported["cond.sql"]] == ["/*!40101 SET x=1 */"]
    _, cli = read(spark, path, ScanOptions("cli"))
    assert cli["pma.sql"][0].text.startswith("--\n--\nALTER")


def test_tail_keywords_and_unclosed_string(spark, dump):
    path = dump(a__sql="SELECT 1;\nINSERT INTO t VALUES (1)\n", b__sql="foo bar\n", c__sql="INSERT INTO t VALUES ('x\n")
    got, by_file = read(spark, path)
    assert [r.text for r in by_file["b.sql"] if r.is_tail] == ["foo bar"]
    kept = {(os.path.basename(r.file), r.text) for r in accepted(got.statements).collect()}
    assert kept == {("a.sql", "INSERT INTO t VALUES (1)"), ("c.sql", "INSERT INTO t VALUES ('x")} | (
        {("a.sql", "SELECT 1")}
    )
    report = {os.path.basename(r.file): r for r in quality(got).collect()}
    assert report["c.sql"].problem and report["c.sql"].end_state == "'"
    assert report["a.sql"].problem is None and report["a.sql"].has_tail


@pytest.mark.parametrize("dialect", ["import", "cli"])
def test_limits_label_and_change_nothing(spark, dump, dialect):
    long = "CREATE PROCEDURE p\n" + "x\n" * 9 + "end;\n"
    text = "SELECT 1;\n" + long + "SELECT '" + "x" * 300 + "';\nSELECT 'a\nb" + "y" * 300 + "\nc';\nSELECT 2;\n"
    path = dump(a__sql=text)
    want, _, _ = split(text, dialect)
    for limit, over in (({}, []), ({"max_lines": 5}, [2]), ({"max_bytes": 200}, [13, 14])):
        got, by_file = read(spark, path, ScanOptions(dialect), **limit)
        assert [(r.pos, r.text) for r in by_file["a.sql"]] == want
        assert [r.pos for r in by_file["a.sql"] if r.error] == over
        assert accepted(got.statements, dialect).count() == len(want)


def test_statement_too_long_for_a_row_comes_in_parts(spark, dump):
    body = "SELECT '" + "\n".join(f"line {i}" for i in range(300)) + "';"
    path = dump(a__sql="SELECT 1;\n" + body + "\nSELECT 2;\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        rows = split_statements(read_lines(spark, path), row_bytes=500).statements.orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    parts = [r.text for r in rows if r.part]
    assert "\n".join(parts) == body and len(parts) > 3 and not any(r.is_tail for r in rows)
    assert [r.text for r in rows if not r.part] == ["SELECT 1", "SELECT 2"]
    assert [r.part for r in rows if r.part] == sorted({r.part for r in rows if r.part})


def test_open_statement_is_handed_on_in_parts(spark, dump, monkeypatch):
    """What stays open over many batches is handed on in parts and joined again."""
    import dumplake.operators.scan as module
    text = "SELECT 1;\nSELECT 'a;\n" + "INSERT INTO t VALUES (1, 'x');\n" * 200 + "SELECT 9;\n" * 3
    path = dump(a__sql=text)
    monkeypatch.setattr(module, "PART_BYTES", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        _, whole = read(spark, path)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    statements, tail, _ = split(text)
    assert [(r.pos, r.text) for r in whole["a.sql"] if not r.is_tail] == statements
    assert [r.text for r in whole["a.sql"] if r.is_tail] == ([tail] if tail else [])


def test_latin1(spark, dump):
    path = dump(a__sql="SELECT 'é';\n".encode("latin1"))
    rows = split_statements(read_lines(spark, path, charset="ISO-8859-1")).statements.collect()
    assert rows[0].text == "SELECT 'é'"


def test_long_literal_with_many_escapes(spark, dump):
    path = dump(a__sql="SELECT '" + "\\'x''" * 200_000 + "';\nSELECT 2;\n")
    rows = split_statements(read_lines(spark, path)).statements.orderBy("pos").collect()
    assert len(rows) == 2 and len(rows[0].text) == 5 * 200_000 + 9
    assert rows[1].text == "SELECT 2"
