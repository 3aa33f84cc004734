import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dumplake.functions.arrow import stretches
from dumplake.functions.tuples import STRETCH_BYTES, advance, cut_lists, cut_part, summarise
from dumplake.operators.load import insert_tuples, load_rows, rejects, value_lists
from dumplake.operators.statements import split_statements
from dumplake.plans.jobs import load_dump, load_table
from dumplake.sources.lines import read_lines

BLANKS = " \t\n\r\x0b\x0c\0"


def one_by_one(text):
    """Tuples of a list read character by character, and what follows it."""
    out, i, end, commas = [], 0, 0, 0
    while True:
        while i < len(text) and (text[i] in BLANKS or text[i] == "," and not commas):
            commas += text[i] == ","
            i += 1
        if i >= len(text) or text[i] != "(":
            return out, text[end:]
        depth, quote, items, start = 1, "", [], i + 1
        i += 1
        while i < len(text) and depth:
            c = text[i]
            if c == "\\":
                i += 1
            elif quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            elif c == "(":
                depth += 1
            elif c in "),":
                depth -= c == ")"
                if depth == 0 or c == "," and depth == 1:
                    items.append(text[start:i])
                    start = i + 1
            i += 1
        if depth:
            return out, text[end:]
        out.append(items)
        end, commas = i, 0


ALPHABET = ["'", "'", '"', "\\", "(", ")", ",", ",", "a", "1", " ", "),(", "),(", "é", "''", "\n"]


def test_lists_like_character_by_character():
    rng = random.Random(0)
    for _ in range(150):
        texts = ["(" + "".join(rng.choices(ALPHABET, k=rng.randint(0, 25))) for _ in range(40)]
        lists, after = cut_lists(pa.array(texts))
        assert list(zip(lists.to_pylist(), after.to_pylist())) == [one_by_one(t) for t in texts]
    lists, after = cut_lists(pa.array([None, "", "(1)"]).slice(0, 3))
    assert lists.to_pylist() == [[], [], [["1"]]] and after.to_pylist() == ["", "", ""]
    assert cut_lists(pa.array([], pa.string()))[0].to_pylist() == []


def test_long_lists_are_cut_in_stretches():
    rng = random.Random(2)
    for stretch in (1, 2, 5, 9):
        for _ in range(150):
            text = "(" + "".join(rng.choices(ALPHABET, k=rng.randint(10, 60)))
            lists, after = cut_lists(pa.array([text]), stretch)
            assert [(lists[0].as_py(), after[0].as_py())] == [one_by_one(text)], (stretch, text)


def _peak_of_loading(batch):
    from dumplake.operators.load import _cut

    tracemalloc.start()
    try:
        n = sum(len(t) for out in _cut([batch]) for t in out.column("tuples"))
        return n, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("rows", [1, 24])
def test_memory_of_cutting_does_not_grow_with_the_batch(rows):
    text = ",".join(f"({i},'some text')" for i in range(24 * 40_000 // rows))
    n, peak = _peak_of_loading(pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array([text] * rows)], names=["pos", "rest"]))
    assert n == 24 * 40_000 and len(text) * rows > 3 * STRETCH_BYTES
    assert peak < 3 * len(text) * rows + 40 * STRETCH_BYTES


def test_stretches_keep_every_row_in_order():
    texts = ["ab", None, "", "x" * 9, "abc", "abc", "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["no", *texts, "no"])], names=["k", "t"]).slice(1, 7)
    parts = list(stretches(batch, 1, 6))
    assert [p.column(0).to_pylist() for p in parts] == [[1, 2, 3], [4], [5, 6], [7]]
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts


def test_parts_compose_to_the_whole():
    rng = random.Random(1)
    for _ in range(400):
        rows = ["(" + ",".join(rng.choice(["1", "'a''b'", '"x\'(y"', "f(g(1,'2)'))", "'l1\nl2'", "NULL"]) for _ in range(rng.randint(1, 4))) + ")" for _ in range(rng.randint(1, 8))]
        text = ",\n".join(rows) + rng.choice(["", ";", " ON DUPLICATE KEY UPDATE a = VALUES(a);", ")(1)", "\n,(2"])
        lines = text.split("\n")
        cuts = sorted(rng.sample(range(1, len(lines)), min(len(lines) - 1, rng.randint(0, 4))))
        parts = ["\n".join(lines[a:b]) for a, b in zip([0, *cuts], [*cuts, len(lines)])]
        state, depth, over, found, open_text, after = 0, 0, False, [], None, []
        for part in parts:
            raw = part.encode()
            lead, whole, opened, rest = (b"", b"", b"", raw) if over else cut_part(raw, state, depth)
            if lead:
                open_text += b"\n" + lead
            if whole or opened or rest:
                if open_text is not None:
                    found.append(open_text)
                open_text = opened or None
            found += [whole] if whole else []
            after += [rest] if rest else []
            if not over:
                state, depth, over = advance(summarise(raw), state, depth)
        found += [open_text] if open_text is not None else []
        got = [t for f in found for t in one_by_one(f.decode())[0]]
        want, tail = one_by_one(text)
        assert got == want, (text, parts)
        if tail.strip(BLANKS + ","):
            assert over or open_text is not None


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


ROWS = [f"({i}, 'text {i} (it''s), \\' \"', f(g({i}, ')')))" for i in range(1, 101)]


@pytest.mark.parametrize("row_bytes", [300, 700])
def test_one_insert_in_many_parts(spark, dump, small_splits, row_bytes):
    deep = "(" * 40 + "7" + ")" * 40
    long = "'" + "line of one long value;\n(" * 200 + "'"
    text = ("CREATE TABLE t (a INT PRIMARY KEY, b TEXT, c TEXT);\nINSERT INTO t VALUES (0, 'first', 1);\nINSERT INTO t (a, b, c) VALUES\n" + ",\n".join(ROWS)
            + f",\n(101, {long}, 'x'),\n(102, {deep}, '')\nON DUPLICATE KEY UPDATE b = VALUES(b);\nINSERT INTO t VALUES (-1, 'last', 1);\nINSERT INTO t SELECT\n" + "1,\n" * 400 + "2;\n")
    lines = read_lines(spark, dump(a__sql=text))
    whole, parts = split_statements(lines), split_statements(lines, row_bytes=row_bytes)
    assert parts.statements.filter("part > 0").count() > 5
    want = [tuple(r) for r in insert_tuples(whole.statements).orderBy("pos", "item").collect()]
    assert len(want) == 104 and [r.items for r in insert_tuples(whole.statements).filter("item = 101").collect()][0][1].strip() == deep
    assert [tuple(r) for r in insert_tuples(parts.statements).orderBy("pos", "item").collect()] == want
    loaded = load_dump(parts)
    assert loaded.tables["t"].count() == 104
    assert [(r.table, r.reason) for r in loaded.rejects.collect()] == [(None, "no VALUES list")]


def test_a_list_in_parts_that_stays_open(spark, dump, small_splits):
    text = "INSERT INTO t VALUES\n" + ",\n".join(ROWS[:50]) + ",\n(51, 'open\n" + "x\n" * 100
    split = split_statements(read_lines(spark, dump(a__sql=text)), row_bytes=300)
    assert insert_tuples(split.statements).count() == 50
    got = [(r.table, r.reason) for r in rejects(split.statements, {"t": T.StructType().add("a", "integer").add("b", "string").add("c", "string")}).collect()]
    assert got == [("t", "unread text after the values")]


def test_tables_and_columns_that_the_dump_does_not_create(spark, dump):
    text = ("CREATE TABLE t (id INT, name TEXT);\nINSERT INTO t (id, nope) VALUES (1, 'a'), (2, 'b');\nINSERT INTO t (name) VALUES ('only'), ('two', 'values');\n"
            "INSERT INTO u VALUES (1, 2), (3, 'x''y');\nINSERT INTO v (b, a) VALUES ('b1', 'a1');\nINSERT INTO v (a, c) VALUES ('a2', NULL);\nINSERT INTO v VALUES (1, 2, 3), (1, 2);\n")
    done = load_dump(split_statements(read_lines(spark, dump(a__sql=text))))
    rows = {n: sorted(map(str, map(tuple, df.collect()))) for n, df in done.tables.items()}
    assert rows == {"t": ["(None, 'only')"], "u": ["('1', '2')", '(\'3\', "x\'y")'], "v": ["('1', '2', '3')", "('b1', 'a1', None)", "(None, 'a2', None)"]}
    assert done.tables["u"].columns == ["col_1", "col_2"] and done.tables["v"].columns == ["b", "a", "c"]
    got = sorted((r["table"], str(r["column"]), r.reason) for r in done.rejects.collect())
    assert got == [("t", "None", "2 values for 1 columns"), ("t", "nope", "no such column"), ("t", "nope", "no such column"), ("v", "None", "2 values for 3 columns")]
    bare = rejects(split_statements(read_lines(spark, dump(a__sql=text))).statements, {"x": T.StructType().add("a", "string")}).collect()
    assert {(r["table"], r.reason) for r in bare} == {(t, "table without columns") for t in "tuv"} and len(bare) == 10


def test_load_rows_of_a_very_long_value(spark, dump):
    big = "x'(\\" * 300_000
    text = "INSERT INTO t VALUES (1, '" + big.replace("\\", "\\\\").replace("'", "\\'") + "');\n"
    split = split_statements(read_lines(spark, dump(a__sql=text)))
    assert load_rows(split.statements, "t", T.StructType().add("a", "integer").add("b", "string")).first().b == big


def test_tuples_of_a_list_in_parts_do_not_gather_at_its_head(spark, dump, small_splits):
    text = "INSERT INTO t VALUES\n" + ",\n".join(ROWS) + ";\nINSERT INTO u SELECT\n" + "1,\n" * 400 + "2;\nINSERT INTO v VALUES\n(f(\n" + "1,\n" * 400
    lists = value_lists(split_statements(read_lines(spark, dump(a__sql=text)), row_bytes=300).statements)
    assert "LeftOuter" not in lists._jdf.queryExecution().optimizedPlan().toString()
    got = lists.groupBy("table").agg(F.sum(F.size("tuples")).alias("n"), F.count_if("head").alias("heads"), F.count("after").alias("afters"))
    assert {(r["table"], r.n, r.heads) for r in got.collect()} == {("t", 100, 1), (None, 0, 1), ("v", 0, 1)}


def test_keys_are_resolved_from_rows_that_are_read_once(spark, dump):
    text = "CREATE TABLE t (a INT PRIMARY KEY, b TEXT);\n" + "".join(f"INSERT IGNORE INTO t VALUES ({k}, 'x{i}');\n" for i, k in enumerate([1, 2, 1, "NULL", "NULL"]))
    rows = load_table(split_statements(read_lines(spark, dump(a__sql=text))), "t")
    assert "MapInArrow" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, map(tuple, rows.collect()))) == ["(1, 'x0')", "(2, 'x1')", "(None, 'x3')", "(None, 'x4')"]
