import os
import random
import re

import pytest

from dumplake.operators.load import load_rows
from dumplake.operators.profile import BULK_INSERT, CREATE_TABLE, DEAD, FOUND, BulkInserts, CreatedTables, _Block, created_tables_raw, profile_files
from dumplake.operators.statements import accepted, split_statements
from dumplake.plans.jobs import optimise
from dumplake.sources.lines import read_lines
from pyspark.sql import types as T

WORDS = {
    BulkInserts: ["INSERT", "insert", "INTO", "t", "VALUES", "values", "(", ")", "(1)", "('a')", ",", ";", "t(", "()"],
    CreatedTables: ["CREATE", "create", "TABLE", "IF", "if", "NOT", "EXISTS", "t1", "`t2`", "'t3", "_x", "(", "(", "1a", "é", "`IF`", ";"],
}


def whole(pattern, text):
    """Line and name of each match of the pattern in the whole text."""
    return {(text.count("\n", 0, m.start()) + 1, m[1] if m.re.groups else None) for m in re.finditer(pattern, text, re.ASCII)}


def in_blocks(machine, blocks):
    """The same block by block and chunk by chunk, as the two passes do it."""
    found, alive, line = set(), {}, 1
    for chunks in blocks:
        block = _Block(machine)
        for chunk in chunks:
            block.read(chunk.encode(), line)
            line += chunk.count("\n")
        found |= set(block.found)
        after = dict(block.own)
        for place, (first, name) in alive.items():
            now, named = block.entered[place]
            if now == FOUND:
                found.add((first, named or name))
            elif now != DEAD and first < after.get(now, (first + 1,))[0]:
                after[now] = (first, named or name)
        alive = after
    return found


@pytest.mark.parametrize("kind, pattern", [(BulkInserts, BULK_INSERT), (CreatedTables, CREATE_TABLE)])
def test_blocks_like_the_whole_text(kind, pattern):
    rng, machine = random.Random(2), kind()
    for _ in range(4000):
        lines = []
        for _ in range(rng.randint(1, 12)):
            lines.append("".join(rng.choice(WORDS[kind][: rng.choice([6, 99])]) + rng.choice([" ", " ", "", "  "]) for _ in range(rng.randint(0, 4))) + "\n")
        blocks, at = [], 0
        while at < len(lines):
            chunks = []
            for _ in range(rng.randint(1, 3)):
                step = rng.randint(1, 3)
                chunks.append("".join(lines[at : at + step]))
                at += step
            blocks.append(chunks)
        text = "".join(lines)
        want, got = whole(pattern, text), in_blocks(machine, blocks)
        if machine.once:
            assert bool(want) == bool(got), text
        else:
            assert want <= got and {n for _, n in want} == {n for _, n in got}, text


def test_very_many_open_starts_are_linear():
    block = _Block(BulkInserts())
    block.read(b"INSERT INTO t VALUES (\n" * 300_000, 1)
    assert set(block.own) == {7} and not block.found


@pytest.mark.parametrize("n", [3, 12_000])
def test_a_tuple_over_very_many_lines(spark, dump, n):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        text = "INSERT INTO t VALUES ('" + "some text of a line, forty bytes long ..\n" * n + "'), ('b');\n"
        path = dump(a__sql=text, b__sql=text.replace("), (", ");\n-- ("))
        got = {os.path.basename(r.file): r.is_bulk_insert for r in profile_files(read_lines(spark, path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {"a.sql": True, "b.sql": False}


@pytest.mark.parametrize("split", ["100", "1m"])
def test_bytes_that_are_no_utf8(spark, dump, split):
    rows = b"".join(b"INSERT INTO t VALUES (%d, 'caf\xe9 \xff\nsecond \xe9 line');\n" % i for i in range(60))
    text = b"-- caf\xe9\nCREATE TABLE\nt (id INT,\n name TEXT);\nDELIMITER //\nSELECT '\xe9'//\nDELIMITER ;\n" + rows + b"INSERT INTO t VALUES (60, '\xe9'), (61, 'x');\n"
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = dump(a__sql=text)
        lines = read_lines(spark, path)
        assert profile_files(lines).first().is_bulk_insert
        assert [(r.table_name, r.first_pos) for r in created_tables_raw(lines).collect()] == [("t", 2)]
        statements = accepted(split_statements(lines).statements)
        schema = T.StructType().add("id", "integer").add("name", "binary")
        got = {r.id: bytes(r.name) for r in load_rows(statements, "t", schema).collect()}
        assert got == {**{i: b"caf\xe9 \xff\nsecond \xe9 line" for i in range(60)}, 60: b"\xe9", 61: b"x"}
        assert optimise(lines).output.count() > 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
