import random

import pytest
from pyspark.sql import functions as F

from dumplake.operators import batches
from dumplake.operators.batches import BatchOptions, assign_batches, assign_runs, batch_stats, bucket_runs, commit_groups, file_sizes, gather
from dumplake.operators.inserts import analyse_inserts
from dumplake.sources.render import statement_lines
from dumplake.operators.statements import split_statements
from dumplake.plans.jobs import batch_statements


def statements(spark, texts, bucket_rows=7):
    rows = [("f", i // bucket_rows, i + 1, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "file string, bucket long, pos long, text string")


def greedy(texts, size, cap):
    """One statement at a time, as the rule is stated."""
    out, batch, n, total = [], None, 0, 0
    for t in texts:
        head, found, values = t.partition(" VALUES ")
        if not found or not t.startswith("INSERT") or "),(" in values:
            if batch:
                out.append(batch)
            batch = None
            out.append(t)
            continue
        if n < 100:
            n, total = n + 1, total + len(values)
        mean = int(total / n + 0.5)
        limit = max(1, min(size, cap // (mean + 2)))
        if batch and (batch[0] != head or len(batch[1]) >= limit or sum(len(v) + 2 for v in batch[1]) + len(values) + 2 > cap):
            out.append(batch)
            batch = None
        batch = batch or (head, [])
        batch[1].append(values)
    if batch:
        out.append(batch)
    return [b if isinstance(b, str) else f"{b[0]} VALUES {', '.join(b[1])};" for b in out]


@pytest.mark.parametrize("seed,size,cap,chunk", [(1, 5, 10**6, 500), (2, 8, 120, 500), (3, 40, 300, 64), (4, 3, 40, 50), (5, 60, 2000, 128)])
def test_batches_match_greedy_rule(spark, monkeypatch, seed, size, cap, chunk):
    monkeypatch.setattr(batches, "WALK_ROWS", chunk)
    rng, texts = random.Random(seed), []
    while len(texts) < 900:
        table = rng.choice("abc")
        for _ in range(rng.choice([1, 2, 30, 300])):
            texts.append(f"INSERT INTO {table} VALUES ({'x' * rng.choice([1, 5, 20, 60])})")
        texts += rng.choice([[], ["UPDATE a SET b = 1"], ["INSERT INTO a VALUES (1),(2)"]])
    got = gather(assign_batches(analyse_inserts(statements(spark, texts, 37)), BatchOptions(size, cap)))
    assert [r.text for r in got.orderBy("pos").collect()] == greedy(texts, size, cap)


def test_row_over_the_byte_cap_stands_alone(spark):
    texts = ["INSERT INTO t VALUES (1)", f"INSERT INTO t VALUES ('{'x' * 500}')", "INSERT INTO t VALUES (2)"]
    got = gather(assign_batches(analyse_inserts(statements(spark, texts)), BatchOptions(10, 100)))
    assert [r.text for r in got.orderBy("pos").collect()] == greedy(texts, 10, 100)


def test_statistics(spark):
    texts = [f"INSERT INTO t VALUES ({i})" for i in range(15)] + ["INSERT INTO t VALUES (1),(2)"]
    done = batch_statements(statements(spark, texts), BatchOptions(5))
    row = batch_stats(done.output, done.per_file, done.options).first()
    assert (row.rows_batched, row.queries_executed, row.reduction_ratio, row.batch_efficiency) == (15, 3, 5.0, 0.8)
    assert row.extended_insert_count == 1 and row.effective_batch_size == 5


def test_ignore_and_plain_do_not_mix_and_zero_disables(spark):
    texts = ["INSERT INTO t VALUES (1)", "INSERT IGNORE INTO t VALUES (2)", "INSERT IGNORE INTO t VALUES (3)"]
    inserts = analyse_inserts(statements(spark, texts))
    got = gather(assign_batches(inserts)).orderBy("pos").collect()
    assert [r.text for r in got] == ["INSERT INTO t VALUES (1);", "INSERT IGNORE INTO t VALUES (2), (3);"]
    assert gather(assign_batches(inserts, BatchOptions(0))).count() == 3


def test_commit_groups(spark):
    texts = [f"UPDATE t SET a = {i}" for i in range(20)]
    done = batch_statements(statements(spark, texts))
    rows = commit_groups(done.output, 3).orderBy("pos").collect()
    assert [r.commit_group for r in rows] == [i // 3 for i in range(20)]


@pytest.mark.parametrize("text,kind,table,prefix", [
    ("INSERT INTO `a` VALUES (1)", "insert_single", "`a`", "INSERT INTO `a` VALUES"),
    ("insert into Db.T (x, y) values (1, 'a(b)') ;", "insert_single", "db.t", "insert into Db.T (x, y) VALUES"),
    ("INSERT t VALUES (1)", "insert_single", "t", "INSERT t VALUES"),
    ("INSERT IGNORE t VALUES (1)", "insert_single", "t", "INSERT IGNORE t VALUES"),
    ("INSERT INTO t VALUES (1), (2)", "insert_single", "t", "INSERT INTO t VALUES"),
    ("INSERT INTO t VALUES (1),(2)", "insert_extended", "t", "INSERT INTO t VALUES"),
    ("INSERT INTO t VALUES (1) ON DUPLICATE KEY UPDATE a=1", "other", None, None),
    ("INSERT INTO t VALUES ('a SELECT b')", "other", None, None),
    ("INSERT INTO t SET a = 1", "other", None, None),
    ("INSERT INTO `straße` VALUES (1)", "insert_single", "`stra", "INSERT INTO `straße` VALUES"),
    ("INSERT INTO t (`ß`) VALUES ('ß')", "insert_single", "t", "INSERT INTO t (`ß`) VALUES"),
    ("REPLACE INTO t VALUES (1)", "other", None, None),
    ("INSERT INTO t VALUES 1", "other", None, None),
])
def test_insert_forms(spark, text, kind, table, prefix):
    row = analyse_inserts(statements(spark, [text])).first()
    assert (row.kind, row.table, row.prefix) == (kind, table, prefix)


def test_runs_cross_blocks_of_a_scan(spark):
    rows = spark.range(1000).select(F.lit("d.sql").alias("file"), F.col("id").alias("ord"),
                                    F.concat(F.lit("INSERT INTO t VALUES ("), "id", F.lit(");")).alias("text"))
    split = split_statements(statement_lines(rows, per_block=30))
    inserts = analyse_inserts(split.statements)
    buckets = bucket_runs(inserts)
    assert buckets.count() > 20
    got = gather(assign_batches(inserts, BatchOptions(64), buckets, file_sizes(inserts, BatchOptions(64), buckets))).orderBy("pos").collect()
    assert [r.n_rows for r in got] == [64] * 15 + [40]


def test_rows_do_not_carry_the_sizes_of_their_file(spark):
    texts = [f"INSERT INTO t VALUES ('{'x' * (i % 50)}')" for i in range(300)]
    inserts = analyse_inserts(statements(spark, texts))
    buckets = bucket_runs(inserts)
    per_file = file_sizes(inserts, BatchOptions(5, 200), buckets)
    assert not per_file.first().by_count
    assert "early" not in assign_runs(inserts, buckets, per_file).columns


def test_one_run_over_many_chunks_is_not_one_task(spark, monkeypatch):
    monkeypatch.setattr(batches, "WALK_ROWS", 64)
    texts = [f"INSERT INTO t VALUES ('{'x' * (i % 50)}')" for i in range(700)]
    done = assign_batches(analyse_inserts(statements(spark, texts)), BatchOptions(5, 200))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.split("\n") if "Join Inner" in line and "run_start" in line and "home" not in line and "chunk" not in line] == []
    assert [r.text for r in gather(done).orderBy("pos").collect()] == greedy(texts, 5, 200)
