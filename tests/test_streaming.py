import os
import random

import pytest
from sequential import split

from dumplake.operators.progress import progress
from dumplake.snapshots import publish, published
from dumplake.streaming.ingest import (
    ProgressLog, chunk_stream, drop_and_restart, forget, ingest_dumps, live_statistics, observed, split_stream, stream_log)

TEXT = "SELECT 1;\n" + "".join(f"INSERT INTO t VALUES ({i}, 'it''s\n; -- {i}\n');\n-- note\n" for i in range(60)) + "DELIMITER //\nA;\nB//\nSELECT 'é'//\nCOMMIT"


def write(folder, name, text, cuts):
    data, at = text.encode(), 0
    files = []
    for k, cut in enumerate([*cuts, len(data)]):
        last = ".last" if k == len(cuts) else ""
        files.append((os.path.join(folder, f"{name}.{k}{last}.chunk"), data[at:cut]))
        at = cut
    return files


def run(spark, source, out, check, **kw):
    found = split_stream(chunk_stream(spark, source, max_files=3), **kw)
    job = found.writeStream.format("parquet").option("checkpointLocation", check).option("path", out)
    job.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).orderBy("dump_id", "pos").collect()


def test_chunks_out_of_order_and_resumed(spark, folder):
    source, out, check = (os.path.join(folder, n) for n in ("in", "out", "check"))
    os.mkdir(source)
    rng = random.Random(5)
    files = write(source, "d", TEXT, sorted(rng.sample(range(1, len(TEXT.encode())), 9)))
    rng.shuffle(files)
    for path, data in files[:6]:
        open(path, "wb").write(data)
    run(spark, source, out, check)
    for path, data in files[6:]:
        open(path, "wb").write(data)
    rows = run(spark, source, out, check)
    want, tail, _ = split(TEXT)
    assert [(r.pos, r.text) for r in rows if not r.is_tail] == want
    assert [r.text for r in rows if r.is_tail] == [tail]


def test_limits_in_the_stream_label_only(spark, folder):
    source, out, check = (os.path.join(folder, n) for n in ("in", "out", "check"))
    os.mkdir(source)
    text = "SELECT 1;\nx\n" + "y\n" * 9 + ";\nSELECT 2;\n"
    for path, data in write(source, "d", text, [15]):
        open(path, "wb").write(data)
    rows = run(spark, source, out, check, max_lines=5)
    want, _, _ = split(text)
    assert [(r.pos, r.text) for r in rows] == want
    assert [r.pos for r in rows if r.error] == [2]


def test_a_lost_chunk_ends_in_an_error_row(spark, folder):
    source, out, check = (os.path.join(folder, n) for n in ("in", "out", "check"))
    os.mkdir(source)
    start = 1_700_000_000

    def put(files, at):
        for path, data in files:
            open(path, "wb").write(data)
            os.utime(path, (at, at))

    whole = write(source, "ok", TEXT, [50, 400])
    lost = write(source, "lost", "SELECT 1;\nSELECT '2\n" + "x\n" * 50 + "';\nSELECT 3;\n", [20, 60, 90])
    put([*whole[:2], lost[0], lost[2], lost[3]], start)
    rows = run(spark, source, out, check, wait="2 hours")
    assert [r.text for r in rows if r.dump_id == "lost"] == ["SELECT 1"] and not [r for r in rows if r.error]
    put(whole[2:], start + 3600)
    assert not [r for r in run(spark, source, out, check, wait="2 hours") if r.error]
    put(write(source, "late", "SELECT 'late';\n", []), start + 3 * 3600)
    put(write(source, "later", "SELECT 'later';\n", []), start + 3 * 3600 + 1)
    rows = run(spark, source, out, check, wait="2 hours")
    assert [(r.dump_id, r.seq, r.pos, r.error) for r in rows if r.error] == [("lost", 1, 2, "Chunk 1 did not arrive in time; 2 later chunks were not read")]
    want, _, _ = split(TEXT)
    assert [(r.pos, r.text) for r in rows if r.dump_id == "ok" and not r.is_tail] == want
    for name in ("reader", "held"):
        state = spark.read.format("statestore").option("stateVarName", name).load(check)
        assert state.count() == 0


def test_tails_and_open_strings_in_the_stream(spark, folder):
    source, out, check = (os.path.join(folder, n) for n in ("in", "out", "check"))
    os.mkdir(source)
    for name, text in (("a", "SELECT 1;\nnot sql"), ("b", "SELECT 1;\nINSERT 'open"), ("c", "SELECT 1;\n'open"), ("d", "SELECT 1;\nCOMMIT")):
        for path, data in write(source, name, text, [12]):
            open(path, "wb").write(data)
    rows = run(spark, source, out, check)
    tails = [(r.dump_id, r.text, bool(r.error)) for r in rows if r.is_tail]
    assert tails == [("b", "INSERT 'open", True), ("c", None, True), ("d", "COMMIT", False)]


def test_a_failure_between_write_and_commit_doubles_nothing(spark, folder):
    source, out, check = (os.path.join(folder, n) for n in ("in", "out", "check"))
    os.mkdir(source)
    rng = random.Random(6)
    for name in "ab":
        for path, data in write(source, name, TEXT, sorted(rng.sample(range(1, len(TEXT.encode())), 7))):
            open(path, "wb").write(data)
    failed = []

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == 2 and not failed:
            failed.append(number)
            raise RuntimeError("stopped after the write")

    def once():
        found = split_stream(chunk_stream(spark, source, max_files=3))
        return found.writeStream.foreachBatch(sink).option("checkpointLocation", check).trigger(availableNow=True).start()

    with pytest.raises(Exception):
        once().awaitTermination()
    once().awaitTermination()
    want, _, _ = split(TEXT)
    rows = spark.read.parquet(out).orderBy("dump_id", "pos").collect()
    assert failed and [(r.dump_id, r.pos, r.text) for r in rows if not r.is_tail] == [(d, *w) for d in "ab" for w in want]


def test_counts_follow_the_splitter_in_one_query(spark, folder):
    source, check = (os.path.join(folder, n) for n in ("in", "check"))
    os.mkdir(source)
    for path, data in write(source, "a", TEXT, [100, 900, 1500]):
        open(path, "wb").write(data)
    seen = []
    found = live_statistics(split_stream(chunk_stream(spark, source, max_files=2)))
    found.writeStream.foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    want, tail, _ = split(TEXT)
    last = max(seen, key=lambda r: r.queries)
    assert last.queries == len(want) + 1 and last.inserts == 60 and last.lines == TEXT.count("\n") + 1 and last.errors == 0
    assert last.bytes == sum(len(t.encode()) for _, t in want) + len(tail) and len(seen) == 2


def test_arriving_dumps_are_split_once(spark, folder):
    source, target, check = (os.path.join(folder, n) for n in ("in", "out", "check"))
    os.mkdir(source)
    for n in range(3):
        open(os.path.join(source, f"{n}.sql"), "w").write(TEXT)
    ingest_dumps(spark, source, target, check, max_files=2).awaitTermination()
    open(os.path.join(source, "late.sql"), "w").write("SELECT 'late';\n")
    ingest_dumps(spark, source, target, check, max_files=2).awaitTermination()
    want, _, _ = split(TEXT)
    rows = spark.read.parquet(f"{target}/statements")
    assert rows.filter("text = \"SELECT 'late'\"").count() == 1
    assert rows.filter("not is_tail").count() == 3 * len(want) + 1
    log = spark.read.parquet(f"{target}/progress").collect()
    assert len(log) == 4 and all(r.finished and r.file_size == r.bytes for r in log)
    assert spark.read.parquet(f"{target}/rejects").count() == 0
    assert forget(spark, check) and not os.path.exists(check)


def test_the_log_of_a_stopped_and_resumed_stream(spark, folder):
    source, out, check, log = (os.path.join(folder, n) for n in ("in", "out", "check", "log"))
    os.mkdir(source)
    files = write(source, "a", TEXT, [100, 900, 1500])

    def run():
        events = ProgressLog(spark, log, "chunks_of_a")
        found = observed(chunk_stream(spark, source, max_files=1), split_stream)
        job = found.writeStream.queryName("chunks_of_a").format("parquet").option("checkpointLocation", check).option("path", out)
        job.trigger(availableNow=True).start().awaitTermination()
        events.wait()

    for path, data in files[:2]:
        open(path, "wb").write(data)
    run()
    size = len(TEXT.encode())
    rows = progress(stream_log(spark, log, size)).orderBy("seq").collect()
    assert [(r.bytes_done, r.finished) for r in rows] == [(100, False), (900, False)] and rows[1].bytes_this == 800
    for path, data in files[2:]:
        open(path, "wb").write(data)
    run()
    want, tail, _ = split(TEXT)
    rows = progress(stream_log(spark, log, size)).orderBy("seq").collect()
    assert [r.bytes_done for r in rows][::3] == [100, size] and rows[2].bytes_done in (1500, 900 + size - 1500) and [r.finished for r in rows] == [False] * 3 + [True]
    assert rows[2].bytes_this == 0 and rows[3].bytes_this == size - rows[2].bytes_done and rows[3].queries_done == len(want) + 1 and rows[3].lines_done == TEXT.count("\n") and rows[3].pct_done == 100
    publish({"t": spark.range(3), "other": spark.range(1)}, f"{folder}/tables")
    assert drop_and_restart(spark, f"{folder}/tables", ["t", "u"], check) == ["t"] and list(published(spark, f"{folder}/tables")) == ["other"]
    assert not os.path.exists(check)
