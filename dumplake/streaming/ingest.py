"""Continuous ingest: whole dumps as they arrive, and dumps that arrive in chunks."""

from __future__ import annotations

import json
import re
import threading

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..functions.text import TAIL_KEYWORDS, TRIM, classify_line, without_bom
from ..operators.load import rejects
from ..operators.scan import ScanOptions
from ..operators.statements import OVER_BYTES, OVER_LINES, ROW_BYTES, UNCLOSED, accepted, split_statements
from ..session import stage_scope
from ..snapshots import put_once, withdraw
from ..sources.lines import read_lines

CHUNKS = "dump_id string, seq long, is_last boolean, data binary"

# Chunk files are named <dump>.<number>.chunk, the last one <dump>.<number>.last.chunk.
_CHUNK_NAME = r"([^/]+)\.(\d+)(\.last)?\.chunk$"


def arriving_files(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of the paths and sizes of dump files as they appear."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files)
    return stream.option("recursiveFileLookup", "true").load(path).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def ingest_dumps(spark: SparkSession, path: str, target: str, checkpoint: str, options: ScanOptions = ScanOptions(),
                 max_files: int = 100, available_now: bool = True) -> StreamingQuery:
    """Split each arriving dump with the batch scan and append its statements to ``target``.

    A batch names its output by its number and replaces it if it is repeated, so a restart
    on the same checkpoint neither loses nor doubles statements. Each batch also leaves one
    progress row per file in ``target``/progress.
    """

    def load(batch: DataFrame, number: int) -> None:
        with stage_scope(batch.sparkSession):
            _load(batch, number)

    def _load(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        paths = [r.path for r in batch.select("path").collect()]
        if not paths:
            return
        split = split_statements(read_lines(session, paths), options)
        kept = accepted(split.statements, options.dialect)
        kept.write.mode("overwrite").parquet(f"{target}/statements/batch={number}")
        counts = kept.groupBy("file").agg(F.count("*").alias("queries"))
        sizes = batch.select(F.regexp_replace("path", "^file:/+", "file:///").alias("file"), "size")
        log = split.files.withColumn("file", F.regexp_replace("file", "^file:/+", "file:///")).join(sizes, "file", "left").join(
            counts.withColumn("file", F.regexp_replace("file", "^file:/+", "file:///")), "file", "left").select(
            F.col("file").alias("import_id"), F.lit(number).cast("long").alias("run_id"), F.lit(1).cast("long").alias("seq"),
            F.current_timestamp().alias("ts"), F.col("size").alias("file_size"), F.col("n_lines").alias("lines"),
            F.coalesce("queries", F.lit(0)).cast("long").alias("queries"), F.col("size").alias("bytes"),
            (~F.col("unclosed_string")).alias("finished"), F.col("file").endswith(".gz").alias("is_gzip"),
        )
        log.write.mode("overwrite").parquet(f"{target}/progress/batch={number}")
        rejected = rejects(split.statements.filter("not is_tail or like_sql"), {})
        rejected.write.mode("overwrite").parquet(f"{target}/rejects/batch={number}")

    writer = arriving_files(spark, path, max_files).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def chunk_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Chunk files as a stream of (dump_id, seq, is_last, data, arrived); one chunk is one row."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).load(path)
    return raw.select(
        F.regexp_extract("path", _CHUNK_NAME, 1).alias("dump_id"),
        F.regexp_extract("path", _CHUNK_NAME, 2).cast("long").alias("seq"),
        (F.regexp_extract("path", _CHUNK_NAME, 3) != "").alias("is_last"), F.col("content").alias("data"),
        F.col("modificationTime").alias("arrived"),
    )


_STATE = (
    "next_seq long, quote int, delimiter string, partial binary, pending string, first_line long, line_no long, "
    "counted int, statements long, bytes long"
)
_OUT = "dump_id string, seq long, pos long, last_line long, text string, is_tail boolean, error string"


# Label of a stretch of a statement that is too long to be kept open whole; the stretch after it goes on.
IN_PARTS = "Part of a statement that is too long for one row"


class _Reader:
    """The resumable part of reading one dump: what is saved between chunks."""

    def __init__(self, options: ScanOptions, saved: tuple | None, max_lines: int | None, max_bytes: int | None, row_bytes: int = ROW_BYTES):
        self.options, self.max_lines, self.max_bytes, self.row_bytes = options, max_lines, max_bytes, row_bytes
        start = (0, 0, options.delimiter, b"", "", 0, 0, 0, 0, 0)
        (self.next_seq, self.quote, self.delimiter, partial, pending, self.first_line, self.line_no, self.counted,
         self.statements, self.bytes) = saved or start
        self.partial = bytes(partial)
        self.open_lines = [pending] if pending else []
        self.open_bytes = len(pending.encode())

    def state(self) -> tuple:
        return (self.next_seq, self.quote, self.delimiter, self.partial, "".join(self.open_lines), self.first_line, self.line_no,
                self.counted, self.statements, self.bytes)

    def _clear(self) -> None:
        self.open_lines, self.open_bytes, self.first_line, self.counted = [], 0, 0, 0

    def _finish(self, tail: bool):
        text = "".join(self.open_lines).strip(TRIM)
        if text.endswith(self.delimiter):
            text = text[: -len(self.delimiter)].strip(TRIM)
        error = None
        if self.max_bytes is not None and self.open_bytes > self.max_bytes:
            error = OVER_BYTES % self.max_bytes
        elif self.max_lines is not None and self.counted > self.max_lines:
            error = OVER_LINES % self.max_lines
        found = (self.first_line, self.line_no, text, tail, error) if text not in ("", "0") else None
        self._clear()
        return found

    def _line(self, line: str):
        self.line_no += 1
        opts = self.options
        exits, dropped, directive = classify_line(line, opts.dialect, opts.strict_escapes, opts.markers)
        if self.quote == 0 and dropped:
            self.delimiter = directive or self.delimiter
            return None
        size = len(line.encode()) + 1
        self.first_line = self.first_line or self.line_no
        self.quote = exits[self.quote]
        self.open_lines.append(line + "\n")
        self.open_bytes += size
        self.counted += self.quote == 0
        if self.quote == 0 and line.rstrip(TRIM).endswith(self.delimiter):
            return self._finish(False)
        if self.open_bytes > self.row_bytes:
            part = (self.first_line, self.line_no, "".join(self.open_lines), False, IN_PARTS)
            self.open_lines, self.open_bytes, self.first_line = [], 0, 0
            return part
        return None

    def read(self, last: bool, data: bytes):
        """Take the chunk whose turn it is; yield its statements."""
        self.bytes += len(data)
        *lines, self.partial = (self.partial + data).split(b"\n")
        if last and self.partial:
            lines, self.partial = [*lines, self.partial], b""
        for raw in lines:
            raw = without_bom(raw) if self.line_no == 0 else raw
            text = (raw[:-1] if raw.endswith(b"\r") else raw).decode("utf-8", "replace")
            found = self._line(text.replace("\r\n", "\n").replace("\r", "\n"))
            if found:
                self.statements += 1
                yield found
        if last:
            unclosed = self.quote != 0
            found = self._finish(True) if self.open_lines else None
            # The tail of an import counts only if it starts like SQL; one that is no statement still shows an open string.
            if found and (self.options.dialect == "cli" or _LIKE_SQL.match(found[2])):
                self.statements += 1
                yield (*found[:4], UNCLOSED if unclosed else found[4])
            elif unclosed:
                yield (self.line_no, self.line_no, None, True, UNCLOSED)
        self.next_seq += 1


_LIKE_SQL = re.compile(rf"(?i)(?:{'|'.join(TAIL_KEYWORDS)}|/\*|--)")
# Fixed value: error of a dump with a chunk that did not come.
LOST = "Chunk %d did not arrive in time; %d later chunks were not read"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_state_store(spark: SparkSession) -> None:
    """Timers and several states per key need the RocksDB store; a session that chose its own keeps it."""
    if spark.conf.get(_PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKS)


class _Splitter(StatefulProcessor):
    """One dump: where its reading stands, chunks ahead of their turn one by one, and a timer until the last one came."""

    def __init__(self, options: ScanOptions, max_lines: int | None, max_bytes: int | None, wait_ms: int | None):
        self.options, self.max_lines, self.max_bytes, self.wait_ms = options, max_lines, max_bytes, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reader = handle.getValueState("reader", _STATE)
        self.held = handle.getMapState("held", "seq long", "is_last boolean, data binary, arrived timestamp")

    def _rows(self, found: list) -> pd.DataFrame:
        return pd.DataFrame(found, columns=["dump_id", "seq", "pos", "last_line", "text", "is_tail", "error", "arrived"])

    def _clear(self) -> None:
        self.reader.clear()
        self.held.clear()
        self._stop_waiting()

    def _stop_waiting(self) -> None:
        if self.wait_ms is not None:  # a query without time has no timers
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues):
        saved = self.reader.get() if self.reader.exists() else None
        reader = _Reader(self.options, tuple(saved) if saved else None, self.max_lines, self.max_bytes)
        given, latest, done = {}, None, False
        for frame in rows:
            for row in frame.itertuples(index=False):
                if int(row.seq) >= reader.next_seq:  # chunks already read are skipped
                    given[int(row.seq)] = (bool(row.is_last), bytes(row.data), row.arrived)
                    latest = row.arrived if latest is None else max(latest, row.arrived)
        out = []
        while not done:
            seq = reader.next_seq
            if seq in given:
                last, data, arrived = given.pop(seq)
            elif self.held.containsKey((seq,)):
                last, data, arrived = self.held.getValue((seq,))
                self.held.removeKey((seq,))
            else:
                break
            out += [(key[0], seq, *found, arrived) for found in reader.read(last, bytes(data))]
            done = last
        if done:
            self._clear()
        else:
            for seq, chunk in given.items():
                self.held.updateValue((seq,), chunk)
            self.reader.update(reader.state())
            if self.wait_ms is not None and latest is not None:
                self._stop_waiting()
                self.handle.registerTimer(int(pd.Timestamp(latest).timestamp() * 1000) + self.wait_ms)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        saved = self.reader.get() if self.reader.exists() else None
        reader = _Reader(self.options, tuple(saved) if saved else None, self.max_lines, self.max_bytes)
        held = list(self.held.iterator())
        arrived = max((v[2] for _, v in held), default=None)
        text = "".join(reader.open_lines) or None
        at = reader.first_line or reader.line_no
        self._clear()
        yield self._rows([(key[0], reader.next_seq, at, reader.line_no, text, True, LOST % (reader.next_seq, len(held)), arrived)])

    def close(self) -> None:
        pass


def split_stream(chunks: DataFrame, options: ScanOptions = ScanOptions(), max_lines: int | None = None,
                 max_bytes: int | None = None, wait: str | None = None) -> DataFrame:
    """Statements of chunked dumps; a chunk may end anywhere, also inside a line or a string.

    The state per dump is what a stopped load needs to go on: quote, delimiter, the open
    statement (handed on in labelled parts beyond ``ROW_BYTES``), line and byte counts. Limits given here label statements. Chunks ahead of their turn
    wait in the state, one entry each. Chunks already read are skipped, so repeats do no harm. After its last chunk a dump leaves no state.
    With ``wait`` (such as '2 hours') a dump with a missing chunk, its last one included, ends in an error row, with the statement it left open, once chunks of any dump
    arrived that much later; this needs a column ``arrived``. Without it such a dump waits on. The tail rules are those of the batch scan.
    """
    spark = chunks.sparkSession
    _with_state_store(spark)
    if "arrived" not in chunks.columns:
        chunks = chunks.withColumn("arrived", F.lit(None).cast("timestamp") if wait is None else F.current_timestamp())
    timed = wait is not None
    chunks = chunks.withWatermark("arrived", "0 seconds") if timed else chunks.withColumn("arrived", F.coalesce("arrived", F.timestamp_seconds(F.lit(0))))
    wait_ms = spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {wait})").first()[0] if timed else None
    found = chunks.groupBy("dump_id").transformWithStateInPandas(
        _Splitter(options, max_lines, max_bytes, wait_ms), _OUT + ", arrived timestamp", "Append", "EventTime" if timed else "None")
    return found.drop("arrived")


_COUNTS = "queries long, inserts long, bytes long, errors long, lines long"


class _Counter(StatefulProcessor):
    """Running counts of one dump."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", _COUNTS)

    def handleInputRows(self, key, rows, timerValues):
        queries, inserts, size, errors, lines = self.counts.get() if self.counts.exists() else (0, 0, 0, 0, 0)
        for frame in rows:
            texts = frame["text"].dropna()
            queries += len(texts)
            inserts += int(texts.str.match("(?i)INSERT").sum())
            size += int(texts.str.encode("utf-8").str.len().sum())
            errors += int(frame["error"].notna().sum())
            lines = max(lines, int(frame["last_line"].max()))
        now = (queries, inserts, size, errors, lines)
        self.counts.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["dump_id", "queries", "inserts", "bytes", "errors", "lines"])

    def close(self) -> None:
        pass


def live_statistics(statements: DataFrame) -> DataFrame:
    """Running counts per dump over a stream of statements: a row per dump and micro-batch that adds to it, the latest the highest.

    May follow ``split_stream`` in one query, so counts and statements share a checkpoint.
    """
    _with_state_store(statements.sparkSession)
    rows = statements.select("dump_id", "text", "error", "last_line")
    return rows.groupBy("dump_id").transformWithStateInPandas(_Counter(), "dump_id string, " + _COUNTS, "Append", "None")


def observed(chunks: DataFrame, found) -> DataFrame:
    """``found(chunks)``, with what a batch reads and writes counted on the way, for ``ProgressLog``."""
    text = F.decode("data", "ISO-8859-1")
    chunks = chunks.observe("chunks", F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"),
                            F.coalesce(F.sum(F.length(text) - F.length(F.translate(text, "\n", ""))), F.lit(0)).alias("lines"),
                            F.count("*").alias("chunks"), F.count_if("is_last").alias("dumps"),
                            F.coalesce(F.sum(F.when(F.col("is_last"), F.col("seq") + 1)), F.lit(0)).alias("awaited"))
    return found(chunks).observe("statements", F.count("text").alias("queries"), F.count("error").alias("errors"))


class ProgressLog(StreamingQueryListener):
    """Keeps one file per committed batch of an observed query under ``path``: what the batch read and found.

    A file is named by the number of its batch, so a batch that ran again after a failure is there once; a query that is
    stopped and started on its checkpoint goes on with the next number, under the same import. Make it before the
    query of this name starts; ``wait`` returns once the last event of the ended query is on disk.
    """

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        self._runs: set[str] = set()
        self._ended = threading.Event()
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self._runs.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        now = event.progress
        if str(now.runId) not in self._runs or not {"chunks", "statements"} <= set(now.observedMetrics):
            return
        row = {"import_id": self.name, "run_id": str(now.runId), "seq": now.batchId, "ts": now.timestamp}
        for metrics in ("chunks", "statements"):
            row |= now.observedMetrics[metrics].asDict()
        put_once(self.spark, f"{self.path}/{self.name}-{now.batchId:012d}.json", json.dumps(row))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self._runs:
            self._ended.set()

    def wait(self, timeout: float = 60) -> None:
        """Until the events of the ended query are written; then listen no more."""
        try:
            if not self._ended.wait(timeout):
                raise TimeoutError(f"no end of {self.name} was reported within {timeout} s")
        finally:
            self.spark.streams.removeListener(self)


_EVENTS = "import_id string, run_id string, seq long, ts timestamp, bytes long, lines long, chunks long, dumps long, awaited long, queries long, errors long"


def stream_log(spark: SparkSession, path: str, file_size: int | None = None, dumps: int = 1) -> DataFrame:
    """The log that ``progress``, ``with_speed`` and the other signals read, from the files of a ``ProgressLog``.

    A row per batch, with counts since the start of the import, so its windows hold one row per batch. ``file_size`` is the
    size of all its dumps, if known; an import is finished once the last chunks of its ``dumps`` and all before them are read,
    in any order (chunks that came twice count twice).
    """
    so_far = Window.partitionBy("import_id").orderBy("seq")
    rows = spark.read.schema(_EVENTS).json(path)
    return rows.select(
        "import_id", "run_id", "seq", "ts", F.lit(file_size).cast("long").alias("file_size"),
        *[F.sum(c).over(so_far).alias(c) for c in ("lines", "queries", "bytes", "errors")],
        ((F.sum("dumps").over(so_far) >= dumps) & (F.sum("chunks").over(so_far) >= F.sum("awaited").over(so_far))).alias("finished"), F.lit(False).alias("is_gzip"))


def drop_and_restart(spark: SparkSession, base: str, tables: list[str], checkpoint: str) -> list[str]:
    """Hide the tables that a failed load published, all at once, and forget how far it came; says which tables were there.

    ``tables`` are those the dump creates (``created_tables`` or ``created_tables_raw``); no others are touched. Stop the query first.
    """
    gone = withdraw(spark, base, tables)
    forget(spark, checkpoint)
    return gone


def forget(spark: SparkSession, checkpoint: str) -> bool:
    """Restart from the beginning: drop a checkpoint, so the next query reads all files again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
