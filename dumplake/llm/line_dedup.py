"""Line dedup: winnowed line hashes find repeated runs of lines, and later copies of a run go.

A line is a line of the text or, as long lines are whole paragraphs in web text, a sentence of one. Lines
compare with their blanks folded. A gram is the shortest run of lines with ``gram_words`` words; of the
grams inside each shortest run with ``run_words`` words, the one with the smallest hash is a fingerprint. So any
two equal runs of ``run_words`` words share a fingerprint, and only places of fingerprints that occur twice go on. From each such
place the match is carried both ways, to every shortest run of ``run_words`` words that begins where the fingerprint
was the smallest, and to those that end behind it. Each of these runs is joined with its first place in the corpus (by id, then
position); where that lies earlier, its lines are marked. The runs that begin and those that end in an equal stretch cover it to its
last line, so every stretch of ``run_words`` words or more that stands earlier, in whatever document, is marked whole, and work
grows with the number of lines even where one line fills a text. Marked stretches are deleted.
A deleted line always stands earlier in the corpus, so the first copy of every line stays.

Defined results: a null text has no lines and stays null, an empty one stays empty; lines without a word neither match nor break a run; a very long
text is read whole, its runs dealt to many tasks; repeated
rows (same id and text) are one document and get one result; a null id comes before all ids; equal ids
with different texts are ordered by the hash of the text. An empty table gives no rows. Columns of the input stay, except those that an output of
the same name replaces.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumplake.llm.frames import join_hot, keyed, mix, powers, text_or_empty, without
from dumplake.session import stage

GRAM_WORDS = 25
RUN_WORDS = 50
_BREAK = re.compile(r"((?<=[.!?]) |\n)")
_BLANKS = re.compile(r"[^\S \n]|  ")


def split_lines(text: str) -> list[str]:
    """Lines and what separates them, in turn; joined they are the text."""
    return _BREAK.split(text)


def line_numbers(text: str) -> tuple[list[int], list[int], list[int]]:
    """Of every line with a word: its place among the lines, a 64-bit hash, and its number of words."""
    at, hashes, words = [], [], []
    digest, plain = xxhash.xxh3_64_intdigest, not _BLANKS.search(text)
    for end in ".!?":
        text = text.replace(end + " ", end + "\n")
    for i, line in enumerate(text.split("\n")):
        if plain:  # only single spaces: no need to look at every word
            line = line.strip()
            if line:
                at.append(i)
                hashes.append(digest(line))
                words.append(line.count(" ") + 1)
        elif found := line.split():
            at.append(i)
            hashes.append(digest(" ".join(found)))
            words.append(len(found))
    return at, hashes, words


def _ends(total: np.ndarray, least: int) -> np.ndarray:
    """For every start the end of the shortest run with ``least`` words; past the last line if there is none."""
    return np.searchsorted(total, total[:-1] + least, side="left")


def fingerprints(hashes: np.ndarray, words: np.ndarray, gram_words: int, run_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the selected grams, their hashes, and for each shortest run with ``run_words`` words which of them it selected."""
    n = len(hashes)
    total = np.concatenate(([0], np.cumsum(words)))
    if total[-1] < run_words:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    gram_end, run_end = _ends(total, gram_words), _ends(total, run_words)
    starts = int((gram_end <= n).sum())
    grams = _run_hashes(hashes, np.arange(starts), gram_end[:starts])
    # The last gram that ends inside the run that starts at each line.
    last = np.searchsorted(gram_end[:starts], run_end[: int((run_end <= n).sum())], side="right").tolist()
    value, picked, front, done = grams.tolist(), [-1], 0, 0
    selected: list[int] = []
    held: list[int] = []  # starts whose hashes rise, the first is the minimum of the window
    for i, upto in enumerate(last):
        while done < upto:
            while len(held) > front and value[held[-1]] >= value[done]:
                held.pop()
            held.append(done)
            done += 1
        while held[front] < i:
            front += 1
        # Of equal minima the one already picked stays, so a line repeated many times gives few fingerprints.
        if picked[-1] < i or value[picked[-1]] != value[held[front]]:
            picked.append(held[front])
        selected.append(len(picked) - 2)
    at = np.array(picked[1:], np.int64)
    return at, grams[at], np.array(selected, np.int64)


def _run_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each run of lines, the same wherever it stands."""
    up, down = powers(len(hashes) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shortest_runs(words: np.ndarray, run_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs with ``run_words`` words that get shorter than that without their first or without their last line."""
    total = np.concatenate(([0], np.cumsum(words)))
    ends = _ends(total, run_words)
    ends = ends[ends <= len(words)]
    if not len(ends):
        return ends, ends
    # Ends behind the first possible one belong to the last start from which the words still suffice.
    many = np.maximum(np.append(ends[1:], len(words) + 1) - ends, 1)
    start = np.repeat(np.arange(len(ends)), many)
    return start, ends[start] + np.arange(len(start)) - (np.cumsum(many) - many)[start]


def _lines(gram_words: int, run_words: int):
    def run(batches):
        for pdf in batches:
            out = {"fp": [], "lo": [], "n": [], "h": [], "a": [], "b": []}
            for text in pdf["text"]:
                _, hashes, words = line_numbers(text)
                h, w = np.array(hashes, np.uint64), np.array(words, np.int64)
                _, fp, selected = fingerprints(h, w, gram_words, run_words)
                start, end = shortest_runs(w, run_words)
                runs = _run_hashes(h, start, end) if len(start) else np.empty(0, np.uint64)
                bounds = np.searchsorted(selected[start] if len(start) else start, np.arange(len(fp) + 1))
                for name, x in (("fp", fp.view(np.int64)), ("lo", bounds[:-1]), ("n", np.diff(bounds)), ("h", runs.view(np.int64)), ("a", start), ("b", end)):
                    out[name].append(x)
            yield pd.DataFrame({"_k1": pdf["_k1"], "_k2": pdf["_k2"], **out})

    return run


def repeated_runs(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """``_k1, _k2, _runs`` for documents with lines that stand earlier: starts and ends of runs, by word-bearing line, flattened."""
    texts = keyed(docs).select("_k1", "_k2", text_or_empty().alias("text"))
    lines = stage(texts.mapInPandas(
        _lines(gram_words, run_words), "_k1 long, _k2 long, fp array<long>, lo array<int>, n array<int>, h array<long>, a array<int>, b array<int>"), "lines")
    prints = lines.select("_k1", "_k2", F.expr("inline(arrays_zip(fp, lo, n))"), "h", "a", "b")
    prints = prints.selectExpr("_k1", "_k2", "fp", "lo", *[f"slice({c}, lo + 1, n) AS {c}" for c in ("h", "a", "b")])
    place = F.struct("_k1", "_k2", "lo")
    narrow = lines.select("_k1", "_k2", F.expr("inline(arrays_zip(fp, lo))"))
    shared = narrow.groupBy("fp").agg(F.min(place).alias("f"), F.max(place).alias("l"), F.count("*").alias("n")).where("f != l").select("fp", "n")
    runs = join_hot(prints, stage(shared, "line-prints"), "fp").select("_k1", "_k2", F.expr("inline(arrays_zip(h, a, b))"))
    runs = stage(runs, "line-runs")
    first = runs.groupBy("h").agg(F.min(F.struct("_k1", "_k2", "a")).alias("f"), F.max(F.struct("_k1", "_k2", "a")).alias("l"), F.count("*").alias("n"))
    first = stage(first.where("f != l").select("h", "f", "n"), "line-firsts")
    later = join_hot(runs, first, "h").where(F.struct("_k1", "_k2", "a") != F.col("f"))
    return later.groupBy("_k1", "_k2").agg(F.flatten(F.collect_set(F.array("a", "b"))).alias("_runs"))


def _delete(run_words: int):
    def cut(text: str | None, runs) -> tuple[str | None, int, int]:
        if text is None or runs is None or not len(runs):
            return text, 0, 0
        at, _, words = line_numbers(text)
        marked = np.zeros(len(at) + 2, np.int8)
        for a, b in zip(runs[::2], runs[1::2]):
            marked[a + 1 : b + 1] = 1
        edge, total = np.diff(marked), np.concatenate(([0], np.cumsum(words)))
        gone = [(a, b) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)) if total[b] - total[a] >= run_words]
        if not gone:
            return text, 0, 0
        parts, drop = split_lines(text), set()
        for a, b in gone:
            drop.update(at[a:b])
        kept = "".join(parts[2 * i] + (parts[2 * i + 1] if 2 * i + 1 < len(parts) else "") for i in range((len(parts) + 1) // 2) if i not in drop)
        return kept, len(drop), sum(int(total[b] - total[a]) for a, b in gone)

    @F.pandas_udf("text string, n_deleted long, words_deleted long")
    def delete(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut(t, r) for t, r in zip(texts, runs)], columns=["text", "n_deleted", "words_deleted"])

    return delete


def dedup_lines(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs cut from ``text``, ``n_deleted`` lines and ``words_deleted``.

    The texts are shuffled once, to meet their marks; all else moves line hashes only.
    """
    runs = repeated_runs(docs, gram_words, run_words)
    rows = keyed(without(docs, "n_deleted", "words_deleted")).join(runs, ["_k1", "_k2"], "left")
    out = rows.withColumn("_cut", _delete(run_words)(F.when(F.col("_runs").isNotNull(), F.col("text")), "_runs"))
    whole = [c for c in docs.columns if c.lower() not in ("n_deleted", "words_deleted")]
    return out.select(
        *[F.when(F.col("_runs").isNotNull(), F.col("_cut.text")).otherwise(F.col("text")).alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in whole],
        F.col("_cut.n_deleted").alias("n_deleted"), F.col("_cut.words_deleted").alias("words_deleted"))
