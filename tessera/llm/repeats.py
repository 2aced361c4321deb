"""Substring dedup over word windows by level-wise doubling (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, materialize, release, require
from tessera.llm.words import inside, ragged_ranges, slices, split_words, text_of_word, window_hashes, word_hashes

#: A run of window starts as one long: the first start (32 bits: a text has fewer words), how many (16 bits), and in
#: the low bits 16 more of the text's hash, by which texts whose 64-bit keys are equal are told apart. Whole bytes compress better.
_COUNT_BITS, _MARK_BITS = 16, 16
_LOW, _MARKS = (1 << _COUNT_BITS) - 1, (1 << _MARK_BITS) - 1


def _packed(begins: np.ndarray, counts: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return (begins << (_COUNT_BITS + _MARK_BITS)) | (counts << _MARK_BITS) | marks


def _unpacked(runs: np.ndarray, mark: int | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first starts, counts, which runs have the mark)."""
    begins = (runs.view(np.uint64) >> np.uint64(_COUNT_BITS + _MARK_BITS)).view(np.int64)
    return begins, (runs >> _MARK_BITS) & _LOW, (runs & _MARKS) == mark


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_key, mark, id, text): a row's key in two parts, of 64 and 16 bits."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    mark = F.pmod(F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col)), F.lit(_MARKS + 1))
    return docs.select(key.alias("row_key"), mark.alias("mark"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def levels(window: int, first: int) -> list[int]:
    """Window lengths to check: from about `first` on each twice the last (or one
    less), up to `window` itself."""
    out = [window]
    while out[0] > first:
        out.insert(0, -(-out[0] // 2))
    return out


def _anchors(hashes: np.ndarray, owner: np.ndarray, length: int, window: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor positions, first start, number of starts). The anchor of a start is
    its leftmost sub-window of `length` with the smallest hash: equal windows have
    equal anchors, at the same place, and neighbouring starts mostly share theirs."""
    if length == window:
        starts = np.flatnonzero(alive)
        return starts, starts, np.ones(len(starts), dtype=np.int64)
    views = sliding_window_view(hashes, window - length + 1)
    starts = np.flatnonzero(alive)
    where = np.empty(len(starts), dtype=np.int64)
    for i in range(0, len(starts), 1 << 16):  # bounds what argmin copies
        some = starts[i : i + (1 << 16)]
        where[i : i + (1 << 16)] = some + np.argmin(views[some], axis=1)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)
    begins = np.flatnonzero(new)
    counts = np.diff(np.append(begins, len(starts)))
    return where[begins], starts[begins], counts


def _rows_at(length: int, window: int, narrowed: bool):
    """A mapInArrow function: (row_key, mark, text[, runs]) to (h, check, row_key, run) at one level."""
    last = length == window
    if window > _LOW:
        raise ValueError(f"windows of up to {_LOW} words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, words = split_words(part.column(2))
                marks = part.column(1).to_numpy(zero_copy_only=False)
                lanes = word_hashes(words)
                owner = text_of_word(offsets)
                alive = inside(owner, window)
                if narrowed:
                    lists = part.column(3)
                    of = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                    begins, counts, own = _unpacked(lists.flatten().to_numpy(zero_copy_only=False), marks[of])
                    hit = np.zeros(len(alive), dtype=bool)
                    hit[ragged_ranges((offsets[of] + begins)[own], counts[own])] = True
                    alive &= hit
                if not alive.any():
                    continue
                hashes = window_hashes(lanes[0], length)
                where, starts, counts = _anchors(hashes, owner, length, window, alive)
                text = owner[starts]
                runs = _packed(starts - offsets[text], counts, marks[text])
                check = window_hashes(lanes[1], length, 1)[where] if last else np.zeros(len(where), dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[where].view(np.int64)),
                        pa.array((check >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        part.column(0).take(pa.array(text)),
                        pa.array(runs),
                    ],
                    ["h", "check", "row_key", "run"],
                )

    return run


def repeated_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, first: int = 18) -> DataFrame:
    """(row_key, runs): the window starts of each text whose word sequence also
    starts anywhere else, as runs packed into longs (see _packed).

    Level by level: a window can only repeat if its anchor (the least-hashed
    sub-window of the level's length, see _anchors) repeats, so anchors are counted over
    the whole corpus, starts whose anchor is alone are given up, and the rest are
    extended to twice the length. The last level counts the windows themselves, by
    96 bits of hash. Counting combines map-side; the survivors are joined back by an
    equi-join whose skewed partitions adaptive execution splits, so a passage in a
    third of all documents gathers nowhere. Each level is a written table.
    """
    texts = _texts(docs, id_col, text_col).drop("id")
    alive = None
    for length in levels(window, first):
        rows = _window_rows(texts, alive, length, window)
        release(docs.sparkSession)  # the shuffled texts
        repeated = materialize(
            rows.groupBy("h", "check").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("rh"), F.col("check").alias("rc")), "repeated"
        )
        release(docs.sparkSession)  # the counted hashes
        following = materialize(
            rows.join(repeated, (F.col("h") == F.col("rh")) & (F.col("check") == F.col("rc"))).groupBy("row_key").agg(F.collect_set("run").alias("runs")), "alive"
        )
        for table in (rows, repeated, alive):
            discard(table)
        alive = following
        if alive.isEmpty():  # nothing survives
            break
    return alive


def _window_rows(texts: DataFrame, alive: DataFrame | None, length: int, window: int) -> DataFrame:
    """The rows of one level as a written table."""
    source = texts
    if alive is not None:
        runs = alive.select(F.col("row_key").alias("k"), "runs")
        source = texts.join(runs.hint("merge"), F.col("row_key") == F.col("k")).select("row_key", "mark", "text", "runs")
    return materialize(source.mapInArrow(_rows_at(length, window, alive is not None), "h long, check int, row_key long, run long"), "windows")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, first: int = 18) -> DataFrame:
    """(id, n_words, n_removed, kept_text): every row of `docs`, without the words
    that a repeated window covers.

    A window is `window` consecutive words of one text; it is repeated if its
    words also start anywhere else, in the same text (overlaps included), in
    another one, or in another row with the same id and text. All are judged on the input. Kept words are joined
    by one space. Null texts have no words and give an empty text; texts shorter
    than the window stay as they are; null and repeated ids are returned as they come.
    """
    require(docs, id_col, text_col)
    found = repeated_starts(docs, id_col, text_col, window, first).select(F.col("row_key").alias("k"), "runs")
    joined = _texts(docs, id_col, text_col).join(found.hint("merge"), F.col("row_key") == F.col("k"), "left").select("id", "text", "runs", "mark")
    schema = joined.select("id").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                totals, removed, texts = [], [], []
                for text, runs, mark in zip(part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist()):
                    words = (text or "").encode().split()
                    totals.append(len(words))
                    if runs.is_valid and len(runs.values):
                        begins, counts, own = _unpacked(runs.values.to_numpy(zero_copy_only=False), mark)
                        begins, counts = begins[own], counts[own]
                        edges = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(edges, begins, 1)
                        np.add.at(edges, begins + counts + window - 1, -1)
                        gone = np.cumsum(edges[:-1]) > 0
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    removed.append(totals[-1] - len(words))
                    texts.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                    ["id", "n_words", "n_removed", "kept_text"],
                )

    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def sha256_of_kept(kept: DataFrame) -> DataFrame:
    """remove_repeats' rows with the SHA-256 of the kept text in its place."""
    return kept.select("*", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256")).drop("kept_text")
