"""Word and hash helpers that run inside tasks (numpy and Arrow only, no Spark).

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is what
Arrow's ASCII white-space splitting yields once empty strings are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd 64-bit multipliers of the window hash, one pair for each of its two lanes.
_LANES = (
    (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)),
    (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA0761D6478BD642F)),
)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `max_bytes` of text each, so that
    the arrays derived from a run stay small whatever the batch size is. A single
    longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if len(sizes) > start:
        yield batch.slice(start)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): the words of text i are words[offsets[i]:offsets[i + 1]].
    A null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    real = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    return kept[offsets], words.filter(real)


def word_codes(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """(codes, distinct words)."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def word_hashes(words: pa.Array) -> np.ndarray:
    """Two 64-bit hashes a word, as an array of shape (2, n); each distinct word is hashed once."""
    codes, distinct = word_codes(words)
    if not distinct:
        return np.zeros((2, 0), dtype=np.uint64)
    digests = b"".join(xxhash.xxh3_128_digest(w.encode()) for w in distinct)
    return np.frombuffer(digests, dtype="<u8").reshape(-1, 2)[codes].T.copy()


def join_hashes(left: np.ndarray, right: np.ndarray, lane: int = 0) -> np.ndarray:
    """The hash of two adjoining windows from their own hashes."""
    a, b = _LANES[lane]
    x = left * a + right
    x ^= x >> np.uint64(32)
    x *= b
    x ^= x >> np.uint64(29)
    return x


def window_hashes(hashes: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """Hashes of all windows of `length` words, by doubling: a window of 2k words
    is two adjoining windows of k, and a length between two powers of two is two
    overlapping windows of the smaller one."""
    done, size = hashes, 1
    while size * 2 <= length:
        done = join_hashes(done[:-size], done[size:], lane) if len(done) > size else done[:0]
        size *= 2
    if size < length:
        gap = length - size
        done = join_hashes(done[:-gap], done[gap:], lane) if len(done) > gap else done[:0]
    return done


def text_of_word(offsets: np.ndarray) -> np.ndarray:
    """For each word, the number of its text within the run."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def inside(owner: np.ndarray, length: int) -> np.ndarray:
    """True at each window start whose `length` words all belong to one text."""
    if len(owner) < length:
        return np.zeros(0, dtype=bool)
    return owner[: len(owner) - length + 1] == owner[length - 1 :]


def ragged_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length) over all pairs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    begins = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - begins, lengths)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows that are equal in the first `keys` columns, each as one table, from
    batches sorted by them. A run may go on in the next batches; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(max(n - 1, 0), dtype=bool)
        for k in range(keys):
            column = batch.column(k)
            new |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        ends = [*(np.flatnonzero(new) + 1).tolist(), n]
        begin = 0
        if held and any(held[-1].column(k)[0] != batch.column(k)[0] for k in range(keys)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        for end in ends[:-1]:
            yield pa.Table.from_batches([*held, batch.slice(begin, end - begin)]).combine_chunks()
            held, begin = [], end
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
