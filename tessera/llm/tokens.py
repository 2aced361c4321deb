"""Token ids in seekable zstandard files (operator 6).

A shard is a run of independent zstandard frames, one for each document, that hold its
ids as little-endian unsigned integers of 2 or 4 bytes; then a skippable frame with
the documents' ids and token counts; then the seek table of the public
seekable format: a skippable frame with, for each frame, the compressed size, the
size, and a checksum (the low half of XXH64), and a footer with the number of frames.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.files import NewFile, open_at
from tessera.llm.shared import materialize, new_path, require
from tessera.llm.words import ragged_ranges, slices, split_words, word_codes

#: Fixed values of the format: the skippable frames' magic numbers (index, seek
#: table), the footer's magic number and its descriptor with the checksum flag set.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC, DESCRIPTOR = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

#: Distinct words whose ids a worker remembers between batches.
REMEMBERED_WORDS = 1_000_000

#: Fixed value: how the public word tokenizer cuts a text into pieces: no piece holds white space, letters and punctuation never share one.
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: More shards than this are not made: they grow with the input instead.
MOST_SHARDS = 20_000


def goes_by_words(definition: dict) -> bool:
    """Whether a tokenizer's own definition shows that a text's ids are those of its words in turn, of their letters and punctuation
    in turn, whatever the case of A-Z in ASCII words. NFC composes nothing with ASCII white space or punctuation,
    and so each piece is the same in the word as in the text."""
    flat = lambda part, inner: part[inner] if (part or {}).get("type") == "Sequence" else [part] if part else []
    normal, pieces = flat(definition.get("normalizer"), "normalizers"), flat(definition.get("pre_tokenizer"), "pretokenizers")
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    cut = {"type": "Split", "pattern": {"Regex": WORD_PIECES}, "behavior": "Removed", "invert": True}
    plain_bytes = lambda x: x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex")
    added = definition.get("added_tokens") or []
    return (
        {"type": "Lowercase"} in normal
        and all(x in ({"type": "NFC"}, {"type": "Lowercase"}, spaces) for x in normal)
        and pieces[:1] == [cut] and all(plain_bytes(x) for x in pieces[1:])
        and all(x["content"].startswith("<|") and not re.search(r"\s", x["content"]) and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in added)
        and (definition.get("model") or {}).get("dropout") is None and not definition.get("truncation") and not definition.get("padding")
    )


class WordEncoder:
    """Encodes with a tokenizer whose definition goes_by_words(): every distinct word is
    encoded once and remembered. check() compares it with the library on probes besides."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.path = path
        self.clear()

    def clear(self) -> None:
        # remembered words by 128 bits of hash, sorted by the first half, and where their ids are in `flat`:
        # some tens of bytes a word, where a dict of strings would take hundreds
        self.first, self.second = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.begins, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def check(self) -> bool:
        """Whether the tokenizer's definition allows encode(), and encode() gives the ids of whole texts on probes of white space, letters of either case and punctuation."""
        with open(self.path, encoding="utf-8") as f:
            if not goes_by_words(json.load(f)):
                return False
        probe = [
            "It's  a", "Straße,\tÉté\n", "x1 2y z 　", " ", "", "don't 'LL <|x|> %%% é́", "The END. Of It! MiXeD (Case), NASA: one; two... Why?!",
            "".join(map(chr, range(65, 91))), *[f"{w}{c} {w}" for w in ("a", "Word", "é") for c in ".,!?*$%&#;:"],
        ]
        whole = [e.ids for e in self.tokenizer.encode_batch(probe, add_special_tokens=False)]
        ids, counts = self.encode(pa.array(probe), None)
        self.clear()
        ends = np.cumsum(counts)
        return whole == [ids[e - n : e].tolist() for e, n in zip(ends, counts)]

    def _find(self, words: list[str]) -> np.ndarray:
        """Where each word is among those remembered; words that aren't are encoded and remembered first."""
        lanes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w.encode()) for w in words), dtype="<u8").reshape(-1, 2)
        at = self._place(lanes)
        new = np.flatnonzero(at < 0)
        if len(new):
            _, once = np.unique(lanes[new, 0], return_index=True)
            new = new[once]
            flat, sizes = [self.flat], []
            for i in range(0, len(new), 2000):
                some = [words[k] for k in new[i : i + 2000]]
                ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                sizes.append(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
                flat.append(np.array([x for y in ids for x in y], dtype=np.int32))
            added = np.concatenate(sizes)
            begins = len(self.flat) + np.cumsum(added) - added
            order = np.argsort(np.concatenate([self.first, lanes[new, 0]]), kind="stable")
            self.first = np.concatenate([self.first, lanes[new, 0]])[order]
            self.second = np.concatenate([self.second, lanes[new, 1]])[order]
            self.begins = np.concatenate([self.begins, begins])[order]
            self.sizes = np.concatenate([self.sizes, added])[order]
            self.flat = np.concatenate(flat)
            at = self._place(lanes)
        if (at < 0).any():
            raise ValueError("two words have one 64-bit hash")
        return at

    def _place(self, lanes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, lanes[:, 0])
        at[at == len(self.first)] = 0
        if not len(self.first):
            return np.full(len(lanes), -1, dtype=np.int64)
        return np.where((self.first[at] == lanes[:, 0]) & (self.second[at] == lanes[:, 1]), at, -1)

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each): null texts count as empty; `end_id` ends each text."""
        apart = pc.replace_substring_regex(pc.fill_null(texts, ""), r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,!?*$%&#;:]+)(\s|$)", r"\1 \2\3")
        offsets, words = split_words(apart)
        codes, distinct = word_codes(words)
        # A-Z are lower-cased by the tokenizer, too. Case counts in its special tokens, which have "<|", and before combining
        # marks, which may compose with a small letter only, so words that aren't ASCII stay as they are
        distinct = [w.lower() if w.isascii() and "<|" not in w else w for w in distinct]
        if len(self.first) + len(distinct) > REMEMBERED_WORDS:
            self.clear()
        place = self._find(distinct)[codes] if distinct else np.zeros(0, dtype=np.int64)
        sizes = self.sizes[place]
        ids = self.flat[ragged_ranges(self.begins[place], sizes)]
        counts = np.diff(np.concatenate(([0], np.cumsum(sizes)))[offsets])
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
        return ids, counts


class PlainEncoder:
    """Encodes whole texts, for any other tokenizer."""

    def __init__(self, path: str):
        self.words = WordEncoder(path)
        self.tokenizer, self.width = self.words.tokenizer, self.words.width

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        tail = [] if end_id is None else [end_id]
        ids = [e.ids + tail for e in self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
        return np.array([x for y in ids for x in y], dtype=np.int64), np.array([len(y) for y in ids], dtype=np.int64)


_ENCODERS: dict[str, WordEncoder | PlainEncoder] = {}


def encoder(path: str) -> WordEncoder | PlainEncoder:
    """One for each Python worker."""
    if path not in _ENCODERS:
        words = WordEncoder(path)
        _ENCODERS[path] = words if words.check() else PlainEncoder(path)
    return _ENCODERS[path]


class ShardWriter:
    def __init__(self, path: str, attempt: str, width: int, level: int = 3):
        self.file, self.width = NewFile(path, attempt), width
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.table: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = ids.astype(f"<u{self.width}").tobytes()
        frame = self.zstd.compress(data)
        self.file.write(frame)
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        self.table.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        index = self.zstd.compress(
            bytes([self.width]) + np.array([x is not None for x in self.ids], dtype=np.uint8).tobytes()
            + np.array([x or 0 for x in self.ids], dtype="<i8").tobytes() + np.array(self.counts, dtype="<i8").tobytes()
        )
        self.file.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        rows = np.array(self.table, dtype="<u4").tobytes()
        entry = struct.pack("<III", 8 + len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        footer = struct.pack("<IBI", len(self.table) + 1, DESCRIPTOR, FOOTER_MAGIC)
        body = rows + entry + footer
        self.file.write(struct.pack("<II", TABLE_MAGIC, len(body)) + body)
        self.file.close()


class Shard:
    """Reads a shard: opening takes its end only, ids(i) the frame of document i only."""

    def __init__(self, path: str):
        self.file = open_at(path)
        size = self.file.size()
        frames, descriptor, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != FOOTER_MAGIC or not descriptor & 0x80:
            raise ValueError(f"{path} has no seek table with checksums")
        rows = np.frombuffer(self._bytes(size - 9 - 12 * frames, 12 * frames), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.path, self.sizes, self.sums = path, rows[:-1, 0], rows[:-1, 2]
        self.begins = np.concatenate(([0], np.cumsum(rows[:, 0])))
        at = int(self.begins[-2])
        magic, length = struct.unpack("<II", self._bytes(at, 8))
        if magic != INDEX_MAGIC:
            raise ValueError(f"{path} has no index")
        data = zstandard.ZstdDecompressor().decompress(self._bytes(at + 8, length))
        n = frames - 1
        self.width = data[0]
        real = np.frombuffer(data, np.uint8, n, 1)
        ids = np.frombuffer(data, "<i8", n, 1 + n)
        self.counts = np.frombuffer(data, "<i8", n, 1 + 9 * n)
        self.doc_ids = [int(i) if r else None for i, r in zip(ids, real)]

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __len__(self) -> int:
        return len(self.counts)

    def ids(self, i: int, frame: bytes | None = None) -> np.ndarray:
        """The ids of document i; a checksum that doesn't fit is an error."""
        data = zstandard.ZstdDecompressor().decompress(self._bytes(int(self.begins[i]), int(self.sizes[i])) if frame is None else frame)
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"{self.path}: frame {i} has another checksum")
        return np.frombuffer(data, f"<u{self.width}")

    def all_ids(self, read_bytes: int = 1 << 22) -> Iterator[np.ndarray]:
        """The ids of every document in turn, reading some MB at a time."""
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.begins, self.begins[i] + read_bytes, "right")) - 1)
            j = min(j, len(self))
            data = self._bytes(int(self.begins[i]), int(self.begins[j] - self.begins[i]))
            for k in range(i, j):
                a = int(self.begins[k] - self.begins[i])
                yield self.ids(k, data[a : a + int(self.sizes[k])])
            i = j

    def close(self) -> None:
        self.file.close()


def write_shards(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text",
    text_bytes_per_shard: int = 64 << 20,
) -> DataFrame:
    """Encode every whole text and write shards in ascending id order under `folder`;
    (shard, path, n_docs, n_tokens), a row for each shard, numbered in that order.

    Null ids come first and null texts are empty; rows with one id are in the order of their
    text. Texts are dealt out by range of id, so each task encodes its range and writes
    it in one go, holding one batch; ids of one document never gather elsewhere. A shard has about
    `text_bytes_per_shard` of text, or more where that would make over MOST_SHARDS of them.
    """
    require(docs, id_col, text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(max(1, -(-total // text_bytes_per_shard)), MOST_SHARDS)
    tie = F.xxhash64("text")
    dealt = texts.repartitionByRange(n, F.col("id"), tie).sortWithinPartitions("id", tie, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tool = TaskContext.get(), encoder(tokenizer)
        out = ShardWriter(f"{folder}/shard-{task.partitionId():06d}.tok.zst", str(task.taskAttemptId()), tool.width)
        total = 0
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids, counts = tool.encode(part.column(1), end_id)
                ends = np.cumsum(counts)
                total += int(counts.sum())
                for doc, a, b in zip(part.column(0).to_pylist(), (ends - counts).tolist(), ends.tolist()):
                    out.add(doc, ids[a:b])
        out.close()
        row = [[task.partitionId()], [out.file.name], [len(out.counts)], [total]]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], ["shard", "path", "n_docs", "n_tokens"])

    # a row a shard: dealt to a few tasks, so that the table isn't as many files as the shards
    return materialize(dealt.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long").repartition(1 + n // 10_000), "shards")


def read_shards(shards: DataFrame, tokens_per_task: int = 16 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, frame) of every document, from the files:
    `start` is the number of tokens before it, in all shards before its own (one sum over
    one row a shard) and in its own; the CRC is of the ids as little-endian 32-bit integers."""
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = shards.withColumn("base", F.coalesce(before, F.lit(0)).cast("long")).where("n_docs > 0").select("shard", "path", "base")
    n = 1 + (shards.agg(F.sum("n_tokens")).first()[0] or 0) // tokens_per_task
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, frame long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path, base in zip(*(c.to_pylist() for c in batch.columns)):
                shard = Shard(path)
                crcs = np.fromiter((zlib.crc32(x.astype("<u4").tobytes()) for x in shard.all_ids()), dtype=np.int64, count=len(shard))
                starts = base + np.cumsum(shard.counts) - shard.counts
                columns = [shard.doc_ids, starts, shard.counts, crcs, np.full(len(shard), number), np.arange(len(shard))]
                shard.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return placed.repartition(n).mapInArrow(run, schema)


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards to the shared folder and read every document back from them."""
    return read_shards(write_shards(docs, new_path(docs.sparkSession, "tokens"), tokenizer, end_id, id_col, text_col))
