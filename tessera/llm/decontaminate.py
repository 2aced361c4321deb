"""Benchmark decontamination: size-partitioned MinHash containment search (operator 3)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, keyed_rows, materialize, require, row_key
from tessera.llm.words import inside, slices, split_words, text_of_word, window_hashes, word_hashes

#: A benchmark of at most so many shingles is sent to the tasks whole; a larger one is met in joins.
SENT_SHINGLES = 500_000

#: Bits of the table that tells a document's shingles from those that no sketch has: 8 MB, whatever the benchmark.
_SLOTS = 1 << 26


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(entry, item, width, n, shingle, h, sketched): the distinct shingles of each item, texts lower-cased.

    An item of fewer than `words` words has one shingle of its own `width`; an
    item without words has none and is never found. `entry` numbers an item by its id and width, or, without an id, by its
    text. With threshold t, a document that contains an item of n distinct shingles lacks at most
    n - ceil(t n) of them, so among any n - ceil(t n) + 1 of them one must be in it.
    `sketched` marks those with the smallest hashes: a bottom-k MinHash of the
    item with k fitted to its size, by which no document is missed.
    """
    require(items, id_col, text_col)
    kinds = [("entry", pa.int64()), ("item", pa.int64()), ("width", pa.int32()), ("n", pa.int32()), ("shingle", pa.string()), ("h", pa.int64()), ("sketched", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = _words(text or "")
                width = min(words, len(own))
                if not width:
                    continue
                name = f"{width} {item}" if item is not None else f"{width} text {' '.join(w.decode() for w in own)}"
                entry = xxhash.xxh64_intdigest(name) - (1 << 63)
                h = _hashes(pa.array([text]), width)[0]
                found = {b" ".join(own[i : i + width]).decode(): int(h[i]) for i in range(len(own) - width + 1)}
                k = len(found) - math.ceil(threshold * len(found) - 1e-9) + 1
                for rank, (shingle, x) in enumerate(sorted(found.items(), key=lambda s: s[1] & (2**64 - 1))):
                    rows.append((entry, item, width, len(found), shingle, x, rank < k))
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])

    return items.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "entry long, item long, width int, n int, shingle string, h long, sketched boolean")


def _words(text: str) -> list[bytes]:
    return pc.utf8_lower(pa.scalar(text)).as_py().encode().split()


def _hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owner) of all shingles of `width` words in lower-cased texts."""
    offsets, words = split_words(pc.utf8_lower(texts))
    owner = text_of_word(offsets)
    ok = inside(owner, width)
    hashes = window_hashes(word_hashes(words)[0], width)
    return hashes[ok].view(np.int64), owner[: len(ok)][ok]


class _Sketches:
    """All items, as the tasks look them up. Sketches are partitioned by the items' size: those of 2**c up to
    2**(c + 1) - 1 shingles have the sorted hashes of their sketches and a bit table before them, and
    are looked for only in texts of as many shingles as the smallest of them asks for."""

    def __init__(self, rows: pd.DataFrame, threshold: float):
        self.items, self.parts = {}, {}
        for entry, g in rows.groupby("entry"):
            item = g["item"].iloc[0]
            shingles = frozenset(s.encode() for s in g["shingle"])
            self.items[entry] = (None if pd.isna(item) else int(item), int(g["width"].iloc[0]), shingles, len(shingles).bit_length())
        known = rows[rows["sketched"]]
        known = known.assign(size_class=[self.items[e][3] for e in known["entry"]])
        for (width, size_class), g in known.groupby(["width", "size_class"]):
            g = g.sort_values("h")
            bits = np.zeros(1 << 20, dtype=bool)
            bits[g["h"].to_numpy() & 0xFFFFF] = True
            least = min(math.ceil(threshold * len(self.items[e][2]) - 1e-9) for e in g["entry"].unique())
            self.parts.setdefault(int(width), []).append((g["h"].to_numpy(), g["entry"].to_numpy(), bits, least))

    def candidates(self, texts: pa.Array) -> dict[int, set[int]]:
        """Entries that share a sketched shingle with each text."""
        found: dict[int, set[int]] = {}
        for width, parts in self.parts.items():
            h, owner = _hashes(texts, width)
            sizes = np.bincount(owner, minlength=len(texts))
            for hashes, entries, bits, least in parts:
                maybe = np.flatnonzero(bits[h & 0xFFFFF])
                maybe = maybe[sizes[owner[maybe]] >= least]
                left, right = np.searchsorted(hashes, h[maybe], "left"), np.searchsorted(hashes, h[maybe], "right")
                for k in np.flatnonzero(right > left):
                    found.setdefault(int(owner[maybe[k]]), set()).update(entries[left[k] : right[k]].tolist())
        return found

    def contained(self, text: str, entry: int) -> int:
        """How many distinct shingles of the item are in the text, exactly."""
        _, width, shingles, _ = self.items[entry]
        own = _words(text)
        return len(shingles & {b" ".join(own[i : i + width]) for i in range(len(own) - width + 1)})


def contaminations(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    words: int = 5, threshold: float = 0.8, sent_shingles: int = SENT_SHINGLES,
) -> DataFrame:
    """(id, row_key, item, contained, n_shingles, containment): every document and item such that at least
    `threshold` of the item's distinct shingles are in the document's whole text.

    Documents stay where they are: a task looks its shingles up in the sketches
    (see item_shingles) and checks candidates by the shingles themselves. A benchmark of up to `sent_shingles` shingles is sent to
    the tasks; for a larger one see _joined. Null texts and texts without words match nothing. Repeated documents are reported as often as they come.
    Items with one id are taken as one, with the shingles of all (but those of fewer than `words`
    words apart, by their number of words); items without an id are reported with a null one.
    """
    require(docs, id_col, text_col)
    known = materialize(item_shingles(items, item_col, item_text_col, words, threshold), "item-shingles")
    if known.count() > sent_shingles:
        return _joined(docs, known, id_col, text_col, threshold)
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    schema = rows.select("id", "row_key").schema
    for name, kind in (("item", "long"), ("contained", "long"), ("n_shingles", "long"), ("containment", "double")):
        schema = schema.add(name, kind)
    sent = docs.sparkSession.sparkContext.broadcast(_Sketches(known.toPandas(), threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                at, found, shared, sizes = [], [], [], []
                for i, some in sorted(sketches.candidates(part.column(2)).items()):
                    text = part.column(2)[i].as_py()
                    for entry in sorted(some):
                        item, _, shingles, _ = sketches.items[entry]
                        got = sketches.contained(text, entry)
                        if got >= threshold * len(shingles) - 1e-9:
                            at.append(i), found.append(item), shared.append(got), sizes.append(len(shingles))
                where = pa.array(at, pa.int64())
                ratio = np.array(shared, dtype=np.float64) / np.maximum(np.array(sizes, dtype=np.float64), 1)
                columns = [part.column(0).take(where), part.column(1).take(where), *(pa.array(x, pa.int64()) for x in (found, shared, sizes)), pa.array(ratio)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def _slot_table(known: DataFrame) -> np.ndarray:
    """A bit for each slot that a sketched hash falls in, packed; made by tasks in 1024 pieces of 8 kB."""
    piece = _SLOTS >> 10

    def bits(key: tuple, table: pa.Table) -> pa.Table:
        own = np.zeros(piece, dtype=bool)
        own[table.column("slot").to_numpy() % piece] = True
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    slots = known.where("sketched").select(F.pmod("h", F.lit(_SLOTS)).alias("slot")).distinct()
    found = slots.select("slot", F.expr(f"slot div {piece}").alias("piece")).groupBy("piece").applyInArrow(bits, "piece long, bits binary")
    table = np.zeros(_SLOTS // 8, dtype=np.uint8)
    for row in found.collect():
        table[row["piece"] * piece // 8 : (row["piece"] + 1) * piece // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return table


def _joined(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """contaminations() for a benchmark of any size. What is sent to the tasks is a bit table of fixed size, by which most of a
    document's shingles are seen to be in no sketch; the rest meet the sketches in a join by hash. Documents
    that have candidates give all their shingles, and these meet the candidates' own by document and shingle, exactly."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(_slot_table(known))
    widths = [r[0] for r in known.select("width").distinct().collect()]
    texts = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                for width in widths:
                    h, owner = _hashes(part.column(1), width)
                    slot = h & (_SLOTS - 1)
                    some = np.flatnonzero(table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                    keys = part.column(0).take(pa.array(owner[some]))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(some), width, dtype=np.int32)), pa.array(h[some])], ["row_key", "width", "h"])

    own = materialize(known.groupBy("entry", "item", "width", "shingle").agg(F.max("sketched").alias("sketched"), F.first("h").alias("h")), "entry-shingles")
    sizes = own.groupBy(F.col("entry").alias("e")).agg(F.count("*").alias("n_shingles"))
    sketched = own.where("sketched").select("entry", F.col("width").alias("w"), F.col("h").alias("x"))
    met = texts.mapInArrow(hits, "row_key binary, width int, h long").distinct()
    pairs = met.join(sketched.hint("merge"), (F.col("h") == F.col("x")) & (F.col("width") == F.col("w"))).select("row_key", "entry").distinct()
    pairs = materialize(pairs, "candidates")
    asked = pairs.select(F.col("row_key").alias("k")).distinct()

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1).to_pylist()):
                words = _words(text)
                for width in widths:
                    found = list({b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)})
                    for i in range(0, len(found), 1 << 16):
                        some = pa.array(found[i : i + (1 << 16)], pa.binary()).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(some), pa.binary()), pa.array([width] * len(some), pa.int32()), some], ["dk", "dw", "ds"])

    one = texts.join(asked.hint("merge"), F.col("row_key") == F.col("k")).groupBy("row_key").agg(F.first("text").alias("text"))
    theirs = one.mapInArrow(shingles, "dk binary, dw int, ds string")
    wanted = pairs.join(own.select(F.col("entry").alias("e"), "item", "width", "shingle").hint("merge"), F.col("entry") == F.col("e")).drop("e")
    same = (F.col("row_key") == F.col("dk")) & (F.col("width") == F.col("dw")) & (F.col("shingle") == F.col("ds"))
    counted = wanted.join(theirs.hint("merge"), same).groupBy("row_key", "entry", "item").agg(F.count("*").alias("contained"))
    found = counted.join(sizes.hint("merge"), F.col("entry") == F.col("e")).where(F.col("contained") >= F.col("n_shingles") * threshold - 1e-9)
    found = materialize(found.select(F.col("row_key").alias("k"), "item", "contained", "n_shingles", (F.col("contained") / F.col("n_shingles")).alias("containment")), "contained")
    discard(own)
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"))
    return rows.join(found.hint("merge"), F.col("row_key") == F.col("k")).drop("k")


def find_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **options) -> DataFrame:
    """contaminations() with the columns' own names: (doc_id, item_id, contained, n_shingles, containment)."""
    out = contaminations(docs, items, id_col, text_col, item_col, **options)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "contained", "n_shingles", "containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **options) -> DataFrame:
    """The rows of `docs` that contain no item. Their columns stay as they are, whatever their names."""
    hits = materialize(contaminations(docs, items, id_col, text_col, item_col, **options).select(F.col("row_key").alias("k")).distinct(), "hits")
    return keyed_rows(docs, id_col, text_col).join(hits, "k", "left_anti").select("row.*")
