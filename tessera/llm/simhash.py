"""SimHash near-duplicates by meeting in the middle (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.shared import discard, materialize, partitions, require

#: Shingles whose bits are counted at once; a longer text is counted in parts.
_PART = 1 << 14


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text.

    A-Z are lower-cased, words are runs of anything but 0x20 and 0x09-0x0D, and a
    shingle is `words_per_shingle` of them joined by spaces (all of them if there
    are fewer). A bit is set if XXH64 (seed 42) sets it in over half the shingles,
    repeats included. Without words the fingerprint is 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    begins = np.concatenate(([0], ends[:-1]))[: len(words) - k + 1].tolist()
    ends = (ends - 1)[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(begins), _PART):
        part = [digest(joined[a:b], 42) for a, b in zip(begins[i : i + _PART], ends[i : i + _PART])]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    over = counts * 2 > len(begins)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every row's whole text, in an Arrow pass."""
    require(docs, id_col, text_col)
    schema = docs.select(id_col).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), words_per_shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], [id_col, "fp"]
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def near_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(src, dst): links between distinct fingerprints that differ in at most
    `radius` bits, enough of them to connect whatever is linked.

    `prints` has one column fp of distinct values. Every fingerprint emits all
    variants within half the radius (for 2: itself and 64 others), so two
    fingerprints within the radius meet at a variant. A variant's bucket can hold
    no more fingerprints than its own ball (65), whatever the data are, and any
    two in it are within the radius: each is linked to the bucket's smallest, which
    leaves the components as they are without all pairs being emitted. Pairs met at several
    variants are deduplicated and verified by counting differing bits.
    """
    if radius not in (0, 2):
        raise ValueError("radius must be 0 or 2")
    if radius == 0:
        return prints.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).where("src <> dst")
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    variants = F.concat(F.array(F.col("fp")), F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit)))
    # dealt out first: a small table of fingerprints comes in few partitions and becomes 65 times as many rows
    buckets = (
        prints.repartition(partitions(prints.sparkSession)).select("fp", F.explode(variants).alias("variant"))
        .groupBy("variant")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
    )
    pairs = buckets.select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst")).where("src <> dst").distinct()
    return pairs.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius)


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, radius: int = 2
) -> DataFrame:
    """(id, fp, component_id): every row of `docs` with its fingerprint and the
    smallest id reachable over links, its own included.

    Equal fingerprints are one class from the start, so a group of a million copies
    costs what one text does after the first pass. Rows with a null id take
    part like any others and never name a component that has another id; with
    none at all the component is null. Null and empty texts have fingerprint 0.
    Repeated ids and repeated rows are returned as often as they come.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "classes")
    found = materialize(connected_components(near_links(classes.select("fp"), radius)), "components")
    named = found.join(classes, found.node == classes.fp).groupBy("component").agg(F.min("least").alias("component_id"))
    linked = found.join(named, "component").select(F.col("node").alias("fp"), "component_id")
    alone = classes.where("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    labels = materialize(linked.unionByName(alone), "labels")
    discard(found)
    hit = labels.select(F.col("fp").alias("label_fp"), "component_id", F.lit(True).alias("labelled"))
    joined = prints.join(hit, prints.fp == hit.label_fp, "left")
    return joined.select(
        id_col, "fp", F.when(F.col("labelled"), F.col("component_id")).otherwise(F.col(id_col)).alias("component_id")
    )
