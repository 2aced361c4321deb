"""Near copies by the similarity of their shingles, one of each group kept (operator 4 in the pipeline).

Candidates are the links of operator 4's ball hashing over fingerprints of the shingle sets, and
pairs that share a band of MinHashes; all are decided by the shingles themselves.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.components import connected_components
from tessera.llm.shared import discard, keyed_rows, materialize, partitions, release, require, row_key
from tessera.llm.simhash import near_links
from tessera.llm.words import join_hashes, slices, split_words, whole_groups, window_hashes, word_hashes

_log = logging.getLogger(__name__)

#: Sets of a block of a large cell, counted as one and one more for each 2048 shingles.
BLOCK = 256

#: Rounding of a similarity that is the threshold itself.
_TINY = 1e-9


def shingle_sets(texts: pa.Array, words: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of `words` words, A-Z
    lower-cased. A text of fewer words is one shingle, a text without words has none."""
    offsets, found = split_words(pc.ascii_lower(texts))
    hashes = word_hashes(found)[0]
    whole = window_hashes(hashes, words)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        out.append(np.unique(whole[a : b - words + 1] if b - a >= words else window_hashes(hashes[a:b], b - a) if b > a else hashes[:0]))
    return out


def set_fingerprint(shingles: np.ndarray, part: int = 1 << 14) -> int:
    """SimHash of a set of hashes: a bit is 1 if set in over half of them; 0 for none."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(shingles), part):
        some = np.ascontiguousarray(shingles[i : i + part]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<i8")[0])


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """(row_key, id, sid, n, fp, bands): for each row 128 bits of hash of its set of shingles, the set's
    size and fingerprint, and `bands` hashes of `rows` MinHashes each; a text without words has no bands."""
    keyed = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = keyed.select("row_key", "id").schema.add("sid", "binary").add("n", "integer").add("fp", "long").add("bands", T.ArrayType(T.LongType()))
    seeds = np.random.default_rng(42).integers(0, 1 << 63, size=(2, bands * rows, 1), dtype=np.uint64)
    odd = seeds[0] * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingle_sets(part.column(2), words)
                least = np.full((part.num_rows, bands * rows), np.iinfo(np.uint64).max, dtype=np.uint64)
                for own, row in zip(sets, least):
                    for j in range(0, len(own), 1 << 10):
                        np.minimum(row, ((own[j : j + (1 << 10)] ^ seeds[1]) * odd).min(axis=1), out=row)
                least = least.reshape(part.num_rows, bands, rows)
                hashes = np.broadcast_to(np.arange(bands, dtype=np.uint64), (part.num_rows, bands))
                for k in range(rows):
                    hashes = join_hashes(hashes, least[:, :, k])
                sizes = np.array([len(s) for s in sets], dtype=np.int32)
                some = sizes > 0
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(some * bands))).astype(np.int32)), pa.array(hashes[some].view(np.int64).ravel())
                )
                sids = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                prints = pa.array([set_fingerprint(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sids, pa.array(sizes), prints, lists], schema.names)

    return keyed.mapInArrow(run, schema)


def _cells_of(rows: DataFrame, *more: str) -> DataFrame:
    """The rows (band, sid, ...) of bands that several sets have, without bands that have the same sets as another; `more`: members, the number of sets."""
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "sid")).alias(f"mark{k}") for k in (1, 2)]
    cells = rows.groupBy("band").agg(F.count("*").alias("members"), *marks).where("members > 1")
    cells = cells.groupBy("members", "mark1", "mark2").agg(F.min("band").alias("b")).select("b", "members")
    return rows.join(cells.hint("merge"), F.col("band") == F.col("b")).select(*rows.columns, *more)


def shared_cells(kinds: DataFrame) -> DataFrame:
    """(band, sid, n, members): the sets of every band that more than one set has. Of bands with the same
    sets, which near copies have by the dozen, one is left."""
    return materialize(_cells_of(kinds.select("sid", "n", F.explode("bands").alias("band")), "members"), "shared-cells")


def star_candidates(shared: DataFrame, kinds: DataFrame, threshold: float) -> DataFrame:
    """(src, dst): each set of a cell with the cell's set that shares most cells (the text that the others are
    edits of, if there is one); each set of a fingerprint with the smallest set that has it; and operator 4's links between fingerprints."""
    weights = shared.groupBy(F.col("sid").alias("w")).agg(F.sum(F.col("members") - 1).alias("degree"))
    known = materialize(shared.join(weights.hint("merge"), F.col("sid") == F.col("w")).select("band", "sid", "n", "degree"), "weighted-cells")
    centres = known.groupBy(F.col("band").alias("b")).agg(F.max(F.struct("degree", "sid", "n")).alias("c"))
    stars = known.join(centres.hint("merge"), F.col("band") == F.col("b")).select(F.col("c.sid").alias("src"), F.col("c.n").alias("x"), F.col("sid").alias("dst"), F.col("n").alias("y"))
    prints = kinds.where("n > 0").groupBy("fp").agg(F.min(F.struct("sid", "n")).alias("k"), F.count("*").alias("sets"))
    prints = materialize(prints.select("fp", F.col("k.sid").alias("first"), F.col("k.n").alias("x"), "sets"), "fingerprints")
    many = prints.where("sets > 1").select(F.col("fp").alias("f"), F.col("first").alias("src"), "x")
    alike = kinds.where("n > 0").join(many.hint("merge"), F.col("fp") == F.col("f")).select("src", "x", F.col("sid").alias("dst"), F.col("n").alias("y"))
    links = near_links(prints.select("fp"), 2)
    ends = lambda a, b, c: prints.select(F.col("fp").alias(a), F.col("first").alias(b), F.col("x").alias(c)).hint("merge")
    near = links.join(ends("fa", "a", "x"), F.col("src") == F.col("fa")).join(ends("fb", "b", "y"), F.col("dst") == F.col("fb"))
    near = near.select(F.col("a").alias("src"), "x", F.col("b").alias("dst"), "y")
    fits = F.least("x", "y") >= F.greatest("x", "y") * threshold - _TINY
    pairs = stars.unionByName(alike).unionByName(near).where(F.col("src") != F.col("dst")).where(fits)
    out = materialize(pairs.select("src", "dst").distinct(), "stars")
    discard(known)
    return out


def shingle_table(docs: DataFrame, kinds: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(sid, shingles): the sets of `wanted` (sid) as 64-bit hashes in bytes, from one text of each."""
    first = kinds.select("sid", "row_key").join(wanted.select(F.col("sid").alias("w")).hint("merge"), F.col("sid") == F.col("w"))
    first = materialize(first.select("sid", F.col("row_key").alias("k")), "wanted")
    texts = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    found = texts.join(first.hint("merge"), F.col("row_key") == F.col("k")).select("sid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = pa.array([s.tobytes() for s in shingle_sets(part.column(1), words)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sets], ["sid", "shingles"])

    return materialize(found.mapInArrow(run, "sid binary, shingles binary"), "shingles")


def _numbers(data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), dtype=np.uint64)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    return int((long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum())


def linked_stars(stars: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(src, dst) of the pairs (src, dst) whose exact similarity is `threshold` or more.

    A centre goes to each salted share of about BLOCK of its star, so a star of any size is spread out;
    a task holds one centre at a time."""
    sizes = stars.groupBy(F.col("src").alias("s")).agg(F.count("*").alias("size"))
    dealt = stars.join(sizes.hint("merge"), F.col("src") == F.col("s")).select("src", F.pmod(F.xxhash64("dst"), F.ceil(F.col("size") / BLOCK)).alias("salt"), "dst")
    dealt = materialize(dealt, "dealt-stars")
    centres = dealt.select("src", "salt", F.lit(0).alias("role"), F.col("src").alias("own")).distinct()
    rows = centres.unionByName(dealt.select("src", "salt", F.lit(1).alias("role"), F.col("dst").alias("own")))
    sent = rows.join(sets.hint("merge"), F.col("own") == F.col("sid")).select("src", "salt", "role", "own", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, name = np.zeros(0, dtype=np.uint64), None
        for batch in batches:
            found = [[], []]
            for src, role, own, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                shingles = _numbers(data)
                if not role:
                    centre, name = shingles.copy(), src
                    continue
                if name != src:
                    raise ValueError("a star without its centre")
                both = _common(centre, shingles)
                if both >= threshold * (len(centre) + len(shingles) - both) - _TINY:
                    found[0].append(src), found[1].append(own)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in found], ["src", "dst"])

    return sent.repartition(partitions(stars.sparkSession), "src", "salt").sortWithinPartitions("src", "salt", "role").mapInArrow(run, "src binary, dst binary")


def mixed_cells(labelled: DataFrame) -> DataFrame:
    """(band, sid, n, comp, crowded): the cells (band, sid, n, comp) that hold more than one component; crowded: more than BLOCK sets."""
    weight = 1 + F.floor(F.col("n") / 2048)
    hashed = F.xxhash64("comp")
    cells = labelled.groupBy(F.col("band").alias("b")).agg(F.sum(weight).alias("total"), F.min(hashed).alias("least"), F.max(hashed).alias("most"))
    cells = cells.where("least <> most").select("b", (F.col("total") > BLOCK).alias("crowded"))
    return materialize(labelled.join(cells.hint("merge"), F.col("band") == F.col("b")).select("band", "sid", "n", "comp", "crowded"), "mixed-cells")


def rare_cells(crowd: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(band, sid, n, comp): cells of the sets of `crowd` (sid, n, comp) such that any two sets of different components
    with a similarity of `threshold` or more share a cell, by exact prefix filtering.

    All shingles have one order: first those that a single component has, then by the number of sets that have them. Two sets that are alike
    share ceil(threshold * n) shingles of each, so also one of the first n - ceil(threshold * n) + 1 of both; it is the
    band of their cell. Edits of one text that are too far apart differ in their first shingles and don't meet, however
    many they are. Rows are linear in the shingles of `crowd`, which come once, whatever the number of cells that a set was in."""
    told = crowd.select(F.col("sid").alias("c"), "n", F.xxhash64("comp").alias("owner")).hint("merge")
    whole = sets.join(told, F.col("sid") == F.col("c")).select("sid", "n", "owner", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, shingles = batch.slice(k, 1).select([0, 1, 2]), _numbers(batch.column(3)[k]).view(np.int64)
                for i in range(0, len(shingles), 1 << 14):
                    part = pa.array(shingles[i : i + (1 << 14)])
                    same = one.take(pa.array(np.zeros(len(part), dtype=np.int64)))
                    yield pa.RecordBatch.from_arrays([*same.columns, part], ["sid", "n", "owner", "shingle"])

    rows = materialize(whole.mapInArrow(run, "sid binary, n int, owner long, shingle long"), "crowd-shingles")
    counts = rows.groupBy(F.col("shingle").alias("s")).agg(F.count("*").alias("holders"), F.min("owner").alias("least"), F.max("owner").alias("most"))
    counts = counts.where("least <> most").select("s", "holders")
    several = rows.join(counts.hint("merge"), F.col("shingle") == F.col("s")).select("sid", "n", "shingle", "holders")
    own = Window.partitionBy("sid")
    placed = several.withColumns({"place": F.row_number().over(own.orderBy("holders", "shingle")), "several": F.count("*").over(own)})
    first = F.col("n") - F.ceil(F.col("n") * threshold - _TINY) + 1
    heads = placed.where(F.col("place") <= first - (F.col("n") - F.col("several"))).select("sid", "shingle")
    who = crowd.select(F.col("sid").alias("c"), "n", "comp").hint("merge")
    heads = materialize(heads.join(who, F.col("sid") == F.col("c")).select("sid", "n", "comp", F.col("shingle").alias("band")), "rare-shingles")
    discard(rows)
    return _cells_of(heads)


def blocks_of_cells(labelled: DataFrame) -> DataFrame:
    """(band, a, b, side, sid, comp): the blocks of the cells (band, sid, n, comp) that hold more than one
    component, by pairs of blocks that are to be compared.

    A component of BLOCK sets or more in a cell has blocks of its own, which are not compared with each other; the
    rest of a cell are dealt to blocks by component. Most cells are one block, which comes once."""
    weight = 1 + F.floor(F.col("n") / 2048)
    parts = labelled.groupBy(F.col("band").alias("pb"), F.col("comp").alias("pc")).agg(F.sum(weight).alias("size"))
    parts = materialize(parts, "cell-parts")
    mixed = parts.groupBy(F.col("pb").alias("mb")).agg(F.count("*").alias("n_parts"), F.sum(F.when(F.col("size") <= BLOCK, F.col("size")).otherwise(0)).alias("rest"))
    mixed = mixed.where("n_parts > 1").select("mb", "rest")
    sized = parts.join(mixed.hint("merge"), F.col("pb") == F.col("mb")).select("pb", "pc", "size", "rest")
    rows = labelled.join(sized.hint("merge"), (F.col("band") == F.col("pb")) & (F.col("comp") == F.col("pc")))
    large = F.col("size") > BLOCK
    own = F.xxhash64("comp", F.pmod(F.xxhash64("sid"), F.ceil(F.col("size") / BLOCK)))
    dealt = F.pmod(F.xxhash64("comp"), F.greatest(F.ceil(F.col("rest") / BLOCK), F.lit(1)))
    placed = materialize(
        rows.select("band", "sid", "comp", F.when(large, F.col("comp")).alias("owner"), F.when(large, own).otherwise(dealt).alias("block")), "placed"
    )
    discard(parts)
    blocks = placed.groupBy("band", "block").agg(F.first("owner").alias("owner"))
    left = blocks.select(F.col("band").alias("lb"), F.col("block").alias("a"), F.col("owner").alias("oa"))
    right = blocks.select(F.col("band").alias("rb"), F.col("block").alias("b"), F.col("owner").alias("ob"))
    meet = left.join(right.hint("merge"), (F.col("lb") == F.col("rb")) & (F.col("a") <= F.col("b"))).where("oa is null or ob is null or oa <> ob")
    meet = materialize(meet.select("lb", "a", "b"), "block-pairs")
    side = lambda k, which: placed.join(meet.hint("merge"), (F.col("band") == F.col("lb")) & (F.col("block") == F.col(which))).select("band", "a", "b", F.lit(k).alias("side"), "sid", "comp")
    return side(0, "a").unionByName(side(1, "b").where("a <> b"))


def blocks_to_compare(labelled: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(band, a, b, side, sid, comp): each mixed cell of at most BLOCK sets as one block; the sets of larger ones by the cells of their rare shingles."""
    mixed = mixed_cells(labelled)
    once = mixed.where("not crowded").select("band", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("side"), "sid", "comp")
    crowd = materialize(mixed.where("crowded").select("sid", "n", "comp").distinct(), "crowd")
    return once.unionByName(blocks_of_cells(rare_cells(crowd, sets, threshold)))


def _links_of_block(sets: list[np.ndarray], comps: list[bytes], sides: list[int], threshold: float, columns: int = 2048) -> set[tuple[bytes, bytes]]:
    """Pairs of components that two sets of one pair of blocks link, enough of them to connect what is linked.
    Common shingles of all pairs come from products of 0/1 matrices over the shingles that several sets have."""
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    number = np.cumsum(n > 1) - 1
    several = n[at] > 1
    owner, at = owner[several], number[at[several]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for begin in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        i, j = np.searchsorted(at, [begin, begin + columns])
        has = np.zeros((len(sets), columns), dtype=np.float32)
        has[owner[i:j], at[i:j] - begin] = 1
        both += has @ has.T
    code = {c: k for k, c in enumerate(dict.fromkeys(comps))}
    comp, side = np.array([code[c] for c in comps]), np.array(sides)
    union = sizes[:, None] + sizes[None, :] - both
    near = (both >= threshold * union - _TINY) & (comp[:, None] != comp[None, :])
    near &= (side[:, None] < side[None, :]) if side.any() else np.triu(np.ones_like(near), 1)
    names, root = list(code), list(range(len(code)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = set()
    for i, j in np.argwhere(near).tolist():
        x, y = find(int(comp[i])), find(int(comp[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.add((names[comp[i]], names[comp[j]]))
    return out


def linked_components(blocks: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(src, dst): components that pairs of sets of `threshold` or more in the blocks link. No pair is a row before it is a link."""
    sent = blocks.join(sets.select(F.col("sid").alias("s"), "shingles").hint("merge"), F.col("sid") == F.col("s")).select("band", "a", "b", "side", "comp", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, 3):
            found = _links_of_block([_numbers(x) for x in rows.column(5)], rows.column(4).to_pylist(), rows.column(3).to_pylist(), threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*sorted(found))], ["src", "dst"])

    return sent.repartition(partitions(blocks.sparkSession), "band", "a", "b").sortWithinPartitions("band", "a", "b").mapInArrow(run, "src binary, dst binary")


def near_copy_groups(
    docs: DataFrame, kinds: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, words: int = 5
) -> DataFrame:
    """(sid, group): the component of every distinct set of `kinds` (sid, n, fp, bands, row_key) over all candidate
    pairs whose exact similarity is `threshold` or more. Sets that nothing links are left out.

    First each cell's sets are compared with one of them, see star_candidates; what that links needs no more
    comparing. Then, in cells that still hold several components, every set is compared with those of all other
    components: at once in a cell of at most BLOCK sets, by the cells of its rare shingles in a larger one, without a cap.
    """
    shared = shared_cells(kinds)
    stars = star_candidates(shared, kinds, threshold)
    wanted = materialize(
        shared.select("sid").unionByName(stars.select(F.col("src").alias("sid"))).unionByName(stars.select(F.col("dst").alias("sid"))).distinct(), "in-cells"
    )
    sets = shingle_table(docs, kinds, wanted, id_col, text_col, words)
    release(docs.sparkSession)
    links = materialize(linked_stars(stars, sets, threshold), "star-links")
    _log.info("%d of %d candidate pairs of stars are near copies", links.count(), stars.count())
    near = materialize(connected_components(links), "star-components")
    known = near.select(F.col("node"), F.col("component")).hint("merge")
    labelled = shared.join(known, F.col("sid") == F.col("node"), "left").select("band", "sid", "n", F.coalesce("component", "sid").alias("comp"))
    labelled = materialize(labelled, "labelled-cells")
    discard(shared)
    between = materialize(linked_components(blocks_to_compare(labelled, sets, threshold), sets, threshold), "component-links")
    _log.info("%d links between components of stars", between.count())
    merged = materialize(connected_components(between), "merged-components")
    discard(sets)
    discard(labelled)
    comps = wanted.join(near.hint("merge"), F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("component", "sid").alias("comp"))
    final = merged.select(F.col("node").alias("m"), F.col("component").alias("whole")).hint("merge")
    return materialize(comps.join(final, F.col("comp") == F.col("m"), "left").select("sid", F.coalesce("whole", "comp").alias("group")), "groups")


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, words: int = 5, bands: int = 24, rows: int = 5
) -> DataFrame:
    """The rows of `docs`, one of each group of near copies: the one with the smallest
    id (nulls last), of those the smallest row key, of rows equal in id and text any one.

    Two texts are near copies if the Jaccard similarity of their sets of `words`-word shingles
    (A-Z lower-cased) is `threshold` or more, which is decided by the shingles themselves; groups are the components
    of these pairs. Candidates are operator 4's links (fingerprints of the sets within 2 bits, by ball hashing), and, as these
    are far from all pairs of 0.8, the pairs that share one of `bands` x `rows` MinHashes: by these numbers
    a pair at 0.8 is missed with a probability of (1 - 0.8**5)**24 = 0.00007.
    Texts without words (null, empty, white space) are one group. Texts are taken whole, of any length. Columns stay as they are, whatever their names.
    """
    require(docs, id_col, text_col)
    prints = materialize(sketches(docs, id_col, text_col, words, bands, rows), "sketches")
    kinds = materialize(
        prints.groupBy("sid").agg(
            F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"),
            F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key")).alias("row"),
        ),
        "kinds",
    )
    discard(prints)
    groups = near_copy_groups(docs, kinds.select("sid", "n", "fp", "bands", F.col("row.row_key").alias("row_key")), id_col, text_col, threshold, words)
    known = groups.select(F.col("sid").alias("s"), "group").hint("merge")
    members = kinds.select("sid", "row").join(known, F.col("sid") == F.col("s"), "left")
    first = members.groupBy(F.coalesce("group", "sid").alias("group")).agg(F.min("row").alias("row"))
    kept = materialize(first.select(F.col("row.row_key").alias("k")), "kept")
    discard(kinds)
    # sorted by key for the join, rows with one key stand together: the aggregate that takes one needs no more exchange or sort
    return keyed_rows(docs, id_col, text_col).join(kept.hint("merge"), "k", "left_semi").dropDuplicates(["k"]).select("row.*")
