"""Toxicity by compression distance: a window of a text is compressed with two zstandard
dictionaries, one trained on toxic and one on ordinary text (operator 13)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import require
from tessera.llm.words import slices

#: Words in a window; windows don't overlap.
WORDS = 6
#: Bytes of the dictionary part of a class, and of the part that both classes share.
OWN_BYTES, SHARED_BYTES = 4 << 10, 256 << 10
#: zstandard's level and shortest match.
LEVEL, MIN_MATCH = 5, 4
#: Of the labelled rows at most so many of each class (toxic, ordinary) are learned from, and none of more than
#: so many characters; half of them train the dictionaries and half calibrate the thresholds.
SAMPLE, LONGEST = (3000, 6000), 20_000
#: A word marks toxic text for training if it comes in so many different contexts of toxic texts (or this share of
#: their number, if that is more) and so many times as often in these as in ordinary ones.
CONTEXTS, CONTEXT_SHARE, RATIO = 3, 0.005, 20
#: Differences of compressed lengths are counted from -SPAN to SPAN bytes.
SPAN = 8
#: Bytes at the end of both dictionaries that end every window, so that each has a match and no window is stored raw.
_CARRIER = 40


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def windows(texts: pa.Array, carrier: bytes = b"") -> tuple[np.ndarray, pa.Array]:
    """(offsets, windows): the windows of text i are windows[offsets[i]:offsets[i + 1]], WORDS lower-cased
    runs of letters each (the last may be shorter) with a space between and around, with `carrier` at the end.
    Null texts and those without a letter have none."""
    clean = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\P{L}+", " "), " ")
    lists = pc.split_pattern(clean, " ")
    counts = np.where(pc.equal(clean, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = lists.flatten()
    words = words.filter(pc.not_equal(words, ""))
    ends = np.cumsum(counts)
    pieces = -(-counts // WORDS)
    offsets = np.concatenate(([0], np.cumsum(pieces))).astype(np.int64)
    first = np.repeat(ends - counts, pieces) + WORDS * (np.arange(offsets[-1]) - np.repeat(offsets[:-1], pieces))
    cuts = pa.array(np.append(first, ends[-1] if len(ends) else 0).astype(np.int32))
    joined = pc.binary_join(pa.ListArray.from_arrays(cuts, words), " ").cast(pa.binary())
    return offsets, pc.binary_join_element_wise(b"", joined, carrier, b" ")


def _trained(samples: list[bytes], size: int, **cover: int) -> bytes:
    """A dictionary trained on samples; of too few, which zstandard refuses, their own last bytes."""
    try:
        return zs.train_dictionary(size, samples, level=LEVEL, **cover).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    """The parts of the dictionaries, the log ratio of each difference of lengths, and the threshold of their sum."""

    toxic: bytes
    ordinary: bytes
    shared: bytes
    weights: list[float]
    cut: float

    def __post_init__(self) -> None:
        rules = zs.ZstdCompressionParameters.from_level(
            LEVEL, min_match=MIN_MATCH, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        self.carrier = self.shared[-_CARRIER:]
        self.compressors = []
        for own in (self.toxic, self.ordinary):
            # the own part comes first: the shared part is then equally far away in both, and preferred where both have a match
            table = zs.ZstdCompressionDict(own + self.shared, dict_type=zs.DICT_TYPE_RAWCONTENT)
            table.precompute_compress(compression_params=rules)
            self.compressors.append(zs.ZstdCompressor(dict_data=table, compression_params=rules))

    def _lengths(self, compressor: zs.ZstdCompressor, found: pa.Array) -> np.ndarray:
        compress = compressor.compress
        return np.fromiter((len(compress(w)) for w in found.to_pylist()), dtype=np.int64, count=len(found))

    def differences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, bytes that the toxic dictionary saves against the ordinary one, for each window)."""
        offsets, found = windows(texts, self.carrier)
        toxic, ordinary = (self._lengths(c, found) for c in self.compressors)
        return offsets, np.clip(ordinary - toxic, -SPAN, SPAN) + SPAN

    def sums(self, texts: pa.Array) -> np.ndarray:
        """For each text, the sum of the log ratios of its windows."""
        offsets, apart = self.differences(texts)
        total = np.concatenate(([0.0], np.cumsum(np.asarray(self.weights)[apart])))
        return total[offsets[1:]] - total[offsets[:-1]]


def _contexts(texts: pa.Array) -> Counter:
    """In how many different pairs of neighbours each word comes, so that copies of a text count once."""
    seen = set()
    for text in windows(texts)[1].to_pylist():
        words = [b"", *text.split(), b""]
        seen.update(zip(words, words[1:], words[2:]))
    return Counter(word for _, word, _ in seen)


def _marked(toxic: pa.Array, ordinary: pa.Array) -> list[bytes]:
    """The words that mark toxic text, once for each time that the toxic texts have them."""
    there, elsewhere = _contexts(toxic), _contexts(ordinary)
    share = RATIO * len(toxic) / max(len(ordinary), 1)
    least = max(CONTEXTS, CONTEXT_SHARE * len(toxic))
    marks = {w for w, n in there.items() if n >= least and n >= share * (elsewhere[w] + 0.5)}
    return [b" " + w + b" " for text in windows(toxic)[1].to_pylist() for w in text.split() if w in marks]


def fit(toxic: list[str], ordinary: list[str]) -> Model | None:
    """Train on half of each class and calibrate on the other; None if a class has fewer than two texts.

    The toxic part is trained on the words that mark toxic text, the ordinary part and the shared one on windows of ordinary
    text. Since both dictionaries have the shared part, a window's lengths differ by what the own parts add.
    A difference weighs the log of its share among windows of toxic texts over that among ordinary ones;
    the threshold of the sum makes the rate of missed plus that of wrongly flagged texts least."""
    if min(len(toxic), len(ordinary)) < 2:
        return None
    halves = [(pa.array(x[::2], pa.string()), pa.array(x[1::2], pa.string())) for x in (toxic, ordinary)]
    (toxic_train, toxic_rest), (plain_train, plain_rest) = halves
    plain = windows(plain_train)[1].to_pylist()
    first, second = plain[: 2 * len(plain) // 3], plain[2 * len(plain) // 3 :]
    parts = (_trained(_marked(toxic_train, plain_train), OWN_BYTES, k=16, d=6), _trained(second, OWN_BYTES, k=16, d=6), _trained(first, SHARED_BYTES, k=1000, d=8))
    raw = Model(*parts, [0.0] * (2 * SPAN + 1), 0.0)
    counts = [np.bincount(raw.differences(x)[1], minlength=2 * SPAN + 1) + 0.5 for x in (toxic_rest, plain_rest)]
    weights = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    model = Model(*parts, weights.tolist(), 0.0)
    high, low = np.sort(model.sums(toxic_rest)), np.sort(model.sums(plain_rest))
    cuts = np.unique(np.concatenate((high, low)))
    cuts = np.append(cuts[:1] - 1, (cuts[:-1] + cuts[1:]) / 2)
    cuts = np.append(cuts[cuts > 0], 0.1)  # a text without evidence isn't flagged
    wrong = np.searchsorted(high, cuts) / len(high) + 1 - np.searchsorted(low, cuts) / len(low)
    return Model(*parts, weights.tolist(), float(cuts[np.argmin(wrong)]))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """The model of labelled rows (label 1 or 0) that aren't held out.

    At most SAMPLE rows of each class are drawn by a hash of their ids, in the labels alone, so that the texts are met by
    a join with a bounded table that is broadcast, and nothing of the corpus is shuffled. One task fits: it holds at most
    sum(SAMPLE) texts of LONGEST characters. An id with both labels teaches nothing."""
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(~held_out(id_col) & F.col("label").isin(0, 1))
    known = known.where("id is not null").groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    have = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(have) < 2:
        return None
    # a slightly smaller share than SAMPLE, so that the limit hardly ever binds
    share = F.when(F.col("label") == 1, 0.95 * SAMPLE[0] / have[1]).otherwise(0.95 * SAMPLE[1] / have[0])
    drawn = known.where(F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(1 << 20)) < share * (1 << 20)).select("id", "label")
    drawn = drawn.where("label = 1").limit(SAMPLE[0]).unionByName(drawn.where("label = 0").limit(SAMPLE[1]))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text").between(1, LONGEST))
    rows = texts.join(F.broadcast(drawn), "id").select("label", "text", F.xxhash64("id", "text").alias("h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # repeated ids can give more rows than were drawn: the bound holds for rows, too
        held = pd.concat([pd.DataFrame({"label": [], "text": [], "h": []}), *batches]).sort_values(["h", "text"], kind="stable")
        model = fit(*[held.loc[held["label"] == k, "text"].tolist()[:n] for k, n in ((1, SAMPLE[0]), (0, SAMPLE[1]))])
        if model:
            yield pd.DataFrame([(model.toxic, model.ordinary, model.shared, model.weights, model.cut)], columns=["toxic", "ordinary", "shared", "weights", "cut"])

    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("n") <= max(SAMPLE)).drop("n")
    found = numbered.coalesce(1).mapInPandas(run, "toxic binary, ordinary binary, shared binary, weights array<double>, cut double").collect()
    return Model(*[bytes(found[0][k]) for k in ("toxic", "ordinary", "shared")], list(found[0]["weights"]), found[0]["cut"]) if found else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row from its whole text, in one narrow pass: the logistic of the sum of the windows' log
    ratios less the threshold. Null texts and those without a letter have no window, so a score below a half.
    Without a model (labels of one class or none) every score is 0. What is sent to the tasks is of fixed size."""
    require(docs, id_col, text_col)
    schema = docs.select(F.col(id_col).alias("id")).schema.add("score", "double")
    parts = docs.sparkSession.sparkContext.broadcast(model and (model.toxic, model.ordinary, model.shared, model.weights, model.cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*parts.value) if parts.value else None
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = np.zeros(part.num_rows)
                if known:
                    found = 1 / (1 + np.exp(-np.clip(known.sums(part.column(1)) - known.cut, -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def learn_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted): learned from the labelled rows that aren't held out; every row is scored by its text alone."""
    out = score(docs, learn(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
