"""Language identification by rank-order profiles of n-grams (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import materialize, require
from tessera.llm.words import slices

#: The lengths of n-grams, how many of a text's and of a language's most frequent ones are compared.
LENGTHS, TOP = (1, 2, 3), 300
#: More languages than this are an error: the profiles go to every task.
MOST_LANGUAGES = 2000


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, code points) of lower-cased texts with each run of non-letters as one
    space, and a space before and after."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\P{L}+", " ")
    clean = pc.binary_join_element_wise(" ", pc.utf8_trim(clean, " "), " ", "")
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(clean)], pa.int32()), clean), "")[0].as_py() if len(clean) else ""
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    return np.concatenate(([0], np.cumsum(pc.utf8_length(clean).to_numpy(zero_copy_only=False)))).astype(np.int64), points


def _grams(points: np.ndarray) -> np.ndarray:
    """All n-grams of one text's code points as integers (21 bits each, so none collide);
    the lone space is none."""
    parts, shifted = [points[points != 32]], points
    for n in LENGTHS[1:]:
        if len(points) >= n:
            shifted = (shifted[: len(points) - n + 1] << np.uint64(21)) | points[n - 1 :]
            parts.append(shifted)
    return np.concatenate(parts)


def _counted(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(_grams(points), return_counts=True)


def _top(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The TOP most frequent n-grams by rank; ties by the n-gram."""
    if len(counts) > TOP:
        least = np.partition(counts, len(counts) - TOP)[len(counts) - TOP]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:TOP]


def held_out(id_col: str = "doc_id") -> "F.Column":
    """True for the third of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, rank): each language's TOP most frequent n-grams over all labelled
    rows. Tasks count their own rows by language first, so what is shuffled is a
    row for each task, language and distinct n-gram; rows without text or language teach nothing."""
    require(labelled, text_col, lang_col)
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list] = {}

        def merged(parts):
            grams, places = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return grams, np.bincount(places, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                offsets, points = _code_points(part.column(1))
                langs = part.column(0).to_pylist()
                for lang in set(langs):
                    own = [points[offsets[i] : offsets[i + 1]] for i, x in enumerate(langs) if x == lang]
                    grams, counts = np.unique(np.concatenate([_grams(p) for p in own]), return_counts=True)
                    totals[lang] = [merged([*totals.get(lang, []), (grams, counts)])]
                    if len(totals[lang][0][0]) > 1 << 18:  # counts add up downstream; memory stays bounded
                        yield _batch(lang, *totals.pop(lang)[0])
        for lang, parts in totals.items():
            yield _batch(lang, *parts[0])

    counted = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # of each language a task sends on the TOP of its share of the n-grams, so none gathers whole
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counted.select("lang", "gram", place.alias("place")).where(F.col("place") <= TOP)
    return best.select("lang", "gram", (F.col("place") - 1).alias("rank"))


def _batch(lang: str, grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"]
    )


class Profiles:
    """The ranks of all languages as one table over the n-grams that any of them has."""

    def __init__(self, rows: pd.DataFrame):
        self.langs = sorted(rows["lang"].unique())
        if len(self.langs) > MOST_LANGUAGES:
            raise ValueError(f"{len(self.langs)} languages; at most {MOST_LANGUAGES} profiles are sent to the tasks")
        self.grams = np.unique(rows["gram"].to_numpy().view(np.uint64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int32)
        for j, lang in enumerate(self.langs):
            own = rows[rows["lang"] == lang]
            self.ranks[np.searchsorted(self.grams, own["gram"].to_numpy().view(np.uint64)), j] = own["rank"].to_numpy()

    def nearest(self, top: np.ndarray) -> tuple[str, float]:
        """(language, score) for ranked n-grams: the least sum of rank differences, TOP for an n-gram
        that a profile lacks; ties: the first by name. The score is one less the sum's share of the most it can be."""
        at = np.searchsorted(self.grams, top)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != top)] = len(self.grams)
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, TOP, np.abs(ranks - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.langs[best], 1.0 - float(apart[best]) / (TOP * len(top))


def identify(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row from its whole text. Null texts and texts
    without a letter are `und` with score 0, as everything is if nothing was learned. One narrow pass;
    what is sent to the tasks is TOP rows for each of at most MOST_LANGUAGES languages."""
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(Profiles(profiles.limit(TOP * MOST_LANGUAGES + TOP).toPandas()))
    schema = docs.select(F.col(id_col).alias("id")).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                offsets, points = _code_points(part.column(1))
                found = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    own = points[a:b]
                    found.append(known.nearest(_top(*_counted(own))) if known.langs and (own != 32).any() else ("und", 0.0))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                    ["id", "lang_pred", "score"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def learn_and_identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score): profiles are learned from the rows that aren't held out,
    and every row is identified by its text alone."""
    profiles = materialize(learn_profiles(docs.where(~held_out(id_col)), text_col, lang_col), "profiles")
    out = identify(docs, profiles, id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
