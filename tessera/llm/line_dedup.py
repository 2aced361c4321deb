"""Line dedup over windows of three lines (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.shared import discard, materialize, require, row_key
from tessera.llm.words import slices


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, n_lines, n_removed, removed, kept_text) of every row: the text without
    the lines that a later occurrence of a repeated window covers.

    Lines are split at \\n and compared exactly. Every `size` consecutive lines of
    a text are a window (known by 128 bits of hash), overlapping ones included; a
    window of which no line holds anything but white space doesn't count. Of a window that
    occurs more than once, in one text or in several, the occurrence with the smallest (id, row key, position) stays
    and the others go; null ids come last. `removed` has the merged covered
    runs as (first line, count). Windows are judged on the input. Null texts have no lines and
    give an empty text; texts of fewer lines than `size` stay whole. Rows equal in id and text count as one
    and have the same result.

    Windows are counted with map-side combining, which leaves one row for each
    window and task of a boilerplate block that a third of the corpus shares, and
    repeated ones are joined back by an equi-join that splits skewed partitions.
    """
    require(docs, id_col, text_col)
    texts = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lined = texts.select("row_key", "id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    here = lambda i: [F.get("lines", i + j) for j in range(size)]
    window = lambda i: F.struct(
        F.xxhash64(*here(i)).alias("h"), F.xxhash64(F.lit(size), *here(i)).alias("g"), i.alias("at"), F.concat(*here(i)).rlike(r"\S").alias("solid")
    )
    spots = F.when(F.size("lines") >= size, F.transform(F.sequence(F.lit(0), F.size("lines") - size), window))
    windows = materialize(
        lined.select("row_key", "id", F.explode(spots).alias("w")).where("w.solid").select("row_key", "id", "w.h", "w.g", "w.at"), "line-windows"
    )
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key", "at")
    repeated = materialize(
        windows.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
        .select(F.col("h").alias("rh"), F.col("g").alias("rg"), "first"),
        "repeated-lines",
    )
    later = windows.join(repeated, (F.col("h") == F.col("rh")) & (F.col("g") == F.col("rg"))).where(place != F.col("first"))
    covered = materialize(later.groupBy(F.col("row_key").alias("k")).agg(F.sort_array(F.collect_set("at")).alias("starts")), "covered-lines")
    discard(windows)
    discard(repeated)
    joined = texts.join(covered.hint("merge"), F.col("row_key") == F.col("k"), "left").select("id", "text", "starts")
    schema = joined.select("id").schema.add("n_lines", "long").add("n_removed", "long")
    schema = schema.add("removed", T.ArrayType(T.StructType().add("first", "integer").add("n", "integer"))).add("kept_text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [_without(t, s, size) for t, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                columns = [pa.array([r[i] for r in rows], schema_of.field(i + 1).type) for i in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "n_lines", "n_removed", "removed", "kept_text"])

    schema_of = to_arrow_schema(schema)
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _without(text: str | None, starts: list[int] | None, size: int) -> tuple[int, int, list[dict], str]:
    """(lines, removed lines, merged runs, kept text) of one text and the sorted starts of windows to remove."""
    if text is None:
        return 0, 0, [], ""
    lines = text.split("\n")
    runs: list[dict] = []
    for at in starts or ():
        if runs and at <= runs[-1]["first"] + runs[-1]["n"]:
            runs[-1]["n"] = at + size - runs[-1]["first"]
        else:
            runs.append({"first": at, "n": size})
    kept, done = [], 0
    for r in runs:
        kept += lines[done : r["first"]]
        done = r["first"] + r["n"]
    kept += lines[done:]
    return len(lines), len(lines) - len(kept), runs, "\n".join(kept)
