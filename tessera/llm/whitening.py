"""Whitening of embeddings by merged covariances (operator 12)."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, materialize, require

#: Entries become whole numbers floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: So many components at most are returned.
COMPONENTS = 16
#: A component with less than this share of the largest eigenvalue has no variance but rounding, and is left out.
LEAST = 1e-12


@dataclass
class Moments:
    """Count, sums and centred scatter of some vectors. Sums of whole numbers are Python's integers, so means are exact."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        """Of rows of whole numbers or of doubles."""
        n, sums = len(rows), rows.sum(axis=0)
        whole = sums // n
        apart = (rows - whole) - (sums - whole * n) / n
        return Moments(n, sums.astype(object) if rows.dtype.kind == "i" else sums, apart.T @ apart)

    def merged(self, other: Moments) -> Moments:
        """Of both sets of vectors, by the pairwise formula: no large products are subtracted."""
        n = self.n + other.n
        gap = ((other.sums * self.n - self.sums * other.n) / (self.n * other.n)).astype(float)
        return Moments(n, self.sums + other.sums, self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n))


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def moments(vectors: DataFrame, dims: int, change: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> Moments:
    """Moments of the only column of `vectors` (one row at least) after `change`. Each partition makes its own, which
    treeReduce merges: a partial is dims * dims doubles, however many rows it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            if batch.num_rows:
                part = Moments.of(change(_rows(batch.column(0), dims)))
                whole = part if whole is None else whole.merged(part)
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(whole)], pa.binary())], ["partial"])

    partials = vectors.mapInArrow(run, "partial binary").rdd.map(lambda row: pickle.loads(row["partial"]))
    return partials.treeReduce(Moments.merged)


@dataclass
class Whitener:
    """What every row is whitened with: count and exact sums of the fit list, and per component (one column each)
    the unit eigenvector over the root of its eigenvalue, and the eigenvalue's share of the trace."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    explained: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, on each component. The difference is made of whole numbers, so no digit of a large mean is lost."""
        whole = np.array([int(s) // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([int(s) % self.n / self.n for s in self.sums])
        return ((x - whole) - rest) @ self.axes

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - S)^2, exact: in 64 bits where that shows to be enough, else in Python's integers."""
        far = float(max(abs(int(x.max()) * self.n - int(s)) + abs(int(x.min()) * self.n - int(s)) for s in self.sums))
        if far * far * x.shape[1] < 2**62 and self.n * float(np.abs(x).max()) < 2**62:
            return ((x * self.n - self.sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
        return [sum((self.n * int(c) - int(s)) ** 2 for c, s in zip(row, self.sums)) for row in x.tolist()]


def eigen(whole: Moments, most: int = COMPONENTS) -> Whitener:
    """The components by falling eigenvalue; those without variance are left out."""
    covariance = whole.scatter / whole.n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = [i for i in np.argsort(-values, kind="stable") if values[i] > max(LEAST * values[-1], 0)][:most]
    return Whitener(whole.n, whole.sums, axes[:, order] / np.sqrt(values[order]), values[order] / max(np.trace(covariance), 1e-300))


def _usable(vector: str) -> Column:
    """True where a vector has entries and all are finite numbers."""
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    Rows whose vector is null, empty or holds a null or non-finite entry are dropped; vectors of different lengths are an
    error. Entries become whole numbers, the fit list is each distinct vector once (combined map-side, so copies
    never meet in one task), written and read twice: for the moments, whose eigenvectors the driver derives from
    dims * dims numbers, and to verify that the whitened list's covariance is the identity. Rows with null or
    repeated ids are rows like any other. Without rows, or without variance, the result is empty."""
    require(embeddings, id_col, vector_col)
    whole = F.transform(F.col(vector_col), lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long"))
    rows = embeddings.where(_usable(vector_col)).select(F.col(id_col).alias("id"), whole.alias("x"))
    schema = rows.select("id").schema.add("component", "integer").add("n", "long").add("deviation", "decimal(38,0)")
    schema = schema.add("whitened", "double").add("explained", "double").add("identity_error", "double")
    fit = materialize(rows.select("x").distinct(), "vectors")
    least, dims = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != dims:
        raise ValueError(f"vectors of {least} to {dims} entries")
    known = eigen(moments(fit, dims), most) if dims else None
    if known is None or not known.axes.shape[1]:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    check = moments(fit, dims, known.whitened)
    off = float(np.abs(check.scatter / check.n - np.eye(known.axes.shape[1])).max())
    discard(fit)
    table = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        k = known.axes.shape[1]
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 4096):
                batch = whole_batch.slice(start, 4096)
                x = _rows(batch.column(1), dims)
                many = np.repeat(np.arange(len(x)), k)
                far = pa.array([Decimal(d) for d in known.deviations(x)], pa.decimal128(38, 0))
                columns = [
                    batch.column(0).take(pa.array(many)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(many), known.n)),
                    far.take(pa.array(many)), pa.array(known.whitened(x).ravel()), pa.array(np.tile(known.explained, len(x))), pa.array(np.full(len(many), off)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
