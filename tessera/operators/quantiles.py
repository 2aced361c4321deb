"""Exact quantiles of columns of any size, with no task that holds more than a bounded part of them.

A value of given rank is bracketed by Spark's mergeable quantile summaries, whose rank error is bounded; one aggregate then counts
exactly what lies below, at and between the ends of the bracket, which either settles the value or leaves what is strictly between: a
small share of the rows. That is repeated until few enough values are left to be sorted. Ties settle at once, so
every round leaves at most a 2,000th of the values, however they are distributed."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.stages import stage, unstage

#: So many values of a group at most are sorted in one task.
MOST = 200_000
#: Accuracy of the summaries: ranks are off by a 10,000th of the values at most.
ACCURACY = 10_000


@dataclass
class _Target:
    """The value of rank `rank` (from 0) of a group; it is known, or lies strictly between low and high, where `inside`
    values are, after `below` smaller ones."""

    group: object
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def bracket(self) -> Column:
        here = F.col("g").eqNullSafe(F.lit(self.group))
        here = here if self.low is None else here & (F.col("v") > self.low)
        return here if self.high is None else here & (F.col("v") < self.high)


def _ask(values: DataFrame, columns: list[Column]) -> list:
    """One row of aggregates."""
    return list(values.agg(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()) if columns else []


def _narrow(values: DataFrame, targets: list[_Target]) -> None:
    """One round: two aggregates, each of which combines map-side into a row."""
    guesses = []
    for t in targets:
        share, off = (t.rank - t.below) / max(t.inside - 1, 1), 2.0 / ACCURACY
        ends = F.array(F.lit(max(share - off, 0.0)), F.lit(min(share + off, 1.0)))
        guesses.append(F.percentile_approx(F.when(t.bracket(), F.col("v")), ends, F.lit(ACCURACY)))
    ends = _ask(values, guesses)
    v = F.col("v")
    counts = []
    for t, (low, high) in zip(targets, ends):
        here = t.bracket()
        counts += [F.count_if(here & c) for c in (v < low, v == low, (v > low) & (v < high), v == high)]
    found = _ask(values, counts)
    for i, (t, (low, high)) in enumerate(zip(targets, ends)):
        less, at_low, between, at_high = found[4 * i : 4 * i + 4]
        place = t.rank - t.below
        if place < less:  # a guess beyond its error bound would lead here: what is below it remains
            t.high, t.inside = low, less
        elif place < less + at_low:
            t.value = low
        elif place < less + at_low + between:
            t.low, t.high, t.inside, t.below = low, high, between, t.below + less + at_low
        elif low < high and place < less + at_low + between + at_high:
            t.value = high
        else:
            gone = less + at_low + between + (at_high if low < high else 0)
            t.low, t.inside, t.below = high, t.inside - gone, t.below + gone


def exact_quantiles(rows: DataFrame, value: str, shares: Sequence[float], group: str | None = None, most: int = MOST) -> DataFrame:
    """(group, q): for each group its quantiles, by linear interpolation between the values of the two nearest ranks; NULL
    values don't count, a group without values has none. Groups are few (they become conditions of one aggregate).

    Groups of at most `most` values are left to Spark's percentile, which holds them in one task; for larger ones
    ranks are searched as above, over a narrow table that is written once, and one task holds at most
    `most` values for each rank that is asked for."""
    narrow = rows.select((F.col(group) if group else F.lit(1)).alias("g"), F.col(value).cast("double").alias("v"))
    counted = {r["g"]: r["n"] for r in narrow.groupBy("g").agg(F.count("v").alias("n")).collect()}
    name = group or "group"
    small = [g for g, n in counted.items() if n <= most]
    large = {g: n for g, n in counted.items() if n > most}
    simple = narrow.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(float(s)) for s in shares])).alias("q"))
    if not large:
        return simple.withColumnRenamed("g", name)
    values = stage(narrow.where("v is not null"), "quantile-values")
    ranks = {(g, r) for g, n in large.items() for s in shares for r in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))}
    targets = [_Target(g, r, large[g]) for g, r in sorted(ranks, key=str)]
    while open_ones := [t for t in targets if t.value is None and t.inside > most]:
        _narrow(values, open_ones)
    last = [t for t in targets if t.value is None]
    picked = [F.get(F.sort_array(F.collect_list(F.when(t.bracket(), F.col("v")))), F.lit(t.rank - t.below)) for t in last]
    for t, found in zip(last, _ask(values, picked)):
        t.value = found
    unstage(values)
    at = {(t.group, t.rank): t.value for t in targets}
    out = []
    for g, n in large.items():
        between = []
        for s in shares:
            place = s * (n - 1)
            low, high = math.floor(place), math.ceil(place)
            between.append(at[g, low] if low == high else (high - place) * at[g, low] + (place - low) * at[g, high])
        out.append((g, between))
    made = rows.sparkSession.createDataFrame(out, simple.schema)
    if small:
        made = made.unionByName(simple.where(~F.coalesce(F.col("g").isin([g for g in large if g is not None]), F.lit(None in large))))
    return made.withColumnRenamed("g", name)
