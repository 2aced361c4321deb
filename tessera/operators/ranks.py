"""Average ranks within groups of any size, with no task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stages import stage

#: Groups of more rows than this are ranked by ranges of values instead of one window.
LARGE = 1_000_000


def by_window(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """`rows` with rank_<value> for each value: its place from 1 in the group, ties with the mean of their places. A task holds a group."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({f"rank_{v}": F.rank().over(w.orderBy(v)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, v)) - 1) / 2.0 for v in values})


def _places(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, rank) from the number of rows of each distinct value. The values are sorted over all tasks by ranges; each range
    numbers its own, and starts after the rows of the ranges before, whose totals are a row for each group and range."""
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, value]
    ranged = stage(counts.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "rank-ranges")
    whole = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*keys, "__range").agg(F.sum("__n").alias("__in")).withColumn("__start", F.coalesce(F.sum("__in").over(whole), F.lit(0))).drop("__in")
    within = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    rank = F.col("__start") + F.col("__before") + (F.col("__n") + 1) / 2.0
    return local.join(starts, [*keys, "__range"]).select(*keys, value, rank.alias(f"rank_{value}"))


def by_ranges(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The same for groups of any size. Equal values are counted first, map-side too, so ties cost one row however many they are, and
    never fall into two ranges; the ranks go back by a join on group and value. Values are not NULL."""
    out = rows
    for v in values:
        out = out.join(_places(rows.groupBy(*keys, v).agg(F.count(F.lit(1)).alias("__n")), keys, v), [*keys, v])
    return out


def with_average_ranks(rows: DataFrame, keys: Sequence[str], values: Sequence[str], large: int = LARGE) -> DataFrame:
    """One or the other, by a count of the largest group. `rows` is read several times, so it should be a written table."""
    most = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return by_ranges(rows, keys, values) if most > large else by_window(rows, keys, values)


def with_places(rows: DataFrame, keys: Sequence[str], order: Sequence[str], large: int = LARGE) -> DataFrame:
    """`rows` with place, from 1 in each group by `order`, which has no ties, and n, the group's rows. A group of more than `large` rows is sorted
    over all tasks by ranges; each numbers its own rows and starts after those of the ranges before. `rows` is read twice, so it should be a written table."""
    n = F.count(F.lit(1))
    if (rows.groupBy(*keys).agg(n.alias("n")).agg(F.max("n")).first()[0] or 0) <= large:
        w = Window.partitionBy(*keys)
        return rows.withColumn("place", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("n", n.over(w))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(rows.repartitionByRange(parts, *keys, *order).withColumn("__range", F.spark_partition_id()), "place-ranges")
    groups = Window.partitionBy(*keys)
    before = F.sum("__in").over(groups.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy(*keys, "__range").agg(n.alias("__in")).withColumns({"__start": F.coalesce(before, F.lit(0)), "n": F.sum("__in").over(groups)}).drop("__in")
    local = ranged.withColumn("__at", F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order)))
    return local.join(starts, [*keys, "__range"]).withColumn("place", F.col("__start") + F.col("__at")).select(*rows.columns, "place", "n")
