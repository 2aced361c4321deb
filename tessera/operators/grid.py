"""The dense calendar grid, slices of it, and alignment of panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stages import stage


def calendar(rows: DataFrame, date_col: str = "date") -> DataFrame:
    """(date, t): the distinct dates, numbered from 1. The window is over one row a date."""
    return rows.select(F.col(date_col).alias("date")).distinct().withColumn("t", F.row_number().over(Window.orderBy("date")))


def dense_grid(rows: DataFrame, dates: DataFrame | None = None, written: bool = False) -> DataFrame:
    """Every asset of `rows` at every date of the calendar, with the values of `rows` or NULL.

    The rows are written once, dealt out by asset: the only exchange of rows; calendar, assets and values read that table. `written`: they
    come from such a table already.
    The calendar goes along with each asset as one array (its size is the number of dates), so the grid is made by a generator per
    asset and not by a cartesian product, and joined with the rows where they lie, by the partitioning that the
    window operators need. Of rows that share a cell the filled values count, any one of several; rows at dates that
    the calendar lacks go."""
    rows = rows if written else stage(rows, "rows", by="asset_id")
    dates = calendar(rows) if dates is None else dates
    spots = dates.agg(F.sort_array(F.collect_list(F.struct("t", "date"))).alias("spots"))
    assets = rows.select("asset_id").distinct().crossJoin(F.broadcast(spots))
    full = assets.select("asset_id", F.explode("spots").alias("s")).select("asset_id", F.col("s.date").alias("date"), F.col("s.t").alias("t"))
    values = [c for c in rows.columns if c not in ("asset_id", "date", "t")]
    filled = rows.groupBy("asset_id", "date").agg(*[F.first(c, ignorenulls=True).alias(c) for c in values]) if values else rows.select("asset_id", "date").distinct()
    return full.hint("merge").join(filled, ["asset_id", "date"], "left")


def renumber(panel: DataFrame) -> DataFrame:
    """`panel` with t numbered anew over the dates that are left."""
    return panel.drop("t").join(F.broadcast(calendar(panel)), "date")


def slice_dates(panel: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from `start` to `end`, both included; None leaves a side open."""
    if start is not None:
        panel = panel.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        panel = panel.where(F.col("date") <= F.lit(end).cast("date"))
    return panel


def align_inner(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells that both grids have."""
    return left.join(right.drop("t"), ["asset_id", "date"])


def align_factors_left(factors: DataFrame, returns: DataFrame) -> DataFrame:
    """Factors on the returns' assets and the dates that both have: an asset
    that only the returns have gets NULL factors."""
    dates = returns.select("date").distinct().join(factors.select("date").distinct(), "date", "left_semi")
    return returns.join(F.broadcast(dates), "date", "left_semi").join(factors.drop("t"), ["asset_id", "date"], "left")


def align_outer(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells that either panel has."""
    return left.join(right.drop("t"), ["asset_id", "date"], "full")


def with_mask(panel: DataFrame, mask: DataFrame, name: str, missing: bool) -> DataFrame:
    """`panel` with the mask's column; cells that the mask lacks are `missing`."""
    out = panel.join(mask.select("asset_id", "date", F.col(name).alias("__mask")), ["asset_id", "date"], "left")
    return out.withColumn(name, F.coalesce("__mask", F.lit(missing))).drop("__mask")
