"""Time cut into blocks, for few assets of very long calendars: an asset isn't one task then, but as many as it has blocks.

What looks back (or ahead) a bounded number of rows runs on blocks that bring the rows around them along: cut(), then any of the
operators along an asset's rows, then joined(). What looks back without a bound is a scan in two passes: each block is summed up in one row, the rows
of an asset's blocks are carried on in order, and each block goes on from what the blocks before it leave."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import positive
from tessera.sources.market import as_of


def cut(panel: DataFrame, reach: int, rows: int = 4096, ahead: int = 0) -> DataFrame:
    """The panel in blocks of `rows` rows of the calendar, each with the `reach` rows before and the `ahead` rows after it. asset_id
    is (id, block), so every operator that works along an asset's rows and looks no further takes it as it is; joined() gives the panel back.
    A row comes 1 + (reach + ahead) / rows times on average, so `rows` can't be below either."""
    positive(rows, "rows of a block")
    if not (0 <= reach <= rows and 0 <= ahead <= rows):
        raise ValueError(f"blocks of {rows} rows are too short to look {reach} rows back and {ahead} ahead")
    at = F.col("t") - 1
    of = lambda c: F.floor(c / rows)
    out = panel.withColumn("__own", of(at)).withColumn("__in", F.explode(F.sequence(F.greatest(of(at - ahead), F.lit(0)), of(at + reach))))
    return out.withColumn("asset_id", F.struct(F.col("asset_id").alias("id"), F.col("__in").alias("block"))).drop("__in")


def joined(blocks: DataFrame) -> DataFrame:
    """The panel that cut() dealt out, with what operators have added since: each row as its own block has it."""
    own = blocks.where(F.col("asset_id.block") == F.col("__own"))
    return own.withColumn("asset_id", F.col("asset_id.id")).drop("__own")


#: How a running value starts, and how it goes on from that of the blocks before.
_GO_ON = {
    "sum": lambda before, here: F.coalesce(before + here, here, before),
    "count": lambda before, here: F.coalesce(before, F.lit(0)) + here,
    "product": lambda before, here: F.coalesce(before * here, here, before),
    "max": lambda before, here: F.greatest(before, here),
    "last": lambda before, here: F.coalesce(here, before),
}


def _running(kind: str, value: str, frame) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(frame)
    return getattr(F, kind)(value).over(frame)


def add_running(rows: DataFrame, parts: dict[str, tuple[str, Column]], block: Column, order: str = "t", keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """`rows` with running values from a key's first row to the present one: name: (sum, count, product, max or last, column); NULLs are
    skipped, and nothing but NULLs gives NULL (0 for a count). `block` must not fall along `order`, which orders a key's rows without ties.
    A task holds one block of one key, or the one row for each block of a key. Rows are read twice, so they should be a written table."""
    if unknown := {kind for kind, _ in parts.values()} - set(_GO_ON):
        raise ValueError(f"no running {sorted(unknown)}; there are {sorted(_GO_ON)}")
    keys = list(keys)
    given = rows.withColumn("__block", block).withColumns({f"__v_{n}": c for n, (_, c) in parts.items()})
    whole = {n: F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(order))) if kind == "last" else getattr(F, kind)(f"__v_{n}") for n, (kind, _) in parts.items()}
    blocks = given.groupBy(*keys, "__block").agg(*[c.alias(f"__v_{n}") for n, c in whole.items()])
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    # block counts are added up, all else is carried on as it is made
    carried = {n: _running("sum" if kind == "count" else kind, f"__v_{n}", earlier).alias(f"__b_{n}") for n, (kind, _) in parts.items()}
    starts = blocks.select(*keys, "__block", *carried.values())
    within = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    here = given.withColumns({f"__v_{n}": _running(kind, f"__v_{n}", within) for n, (kind, _) in parts.items()})
    made = here.join(starts, [*keys, "__block"], "left")
    made = made.withColumns({n: _GO_ON[kind](F.col(f"__b_{n}"), F.col(f"__v_{n}")) for n, (kind, _) in parts.items()})
    return made.select(*[c for c in rows.columns if c not in parts], *parts)


def as_of_by_blocks(left: DataFrame, right: DataFrame, values: list[str], days: int = 3660, left_date: str = "date", right_date: str = "eff_date") -> DataFrame:
    """as_of() with an asset's history cut into blocks of `days` days. The latest row of each block of `right` goes on, along the asset's
    blocks, to every later block that `left` has, up to where there is a newer one; there it stands before the block's own rows."""
    positive(days, "days of a block")
    block = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    place = F.struct(F.col("asset_id").alias("id"), F.col("__block").alias("block")).alias("asset_id")
    known = right.select("asset_id", right_date, *values).withColumn("__block", block(F.col(right_date)))
    asked = left.withColumn("__block", block(F.col(left_date)))
    latest = known.groupBy("asset_id", "__block").agg(F.max_by(F.struct(right_date, *values), right_date).alias("__row"))
    met = asked.select("asset_id", "__block").distinct().join(latest, ["asset_id", "__block"], "full")
    earlier = Window.partitionBy("asset_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = met.withColumn("__row", F.last("__row", ignorenulls=True).over(earlier)).where("__row is not null")
    rows = known.select(place, right_date, *values).unionByName(carried.select(place, "__row.*"))
    out = as_of(asked.select(place, *[c for c in left.columns if c != "asset_id"]), rows, values, left_date, right_date)
    return out.withColumn("asset_id", F.col("asset_id.id")).select(*left.columns, *values)
