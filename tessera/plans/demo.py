"""Panels made of the star schema's tables: a supplier is an asset, its average unit
price over a bar is the price, its sales the dollar volume, its region the sector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.stages import stage
from tessera.operators import cleaning, factors, timeseries
from tessera.operators.cleaning import CleaningRules
from tessera.operators.grid import dense_grid
from tessera.operators.ridge import RidgeSettings
from tessera.plans.settings import Cleaning, Model, Neutral, Quality, Reading, Settings, Trading, Universe

LOOKS = factors.Lookbacks(momentum=12, momentum_skip=1, reversal=3, low_vol=12, low_vol_min=12, signal_fill=12)
RULES = CleaningRules(hard_max_return=10.0, classify_min_return=3.0)
#: Settings that fit monthly bars of some hundred assets.
SETTINGS = Settings(
    reading=Reading(first=None),
    cleaning=Cleaning(quality=Quality(rows=12), assets_per_date=5),
    universe=Universe(assets=60, volume_rows=3, price_floor=1.0),
    neutral=Neutral(beta_rows=12, beta_least=6),
    model=Model(lookbacks=LOOKS, ridge=RidgeSettings("rolling", 12, 6, 2, 50)),
    trading=Trading(rebalance="QE", borrow_cost=0.03, assets_for_ic=5),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """(asset_id, date, price, dollar_volume). The scan reads four columns; sums combine map-side. Amounts
    are summed in whole cents, so a bar doesn't depend on the order in which partitions are added up."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("asset_id"), F.date_trunc(unit, "l_shipdate").cast("date").alias("date"))
    return _priced(rows.agg(*_bar_sums()))


def _bar_sums() -> list[Column]:
    return [(F.sum(F.floor(F.col("l_extendedprice") * 100 + 0.5)) / 100.0).alias("dollar_volume"), F.sum("l_quantity").alias("q")]


def _priced(sums: DataFrame) -> DataFrame:
    return sums.select("asset_id", "date", (F.col("dollar_volume") / F.when(F.col("q") != 0, F.col("q"))).alias("price"), "dollar_volume")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What bars and statements add up, by asset and month, from one scan; written, dealt by asset."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("asset_id"), F.date_trunc("month", "l_shipdate").cast("date").alias("date"))
    return stage(rows.agg(*_bar_sums(), *[F.sum(c).alias(name) for name, c in _amounts().items()]), "sales", by="asset_id")


def grid(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    return dense_grid(bars(spark, sf_dir, unit))


def grid_of(sold: DataFrame) -> DataFrame:
    """The monthly grid from sales()."""
    return dense_grid(_priced(sold), written=True)


def clean(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """The grid, cleaned once: price, ret before cleaning and the flags."""
    return cleaning.clean_prices(grid(spark, sf_dir, unit), RULES)


def returns(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """The clean grid with ret and fwd_ret of clean prices (the last date has no fwd_ret)."""
    made = timeseries.add_returns(clean(spark, sf_dir, unit).select("asset_id", "date", "t", "price", "dollar_volume", "hard"))
    w = timeseries.by_asset()
    return made.withColumn("fwd_ret", F.lead("price").over(w) / F.when(F.col("price") != 0, F.col("price")) - 1)


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, sector)."""
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    out = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return out.select(F.col("s_suppkey").alias("asset_id"), F.col("r_name").alias("sector"))


def _amounts() -> dict[str, Column]:
    """The amounts of a statement, of one line item."""
    price, off = F.col("l_extendedprice"), F.col("l_discount")
    return {
        "revenue": price * (1 - off), "gross_profit": price * (F.lit(0.9) - off), "operating_income": price * (F.lit(0.5) - off - F.col("l_tax")),
        "net_income": price * (F.lit(0.4) - off - F.col("l_tax")), "total_assets": F.col("l_quantity") * 2000.0,
        "total_debt": F.col("l_quantity") * F.col("l_tax") * 10000.0, "shares": F.col("l_quantity"),
    }


def statements(spark: SparkSession, sf_dir: str, sold: DataFrame | None = None) -> DataFrame:
    """Quarterly pseudo-statements: asset_id, report_date (quarter's end), publish_date (45 days on), fiscal_year,
    fiscal_period, ingest_seq and amounts derived from a supplier's sales. A late revision (the same figures
    times 1.01, one in seven) shares its publish date. With `sold`, they are added up from sales() instead of from line items."""
    asset, day, amounts = F.col("l_suppkey"), F.col("l_shipdate"), _amounts()
    if sold is not None:
        asset, day, amounts = F.col("asset_id"), F.col("date"), {name: F.col(name) for name in amounts}
    quarter = F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    rows = table(spark, sf_dir, "lineitem") if sold is None else sold
    sums = rows.groupBy(asset.alias("asset_id"), quarter.alias("report_date")).agg(*[F.sum(c).alias(name) for name, c in amounts.items()])
    rows = sums.withColumn("publish_date", F.date_add("report_date", 45)).withColumn("fiscal_year", F.year("report_date")).withColumn("fiscal_period", F.concat(F.lit("Q"), F.quarter("report_date").cast("string")))
    versions = F.sequence(F.lit(1), F.when((F.col("asset_id") + F.col("fiscal_year")) % 7 == 0, 2).otherwise(1))
    versioned = rows.withColumn("ingest_seq", F.explode(versions)).withColumn("ingest_seq", F.col("ingest_seq").cast("long"))
    return versioned.withColumn("revenue", F.when(F.col("ingest_seq") == 2, F.col("revenue") * 1.01).otherwise(F.col("revenue")))


def signal_rows(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None, sold: DataFrame | None = None) -> DataFrame:
    """The thirteen signals at the grid's dates, from the statements as known then. These are written once, dealt by asset, since
    three sets are made of them."""
    from tessera.sources import signals
    from tessera.sources.market import publish_aligned

    known = stage(publish_aligned(statements(spark, sf_dir, sold), 1, "keep_last"), "statements", by="asset_id", dealt=sold is not None)
    known = known.withColumn("equity", F.col("total_assets") - F.col("total_debt")).withColumn("free_cash_flow", F.col("operating_income") * 0.8).withColumn("dividends_paid", F.col("net_income") * 0.3)
    market = (grid(spark, sf_dir) if cells is None else cells).select("asset_id", "date", F.col("price").alias("close"))
    return signals.signals(market, {"income_ttm": known, "balance_quarterly": known, "cashflow_ttm": known})
