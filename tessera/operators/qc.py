"""Quality-control tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import finite
from tessera.functions.stages import stage
from tessera.operators.cleaning import simple_return
from tessera.operators.quantiles import exact_quantiles


def price_summary(panel: DataFrame, scope: str, price: str = "price") -> DataFrame:
    """One row: observed prices, and the least, largest and outer quantiles of finite returns. The quantiles are exact at any
    size (operators/quantiles.py); returns are written once, as two narrow columns."""
    made = stage(panel.select(F.col(price).isNotNull().alias("has"), finite(simple_return(price)).alias("r")), "returns")
    made = made.withColumn("scope", F.lit(scope))
    q = exact_quantiles(made, "r", (0.01, 0.99, 0.999), "scope")
    out = made.agg(F.lit(scope).alias("scope"), F.count_if("has").alias("n_observed_prices"), F.min("r").alias("ret_min"), F.max("r").alias("ret_max"))
    return out.join(F.broadcast(q), "scope", "left").select(
        "scope", "n_observed_prices", "ret_min", F.get("q", F.lit(0)).alias("ret_p01"), F.get("q", F.lit(1)).alias("ret_p99"), F.get("q", F.lit(2)).alias("ret_p999"), "ret_max"
    )


def removed_prices(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row over the cells that both have: removed prices, assets with any, and their share of the prices before."""
    both = before.select("asset_id", "date", F.col("price").alias("b")).join(after.select("asset_id", "date", F.col("price").alias("a")), ["asset_id", "date"])
    gone = F.col("b").isNotNull() & F.col("a").isNull()
    out = both.agg(
        F.count_if(gone).alias("removed_prices"), F.count_distinct(F.when(gone, F.col("asset_id"))).alias("assets_affected"), F.count("b").alias("observed_before")
    )
    return out.select("removed_prices", "assets_affected", (F.col("removed_prices") / F.when(F.col("observed_before") > 0, F.col("observed_before"))).alias("removed_frac"))


def melt_factors(panel: DataFrame, factors: Sequence[str], *keep: str) -> DataFrame:
    """(asset_id, date, t, …, factor, value)."""
    return panel.unpivot(["asset_id", "date", "t", *keep], list(factors), "factor", "value")


def factor_summary(panel: DataFrame, factors: Sequence[str], base: str | None = None) -> DataFrame:
    """A row a factor, by name: the share of base cells with a value, the medians of that share over dates
    and over assets, and the outer quantiles of values, all exact at any size. Cells out of base don't count; without any all is NULL."""
    cells = panel.withColumn("__base", F.lit(True) if base is None else F.coalesce(F.col(base), F.lit(False)))
    long = stage(melt_factors(cells.select("asset_id", "date", "t", "__base", *factors), factors, "__base").drop("t"), "factor-cells")
    has = (F.col("__base") & F.col("value").isNotNull()).cast("long")
    n = F.sum(F.col("__base").cast("long"))
    share = F.sum(has) / F.when(n > 0, n)
    at = lambda k: F.get("q", F.lit(k))

    def by(key: str, name: str) -> DataFrame:
        shares = stage(long.groupBy("factor", key).agg(share.alias("s")), f"coverage-{key}")
        return exact_quantiles(shares, "s", (0.5,), "factor").select("factor", at(0).alias(name))

    seen = long.select("factor", F.when(F.col("__base"), finite("value")).alias("v"))
    outer = exact_quantiles(seen, "v", (0.01, 0.99), "factor").select("factor", at(0).alias("value_p01"), at(1).alias("value_p99"))
    whole = long.groupBy("factor").agg(share.alias("non_null_frac"))
    for part in (by("date", "date_coverage_p50"), by("asset_id", "stock_coverage_p50"), outer):  # a row a factor
        whole = whole.join(F.broadcast(part), "factor", "left")
    return whole.select("factor", "non_null_frac", "date_coverage_p50", "stock_coverage_p50", "value_p01", "value_p99").orderBy("factor")


def display_tables(raw: DataFrame, tradable: DataFrame, summary: DataFrame, removed: DataFrame) -> dict[str, DataFrame]:
    """The four views: overview, tails, cleaning_impact, suspect_event_qa."""
    prices = raw.unionByName(tradable)
    counts = [c for c in summary.columns if c.startswith("n_")]
    return {
        "overview": prices.select("scope", F.col("n_observed_prices").cast("long").alias("observed_prices")),
        "tails": prices.select("scope", "ret_min", "ret_p01", "ret_p99", "ret_p999", "ret_max"),
        "cleaning_impact": removed.select(F.col("removed_prices").cast("long"), F.col("assets_affected").cast("long"), "removed_frac"),
        "suspect_event_qa": summary.select([F.col(c).cast("long").alias(c) for c in counts]).unpivot([], counts, "metric", "value"),
    }


