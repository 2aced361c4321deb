"""The long/short decile backtest, in closed form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import ratio, require_rows
from tessera.functions.stages import stage
from tessera.operators.crosssection import decile_weights
from tessera.operators.grid import align_inner
from tessera.operators.timeseries import add_terminal_missing, period_of


@dataclass
class Backtest:
    """curve: (…, date, ret, equity); summary: turnover_mean and the yearly drags, a row for each key."""

    curve: DataFrame
    summary: DataFrame


def long_short_backtest(
    scores: DataFrame, returns: DataFrame, freq: str | None = "ME", turnover_cost: float = 0.001, borrow_cost_annual: float = 0.0,
    score: str = "score", extra: Sequence[str] = (),
) -> Backtest:
    """Hold the deciles of the last rebalance date; between those, weights drift.

    The drift has a closed form: within a period a weight is its target times the compounded
    growth since the period's start, over the sum of those of its book. So nothing
    goes from date to date: growth is a running product of each (period, book, asset),
    a book's total is by date, turnover joins each period's targets to where the last
    period's weights ended. A held asset whose return is missing for good loses
    everything; other missing returns are 0. Rows are only those of held assets, a fifth of the panel at most.
    """
    if turnover_cost < 0:
        raise ValueError(f"turnover can't earn money: cost {turnover_cost}")
    if borrow_cost_annual < 0:
        raise ValueError(f"borrowing can't earn money: cost {borrow_cost_annual}")
    key = list(extra)
    scores = stage(scores.select(*key, "asset_id", "date", "t", score), "backtest-scores")
    known = add_terminal_missing(returns.select("asset_id", "date", "t", "fwd_ret").join(scores.select("date").distinct(), "date", "left_semi"), "fwd_ret")
    gone = stage(known.select("asset_id", "date", "fwd_ret", "terminal"), "backtest-returns")
    cells = align_inner(scores, gone.select("asset_id", "date", "fwd_ret"))
    dates = cells.select(*key, "date").distinct()
    by_key = Window.partitionBy(*key)
    dated = dates.withColumn("end", period_of("date", freq)).withColumn("is_rebalance", F.col("date") == F.max("date").over(Window.partitionBy(*key, "end")))
    along = by_key.orderBy("date")
    dated = dated.withColumn("start", F.last(F.when(F.col("is_rebalance"), F.col("date")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    dated = dated.withColumn("period", F.sum(F.col("is_rebalance").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))).select(*key, "date", "start", "period", "is_rebalance")
    dated = require_rows(stage(dated, "backtest-dates"), "scores and returns share no date to rebalance on")
    targets = stage(decile_weights(cells.join(F.broadcast(dated.where("is_rebalance")), [*key, "date"], "left_semi"), score, *key), "backtest-targets")
    held = (
        targets.select(*key, "asset_id", F.col("date").alias("start"), "book", F.col("weight").alias("target"))
        .join(F.broadcast(dated), [*key, "start"])
        .join(gone, ["asset_id", "date"])
        .withColumn("r", F.when(F.col("fwd_ret").isNull() & F.col("terminal"), -1.0).otherwise(F.coalesce("fwd_ret", F.lit(0.0))))
    )
    path = Window.partitionBy(*key, "period", "book", "asset_id").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    grown = held.withColumn("grown", F.col("target") * F.coalesce(F.product(1 + F.col("r")).over(path), F.lit(1.0)))
    book = Window.partitionBy(*key, "date", "book")
    weighted = grown.withColumn("weight", F.coalesce(ratio(F.col("grown"), F.sum("grown").over(book)), F.lit(0.0)))
    after = weighted.withColumn("ended", F.col("grown") * (1 + F.col("r"))).withColumn("drifted", F.coalesce(ratio(F.col("ended"), F.sum("ended").over(book)), F.lit(0.0)))
    after = stage(after.select(*key, "asset_id", "date", "period", "book", "r", "weight", "drifted"), "backtest-weights")
    sign = F.when(F.col("book") == "long", 1.0).otherwise(-1.0)
    gross = after.groupBy(*key, "date").agg(
        F.sum(sign * F.col("weight") * F.col("r")).alias("gross"), F.sum(F.when(F.col("book") == "short", F.col("weight")).otherwise(0.0)).alias("short_weight")
    )
    last_day = dated.groupBy(*key, "period").agg(F.max("date").alias("date"))
    ends = after.join(F.broadcast(last_day), [*key, "period", "date"]).select(*key, (F.col("period") + 1).alias("period"), "book", "asset_id", "drifted")
    begins = targets.join(F.broadcast(dated), [*key, "date"]).select(*key, "period", "book", "asset_id", F.col("weight").alias("aim"))
    turnover = (
        begins.join(ends, [*key, "period", "book", "asset_id"], "full")
        .groupBy(*key, "period").agg(F.sum(F.abs(F.coalesce("aim", F.lit(0.0)) - F.coalesce("drifted", F.lit(0.0)))).alias("turnover"))
    )
    moved = dated.where("is_rebalance").join(turnover, [*key, "period"], "left").select(*key, "date", F.coalesce("turnover", F.lit(0.0)).alias("turnover"))
    daily = (
        dated.join(gross, [*key, "date"], "left").join(moved, [*key, "date"], "left")
        .withColumn("turnover_cost", turnover_cost * F.coalesce("turnover", F.lit(0.0)))
        .withColumn("borrow_cost", borrow_cost_annual / 252.0 * F.coalesce("short_weight", F.lit(0.0)))
        .withColumn("ret", F.coalesce("gross", F.lit(0.0)) - F.col("turnover_cost") - F.col("borrow_cost"))
    )
    daily = stage(daily.select(*key, "date", "ret", "turnover", "turnover_cost", "borrow_cost"), "backtest-days")
    curve = daily.select(*key, "date", "ret", F.product(1 + F.col("ret")).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("equity"))
    summary = daily.groupBy(*key).agg(
        F.avg("turnover").alias("turnover_mean"), (F.avg("turnover_cost") * 252.0).alias("turnover_cost_drag_ann"), (F.avg("borrow_cost") * 252.0).alias("borrow_cost_drag_ann")
    )
    return Backtest(curve, summary)
