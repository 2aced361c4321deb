"""The validation protocol: train reports, factor selection, and the matrix of constructs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.stages import stage
from tessera.operators import backtest, evaluation
from tessera.operators.crosssection import candidate_composite
from tessera.operators.grid import slice_dates
from tessera.operators.qc import melt_factors
from tessera.operators.ridge import RidgeSettings, tune_ridge

SELECTION_RULES = ("all", "drop_stably_negative")
COMBINE_METHODS = ("ew", "ridge")


def first_half(date: Column, start: str, end: str) -> Column:
    """Whether a date of the window is in its first half. Halves are whole calendar years; of an odd number
    of years the middle one is in the first, so a window within one year has no second half."""
    begin, stop = int(start[:4]), int(end[:4])
    if stop < begin:
        raise ValueError(f"the train window ends in {stop}, before it begins in {begin}")
    return F.year(date) <= (begin + stop) // 2


def train_factor_report(panel: DataFrame, factors: Sequence[str], start: str, end: str, freq: str | None, ic_min_assets: int = 50) -> DataFrame:
    """A row a factor over the train window (panel: price, fwd_ret and factors), best first: mean IC, its
    Newey-West t, its number and its means over the two halves. All factors go through one job."""
    if not factors:
        raise ValueError("a train report needs a factor at least")
    window = stage(slice_dates(panel, start, end).select("asset_id", "date", "t", "price", "fwd_ret", *factors), "train-window")
    filled = window.agg(*[F.count(f).alias(f) for f in factors]).first()
    if missing := [f for f in factors if not filled[f]]:
        raise ValueError(f"nothing between {start} and {end} in {missing}")
    early = first_half(F.col("date"), start, end)
    long = melt_factors(window.select("asset_id", "date", "t", *factors), factors).withColumnRenamed("value", "score")
    pairs = evaluation.ic_inputs(long, window.select("asset_id", "date", "t", "fwd_ret"), freq, window.select("asset_id", "date", "t", "price"), "score", "factor")
    ic = stage(evaluation.ic_series(pairs, ic_min_assets, "score", "fwd_ret", "factor"), "train-ic")
    stats = evaluation.ic_stats(ic, None, "factor")
    halves = ic.groupBy("factor").agg(F.avg(F.when(early, F.col("ic"))).alias("train_ic_mean_first_half"), F.avg(F.when(~early, F.col("ic"))).alias("train_ic_mean_second_half"))
    named = panel.sparkSession.createDataFrame([(f,) for f in factors], "factor string")
    out = named.join(stats, "factor", "left").join(halves, "factor", "left")
    return out.select(
        "factor", F.col("mean_ic").alias("train_ic_mean_spearman"), F.col("t_newey_west").alias("train_ic_t_nw_spearman"),
        F.coalesce("n_obs", F.lit(0)).cast("long").alias("train_ic_n_obs"), "train_ic_mean_first_half", "train_ic_mean_second_half",
    ).orderBy(F.desc_nulls_last("train_ic_t_nw_spearman"), F.desc_nulls_last("train_ic_mean_spearman"))


def drop_stably_negative(report: DataFrame) -> DataFrame:
    """The report without factors whose mean is negative as a whole and in both halves; a missing mean is not negative."""
    below = lambda c: F.coalesce(F.col(c) < 0, F.lit(False))
    return report.where(~(below("train_ic_mean_spearman") & below("train_ic_mean_first_half") & below("train_ic_mean_second_half")))


def select_factors(report: DataFrame, rule: str) -> list[str]:
    """Factor names, best first (a row a factor comes to the driver)."""
    if rule not in SELECTION_RULES:
        raise ValueError(f"{rule!r} is no rule of selection; there are {SELECTION_RULES}")
    kept = report if rule == "all" else drop_stably_negative(report)
    return [r["factor"] for r in kept.collect()]


def window_metrics(
    scores: DataFrame, panel: DataFrame, freq: str | None, turnover_cost: float, borrow_cost_annual: float, ic_min_assets: int = 50, with_ic: bool = True, extra: Sequence[str] = (),
) -> DataFrame:
    """A row for each key: IC and backtest metrics of the scores with the panel's returns and prices."""
    returns = panel.select("asset_id", "date", "t", "fwd_ret")
    result = backtest.long_short_backtest(scores, returns, freq, turnover_cost, borrow_cost_annual, "score", extra)
    out = evaluation.performance_stats(result.curve, 252, *extra)
    out = out.join(result.summary, list(extra)) if extra else out.crossJoin(result.summary)
    if not with_ic:
        return out
    pairs = evaluation.ic_inputs(scores, returns, freq, panel.select("asset_id", "date", "t", "price"), "score", *extra)
    stats = evaluation.ic_stats(stage(evaluation.ic_series(pairs, ic_min_assets, "score", "fwd_ret", *extra), "window-ic"), None, *extra)
    stats = stats.select(*extra, "mean_ic", F.col("t_newey_west").alias("t_ic_newey_west"), F.col("n_obs").alias("ic_n_obs"))
    return out.join(stats, list(extra), "left") if extra else out.crossJoin(stats)


def validation_matrix(
    constructs: Mapping[str, str], panel: DataFrame, start: str, end: str, freq: str | None, turnover_cost: float, borrow_cost_annual: float, ic_min_assets: int = 50
) -> DataFrame:
    """A row a construct (a name and the panel's column with its score), best first: net and gross
    metrics over the window. All constructs go through one job, keyed by name."""
    window = stage(slice_dates(panel, start, end).select("asset_id", "date", "t", "price", "fwd_ret", *dict.fromkeys(constructs.values())), "validation-window")
    renamed = window.select("asset_id", "date", "t", *[F.col(c).alias(n) for n, c in constructs.items()])
    scores = melt_factors(renamed, list(constructs)).select("asset_id", "date", "t", F.col("factor").alias("construct"), F.col("value").alias("score"))
    key = ("construct",)
    net = window_metrics(scores, window, freq, turnover_cost, borrow_cost_annual, ic_min_assets, True, key)
    gross = window_metrics(scores, window, freq, 0.0, 0.0, ic_min_assets, False, key).select("construct", F.col("sharpe").alias("sharpe_gross"))
    return net.join(gross, "construct").select(
        "construct", "mean_ic", "t_ic_newey_west", "sharpe_gross", F.col("sharpe").alias("sharpe_net"), F.col("max_drawdown").alias("max_drawdown_net"),
        "turnover_mean", "turnover_cost_drag_ann", "borrow_cost_drag_ann",
    ).orderBy(F.desc_nulls_last("sharpe_net"), F.desc_nulls_last("t_ic_newey_west"))


def candidate_panels(panel: DataFrame, candidates: Mapping[str, Sequence[str]]) -> DataFrame:
    """The panel with a composite column for each candidate list of factors."""
    return panel.withColumns({name: candidate_composite(panel, names) for name, names in candidates.items()})


def selected_scores(
    panel: DataFrame, factors: Sequence[str], combine: str, rule: str, train_start: str, train_end: str, freq: str | None, score_start: str, score_end: str | None = None,
    alphas: Sequence[float] | None = None, refit_every: int | None = None, window_type: str = "rolling", window_size: int | None = None,
) -> DataFrame:
    """(asset_id, date, t, score) over the scoring window, from factors selected on the train window."""
    if combine not in COMBINE_METHODS:
        raise ValueError(f"scores are combined by one of {COMBINE_METHODS}, not by {combine!r}")
    settings = None
    if combine == "ridge":
        if not alphas or not refit_every:
            raise ValueError("ridge scores need penalties (alphas) and how often to refit (refit_every)")
        settings = RidgeSettings(window_type, window_size, refit_every=refit_every)
        settings.oldest(1)
    chosen = select_factors(train_factor_report(panel, factors, train_start, train_end, freq), rule)
    if settings:
        scores = tune_ridge(panel, panel, panel, freq, chosen, score_start, alphas, settings).scores
    else:
        scores = panel.select("asset_id", "date", "t", candidate_composite(panel, chosen).alias("score"))
    return slice_dates(scores, score_start, score_end)
