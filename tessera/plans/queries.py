"""One query for each operator family of the panel engine, on the star schema's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import across
from tessera.functions.stages import stage
from tessera.operators import backtest, cleaning, crosssection, evaluation, factors, grid, moving, qc, ridge, timeseries, universe
from tessera.operators.grid import align_factors_left, renumber
from tessera.operators.moving import add_average_dollar_volume
from tessera.operators.timeblocks import add_running, as_of_by_blocks, cut, joined
from tessera.plans import demo, pipeline, protocol, refresh, views
from tessera.plans.pipeline import Inputs
from tessera.sources import market, signals
from tessera.streaming.bars import bars as tumbling_bars

Query = Callable[[SparkSession, str], DataFrame]


def r6(c: str | Column, name: str | None = None) -> Column:
    """Rounded to six decimals, without a negative zero."""
    name = name or (c if isinstance(c, str) else "value")
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)).alias(name)


def cells(df: DataFrame, *names: str) -> DataFrame:
    return df.select("asset_id", "date", *[r6(n) for n in names])


def bars_month(s, d):
    return cells(demo.bars(s, d), "price", "dollar_volume")


def bars_week(s, d):
    return cells(demo.bars(s, d, "week"), "price", "dollar_volume")


def dense_panel(s, d):
    return demo.grid(s, d, "week").select("asset_id", "date", F.col("t").cast("long").alias("t"), r6("price"))


def sanitize_prices(s, d):
    dirty = F.when(F.col("asset_id") % 11 == 0, F.lit(float("inf"))).when(F.col("asset_id") % 7 == 0, F.lit(0.0)).when(F.col("asset_id") % 5 == 0, -F.col("price")).otherwise(F.col("price"))
    return cells(demo.bars(s, d).withColumn("price", market.usable_price(dirty)), "price")


def clean_hard_events(s, d):
    return demo.clean(s, d, "week").select("asset_id", "date", "hard", r6("price"))


def _suspects(flag: str) -> Query:
    def query(s, d):
        rules = cleaning.CleaningRules(classify_min_return=0.5, reversal_next_abs_return=0.3, reversal_two_day_net_abs=0.3, stale_lookback=2, stale_epsilon=0.05, shift_horizon=5)
        flagged = cleaning.flag_events(demo.grid(s, d, "week"), rules)
        return flagged.where("candidate").select("asset_id", "date", flag, "suspect")

    return query


def clean_summary(s, d):
    return cleaning.cleaning_summary(demo.clean(s, d, "week"))


def sparse_date_filter(s, d):
    kept = cleaning.drop_sparse_dates(demo.grid(s, d, "week"), 8)
    return kept.groupBy("date").agg(F.first("t").cast("long").alias("t"), F.count("price").alias("n_prices"))


def drop_empty_assets(s, d):
    late = demo.grid(s, d).withColumn("price", F.when(F.col("asset_id") % 3 != 0, F.col("price")))
    return cleaning.drop_empty_assets(late).groupBy("asset_id").agg(F.count("price").alias("n_prices"))


def quality_mask(s, d):
    return cleaning.quality_mask(demo.clean(s, d, "week"), 12, 1, 0.8).select("asset_id", "date", "quality_ok")


def two_pass_clean(s, d):
    out = cleaning.clean_panel(demo.grid(s, d, "week"), demo.RULES, 8, 12, 1, 0.8)
    return out.prices.select("asset_id", "date", F.col("t").cast("long").alias("t"), r6("price"), "quality_ok")


def returns(s, d):
    return cells(demo.returns(s, d), "ret")


def future_returns(s, d):
    return cells(timeseries.add_future_returns(demo.clean(s, d).select("asset_id", "date", "t", "price")), "fwd_ret")


def rolling_compound(s, d):
    return cells(demo.returns(s, d).withColumn("compounded", timeseries.compounded("ret", 6)), "compounded")


def windows_by_blocks(s, d):
    """Returns, momentum, reversal and dollar volume of blocks of two years of monthly bars, each with the 13 rows before it."""
    panel = stage(demo.clean(s, d).select("asset_id", "date", "t", "price", "dollar_volume"), "clean")
    made = timeseries.add_returns(cut(panel, 13, 24)).withColumn("momentum", timeseries.momentum(12, 1)).withColumn("reversal", timeseries.reversal(3))
    return cells(joined(add_average_dollar_volume(made, "adv", 3)), "ret", "momentum", "reversal", "adv")


def momentum(s, d):
    return cells(demo.returns(s, d).withColumn("momentum", timeseries.momentum(12, 1)), "momentum")


def reversal(s, d):
    return cells(demo.returns(s, d).withColumn("reversal", timeseries.reversal(3)), "reversal")


def loo_market(s, d):
    return cells(demo.returns(s, d).withColumn("mkt", timeseries.leave_one_out_market()), "mkt")


def low_vol(s, d):
    return cells(factors.price_factors(demo.returns(s, d), demo.LOOKS, ["low_vol"]), "low_vol")


def low_vol_year(s, d):
    """At a production length: 252 rows of weekly bars."""
    made = timeseries.add_leave_one_out_market(demo.returns(s, d, "week"))
    return cells(moving.add_low_volatility(made, "low_vol", "mkt", "ret", 252, 200), "low_vol")


def adv(s, d):
    return cells(moving.add_average_dollar_volume(demo.grid(s, d), "adv", 3), "adv")


def terminal_missing(s, d):
    out = timeseries.add_terminal_missing(demo.returns(s, d, "week"), "fwd_ret")
    return out.where("terminal").groupBy("asset_id").agg(F.count("*").alias("n_terminal"), F.min("date").alias("since"))


def rebalance_me(s, d):
    return timeseries.rebalance_dates(demo.bars(s, d, "day"), "ME")


def rebalance_wfri(s, d):
    return timeseries.rebalance_dates(demo.bars(s, d, "day"), "W-FRI")


def period_forward_returns(s, d):
    panel = demo.clean(s, d, "week").select("asset_id", "date", "t", "price")
    return cells(timeseries.period_forward_returns(panel, timeseries.rebalance_dates(panel, "ME")), "fwd_ret")


def _scored(s, d) -> DataFrame:
    """Price factors of clean monthly bars, with returns; written, since winsorizing and standardizing read them several times."""
    return stage(factors.price_factors(demo.returns(s, d), demo.LOOKS), "price-factors", by="asset_id", dealt=True)


PRICED = ["momentum", "reversal", "low_vol"]


def winsorize(s, d):
    return cells(crosssection.winsorize(_scored(s, d), PRICED, 0.05, 0.95), *PRICED)


def zscore(s, d):
    return cells(crosssection.standardize(_scored(s, d), PRICED), *PRICED)


def component_mean(s, d):
    return cells(_scored(s, d).withColumn("mean", crosssection.mean_of_available(PRICED, 2)), "mean")


def sector_map(s, d):
    companies = demo.sectors(s, d).withColumn("sector", F.when(F.col("asset_id") % 4 != 0, F.col("sector")).otherwise(" "))
    return market.sector_map(companies.select("asset_id"), companies)


def sector_neutral(s, d):
    return cells(crosssection.sector_neutralize(_scored(s, d).join(F.broadcast(demo.sectors(s, d)), "asset_id", "left"), PRICED), *PRICED)


def _with_beta(s, d) -> DataFrame:
    return moving.add_rolling_beta(_scored(s, d).withColumn("mkt", F.avg("ret").over(across())), "beta", "mkt", "ret", 12, 6)


def rolling_beta(s, d):
    return cells(_with_beta(s, d), "beta")


def market_neutral(s, d):
    return cells(crosssection.market_neutralize(_with_beta(s, d), PRICED), *PRICED)


def _standardized(s, d) -> DataFrame:
    return crosssection.standardize(crosssection.winsorize(_scored(s, d), PRICED), PRICED)


def composite_ew(s, d):
    return cells(_standardized(s, d).withColumn("composite", crosssection.equal_weight(PRICED, [])), "composite")


def composite_candidate(s, d):
    panel = _standardized(s, d)
    return cells(panel.withColumn("composite", crosssection.candidate_composite(panel, ["reversal", "absent", "momentum", "low_vol"])), "composite")


def _universe(s, d) -> DataFrame:
    masked = cleaning.quality_mask(demo.clean(s, d), 12, 1, 0.9)
    panel = timeseries.add_returns(masked.drop("ret")).withColumn("required_ok", timeseries.momentum(12, 1).isNotNull())
    return universe.universe(stage(panel, "uncapped", by="asset_id", dealt=True), 20, 3, 900.0)


def universe_mask(s, d):
    return _universe(s, d).select("asset_id", "date", "in_universe", "raw_selected", r6("adv"))


def universe_diagnostics(s, d):
    return universe.universe_diagnostics(_universe(s, d))


def tradable_scores(s, d):
    panel = _universe(s, d).withColumn("score", timeseries.reversal(3))
    return cells(universe.tradable(panel, "score", []), "score").where("score is not null")


def publish_align(s, d):
    out = market.publish_aligned(demo.statements(s, d), 1, "keep_last")
    return out.select("asset_id", "eff_date", F.col("ingest_seq").cast("long").alias("ingest_seq"), r6("revenue"))


def business_days(s, d):
    days = demo.bars(s, d, "day").select("date").distinct()
    return days.select("date", *[market.add_business_days("date", n).alias(f"plus_{n}") for n in (1, 2, 7)])


def dedupe_keep_last(s, d):
    rows = demo.statements(s, d).select("asset_id", F.col("report_date").alias("date"), "ingest_seq", "revenue")
    out = market.canonical(rows, demo.sectors(s, d).where("sector <> 'ASIA'").select("asset_id"), dedupe=True)
    return out.select("asset_id", "date", F.col("ingest_seq").cast("long").alias("ingest_seq"), r6("revenue"))


def asof_signals(s, d):
    known = market.publish_aligned(demo.statements(s, d), 1, "keep_last")
    return cells(market.as_of(demo.grid(s, d).select("asset_id", "date"), known, ["revenue", "net_income"]), "revenue", "net_income")


def asof_by_blocks(s, d):
    """asof_signals with each asset's history in blocks of 500 days."""
    known = stage(market.publish_aligned(demo.statements(s, d), 1, "keep_last").select("asset_id", "eff_date", "revenue", "net_income"), "known")
    return cells(as_of_by_blocks(demo.grid(s, d).select("asset_id", "date"), known, ["revenue", "net_income"], 500), "revenue", "net_income")


def daily_signal_ffill(s, d):
    known = demo.bars(s, d, "week").where(F.month("date").isin(1, 7)).select("asset_id", "date", F.col("price").alias("roa"))
    return cells(factors.daily_signals(known, demo.grid(s, d, "week"), 10, ["roa"]), "roa")


def growth_yoy(s, d):
    known = market.publish_aligned(demo.statements(s, d), 1, "keep_last")
    return signals.growth(known, "revenue", "sales_growth").select("asset_id", "eff_date", r6("sales_growth"))


def signals_all(s, d):
    names = ["book_market", "earnings_yield", "roa", "asset_turnover", "debt_ratio", "operating_margin", "assets_growth", "sales_growth"]
    return cells(demo.signal_rows(s, d), *names)


def _styles(s, d) -> DataFrame:
    cells = stage(demo.grid(s, d), "grid", by="asset_id", dealt=True)
    return stage(factors.daily_signals(demo.signal_rows(s, d, cells), cells, 12), "signals", by="asset_id", dealt=True)


def value_factor(s, d):
    return cells(factors.value(_styles(s, d)), "value")


def quality_factor(s, d):
    return cells(factors.quality(_styles(s, d)), "quality")


def invest_factor(s, d):
    return cells(factors.invest(_styles(s, d)), "invest")


def growth_factor(s, d):
    return cells(factors.growth(_styles(s, d)), "growth")


def align_left(s, d):
    moved = demo.returns(s, d).where("ret is not null").select("asset_id", "date", "t", F.col("price").alias("x"))
    return cells(align_factors_left(moved, demo.returns(s, d).select("asset_id", "date", "t", "ret")), "ret", "x")


def align_outer(s, d):
    """Monthly returns beside the later of two prices; either side lacks cells that the other has."""
    moved = demo.returns(s, d).where("ret is not null").select("asset_id", "date", "t", "ret")
    ahead = demo.returns(s, d).where("fwd_ret is not null").select("asset_id", "date", "t", "fwd_ret")
    return cells(grid.align_outer(moved, ahead), "ret", "fwd_ret")


def mask_reindex(s, d):
    """A mask on the cells that have a return, on the whole grid; the other cells are false."""
    mask = demo.returns(s, d).where("ret is not null").select("asset_id", "date", (F.col("ret") > 0).alias("rose"))
    return grid.with_mask(demo.returns(s, d), mask, "rose", False).select("asset_id", "date", "rose")


def _pairs(s, d) -> DataFrame:
    panel = crosssection.standardize(crosssection.winsorize(_scored(s, d), ["momentum"]), ["momentum"])
    return panel.select("asset_id", "date", "t", F.col("momentum").alias("score"), "fwd_ret", "price")


def _ic(s, d) -> DataFrame:
    return evaluation.ic_series(_pairs(s, d), 5)


def ic_momentum(s, d):
    return _ic(s, d).select("date", r6("ic"), "n")


def ic_period(s, d):
    panel = _pairs(s, d)
    pairs = evaluation.ic_inputs(panel, panel, "QE", panel)
    return evaluation.ic_series(pairs, 5).select("date", r6("ic"), "n")


def ic_stats(s, d):
    out = evaluation.ic_stats(_ic(s, d))
    return out.select(*[r6(c) for c in out.columns if c not in ("n_obs", "nw_lag")], "n_obs", F.col("nw_lag").cast("long").alias("nw_lag"))


def ic_acf(s, d):
    return evaluation.ic_autocorrelation(_ic(s, d)).select(F.col("lag").cast("long").alias("lag"), r6("acf"))


def ic_coverage(s, d):
    panel = _pairs(s, d)
    out = evaluation.ic_coverage(panel, panel.select("asset_id", "date", F.col("price").isNotNull().alias("base")), 90)
    return out.select("n_dates_below_min", r6("coverage_p10"))


def decile_weights(s, d):
    return crosssection.decile_weights(_pairs(s, d)).select("asset_id", "date", "book", r6("weight"))


def _backtest(s, d):
    panel = _pairs(s, d)
    return backtest.long_short_backtest(panel, panel.select("asset_id", "date", "t", "fwd_ret"), "QE", 0.001, 0.03)


def backtest_equity(s, d):
    return _backtest(s, d).curve.select("date", r6("ret"), r6("equity"))


def equity_by_blocks(s, d):
    """backtest_equity as a scan over years, and the highest equity so far."""
    curve = _backtest(s, d).curve.select("date", "ret")
    grown = stage(add_running(curve, {"equity": ("product", 1 + F.col("ret"))}, F.year("date"), "date", []), "equity")
    out = add_running(grown, {"peak": ("max", F.col("equity"))}, F.year("date"), "date", [])
    return out.select("date", r6("equity"), r6("peak"))


def backtest_summary(s, d):
    return _backtest(s, d).summary.select(r6("turnover_mean"), r6("turnover_cost_drag_ann"), r6("borrow_cost_drag_ann"))


def performance_stats(s, d):
    return evaluation.performance_stats(_backtest(s, d).curve).select(r6("annual_vol"), r6("sharpe"), r6("max_drawdown"))


def price_qc(s, d):
    out = qc.price_summary(demo.grid(s, d, "week"), "raw")
    return out.select("scope", "n_observed_prices", *[r6(c) for c in ("ret_min", "ret_p01", "ret_p99", "ret_p999", "ret_max")])


def removed_prices(s, d):
    out = qc.removed_prices(demo.grid(s, d, "week"), demo.clean(s, d, "week"))
    return out.select("removed_prices", "assets_affected", r6("removed_frac"))


def factor_qc(s, d):
    panel = _scored(s, d).withColumn("base", F.col("price").isNotNull() & (F.col("t") > 6))
    out = qc.factor_summary(panel, PRICED, "base")
    return out.select("factor", *[r6(c) for c in out.columns if c != "factor"])


def qc_display(s, d):
    """The four display tables of a cleaning, as rows (view, scope, name, value)."""
    before = stage(demo.grid(s, d, "week"), "grid", by="asset_id", dealt=True)
    flagged = stage(cleaning.clean_prices(before, demo.RULES), "clean", by="asset_id", dealt=True)
    after = flagged.select("asset_id", "date", "t", "price")
    views = qc.display_tables(qc.price_summary(before, "raw"), qc.price_summary(after, "tradable"), cleaning.cleaning_summary(flagged), qc.removed_prices(before, after))
    made = None
    for view, table in views.items():
        if view == "suspect_event_qa":
            rows = table.select(F.lit(None).cast("string").alias("scope"), F.col("metric").alias("name"), F.col("value").cast("double").alias("value"))
        else:
            keep = table if "scope" in table.columns else table.withColumn("scope", F.lit(None).cast("string"))
            names = [c for c in keep.columns if c != "scope"]
            rows = keep.select("scope", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["scope"], names, "name", "value")
        rows = rows.select(F.lit(view).alias("view"), "scope", "name", r6("value"))
        made = rows if made is None else made.unionByName(rows)
    return made


def _report(s, d) -> DataFrame:
    return protocol.train_factor_report(_standardized(s, d), PRICED, "1996-01-01", "1999-12-31", "QE", 5)


def factor_report(s, d):
    out = _report(s, d)
    return out.select("factor", "train_ic_n_obs", *[r6(c) for c in out.columns if c not in ("factor", "train_ic_n_obs")])


def stable_negative_screen(s, d):
    return protocol.drop_stably_negative(_report(s, d)).select("factor")


def validation_matrix(s, d):
    panel = _standardized(s, d)
    panel = protocol.candidate_panels(panel, {"both": ["momentum", "reversal"]})
    out = protocol.validation_matrix({"momentum": "momentum", "reversal": "reversal", "both": "both"}, panel, "1997-01-01", "2000-12-31", "QE", 0.001, 0.03, 5)
    return out.select("construct", *[r6(c) for c in out.columns if c != "construct"])


def _ridge_rows(s, d) -> DataFrame:
    panel = _standardized(s, d)
    return ridge.ridge_rows(panel, panel, panel, "QE", PRICED)


def ridge_moments(s, d):
    out = ridge.ridge_moments(_ridge_rows(s, d), PRICED)
    return out.select("date", "n", *[r6(c) for c in ("sy", "sx_0", "sxy_0", "sxx_0_0", "sxx_0_1", "sxx_1_2")])


def ridge_scores(s, d):
    panel = _standardized(s, d)
    out = ridge.ridge_scores(panel, panel, panel, "QE", PRICED, 10.0, demo.SETTINGS.model.ridge)
    return cells(out, "score")


def ridge_alpha_table(s, d):
    panel = _standardized(s, d)
    fit = ridge.tune_ridge(panel, panel, panel, "QE", PRICED, "2000-01-01", (0.1, 10.0, 1000.0), demo.SETTINGS.model.ridge, 5)
    return fit.table.select("alpha", r6("pre_mean_ic"), "pre_n_obs")


def _core(s, d):
    sold = demo.sales(s, d)
    cells = stage(demo.grid_of(sold), "grid", by="asset_id", dealt=True)
    return pipeline.run_core(Inputs(cells.where("price is not null"), {}), demo.SETTINGS, demo.signal_rows(s, d, cells, sold), cells)


def research_core(s, d):
    return _core(s, d).panel.where("tradable").select("asset_id", "date", r6("score"), r6("fwd_ret"))


def research_run(s, d):
    out = pipeline.evaluate(_core(s, d), demo.SETTINGS)
    return out.ic_stats.select(r6("mean_ic"), r6("t_newey_west"), "n_obs").crossJoin(out.performance.select(r6("annual_vol"), r6("sharpe"), r6("max_drawdown")))


def sql_over_views(s, d):
    """The run's information coefficient of each date, by SQL over the views of its stages."""
    views.register(_core(s, d), "demo")
    ranks = "rank() over (partition by date order by {0}) + (count(*) over (partition by date, {0}) - 1) / 2.0"
    out = s.sql(f"""
        select date, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) as ic, count(*) as n
        from (select date, {ranks.format('score')} as x, {ranks.format('fwd_ret')} as y from demo_tradable where score is not null and fwd_ret is not null)
        group by date having count(*) >= 5 and stddev_pop(x) * stddev_pop(y) > 0""")
    return out.select("date", r6("ic"), "n")


def event_bars(s, d):
    ticks = demo.table(s, d, "events").select(F.col("user_id").alias("asset_id"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"))
    out = tumbling_bars(ticks)
    return out.select("asset_id", F.col("start").cast("date").alias("date"), r6("vwap"), r6("volume"), "n")


def renumbered(s, d):
    return renumber(demo.grid(s, d).where(F.month("date") != 2)).groupBy("date").agg(F.max("t").cast("long").alias("t"))


def refreshed(s, d):
    """Monthly bars in three runs, each from the tail of the one before, as if they had been one run."""
    bars, tail, parts = stage(demo.bars(s, d), "bars"), None, []
    windows = refresh.Windows(12, 1, 3, 12, 1, 0.8, demo.RULES)
    for start, end in (("1900-01-01", "1995-01-01"), ("1995-01-01", "1997-01-01"), ("1997-01-01", "2100-01-01")):
        step = refresh.refresh(bars.where(F.col("date").between(start, F.date_sub(F.lit(end), 1))), tail, windows)
        tail = step.tail
        parts.append(step.cells)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("price is not null")
    return whole.select("asset_id", "date", F.col("t").cast("long").alias("t"), "hard", "quality_ok", *[r6(c) for c in ("price", "momentum", "adv")])


QUERIES: dict[str, Query] = {
    "suspect_spike_reversal": _suspects("spike"), "suspect_persistent_shift": _suspects("shift"), "suspect_stale_jump": _suspects("stale"),
} | {
    f.__name__: f
    for f in (
        bars_month, bars_week, dense_panel, sanitize_prices, clean_hard_events, clean_summary, sparse_date_filter, drop_empty_assets, quality_mask, two_pass_clean,
        returns, future_returns, rolling_compound, windows_by_blocks, momentum, reversal, loo_market, low_vol, low_vol_year, adv, terminal_missing, rebalance_me, rebalance_wfri,
        period_forward_returns, winsorize, zscore, component_mean, sector_map, sector_neutral, rolling_beta, market_neutral, composite_ew, composite_candidate,
        universe_mask, universe_diagnostics, tradable_scores, publish_align, business_days, dedupe_keep_last, asof_signals, asof_by_blocks, daily_signal_ffill, growth_yoy, signals_all,
        value_factor, quality_factor, invest_factor, growth_factor, align_left, align_outer, mask_reindex, ic_momentum, ic_period, ic_stats, ic_acf, ic_coverage, decile_weights,
        backtest_equity, equity_by_blocks, backtest_summary, performance_stats, price_qc, removed_prices, factor_qc, qc_display, factor_report, stable_negative_screen, validation_matrix,
        ridge_moments, ridge_scores, ridge_alpha_table, research_core, research_run, sql_over_views, event_bars, renumbered, refreshed,
    )
}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: monthly IC of momentum on clean bars."""
    return ic_momentum(spark, sf_dir)


