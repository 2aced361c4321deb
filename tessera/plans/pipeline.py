"""The research run: from market rows and statements to scores, universe and evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import require_rows
from tessera.functions.stages import stage
from tessera.operators import backtest, cleaning, crosssection, evaluation, factors, moving, qc, ridge, timeseries, universe
from tessera.operators.grid import align_factors_left
from tessera.plans.settings import Settings
from tessera.sources import market, signals
from tessera.sources.market import Source


@dataclass
class Inputs:
    """rows: market rows; statements: the sets by name; sectors: (asset_id, sector) and market: (date, mkt), for those modes."""

    rows: DataFrame
    statements: dict[str, DataFrame]
    sectors: DataFrame | None = None
    market: DataFrame | None = None


class _Asked:
    """A field given as a table, or as a function that makes the table when it is first asked for."""

    def __set_name__(self, owner, name: str) -> None:
        self.name = f"_{name}"

    def __get__(self, core, owner=None) -> DataFrame:
        if core is None:
            raise AttributeError(self.name)  # the field has no default
        found = getattr(core, self.name)
        if callable(found):
            found = found()
            setattr(core, self.name, found)
        return found

    def __set__(self, core, given) -> None:
        setattr(core, self.name, given)


@dataclass
class Core:
    """panel: a row a cell with price, fwd_ret, the score, all factors and the masks, tradable ones only;
    unmasked: the same before the mask. The quality tables are made when they are asked for, since their exact quantiles take jobs of their own."""

    panel: DataFrame
    unmasked: DataFrame
    clean: cleaning.CleanPanel
    diagnostics: DataFrame
    price_qc: DataFrame = _Asked()
    removed: DataFrame = _Asked()
    factor_qc: DataFrame = _Asked()


@dataclass
class Run:
    core: Core
    ic: DataFrame
    ic_stats: DataFrame
    ic_diagnostics: DataFrame
    curve: DataFrame
    costs: DataFrame
    performance: DataFrame


def load(spark: SparkSession, source: Source, settings: Settings) -> Inputs:
    """Everything lazily; what a run doesn't use is never read. No usable company, or no market row of one in the range, is an error."""
    companies = source.read(spark, "companies")
    ids = require_rows(market.company_ids(companies), "companies have no usable id")
    rows = market.market_rows(source, spark, ids, settings.reading.first, settings.reading.last)
    require_rows(rows, f"no market row of a company from {settings.reading.first} to {settings.reading.last}")
    sets = market.statements(source, spark, ids, settings.reading.days_to_known)
    sectors = None
    if settings.neutral.mode == "sector":
        industries = source.read(spark, "industries") if "sector" not in companies.columns else None
        sectors = market.sector_map(rows.select("asset_id").distinct(), companies, industries)
    proxy = None
    if settings.neutral.mode == "market":
        proxy = market.proxy_returns(source, spark, settings.neutral.market_asset_id, settings.reading.first, settings.reading.last)
    return Inputs(rows, sets, sectors, proxy)


def scored_panel(clean: DataFrame, inputs: Inputs, settings: Settings, signal_rows: DataFrame | None = None) -> DataFrame:
    """The clean panel with fwd_ret, standardized factors and composite: windows by asset come first, under
    one partitioning, then those by date."""
    names = settings.model.factors
    with_ret = timeseries.add_returns(clean.select("asset_id", "date", "t", "price", "dollar_volume", "quality_ok"))
    returns = timeseries.add_future_returns(with_ret)
    priced = factors.price_factors(with_ret, settings.model.lookbacks, settings.model.price_factors)
    alive = clean.select("asset_id").distinct()
    if signal_rows is None:
        signal_rows = signals.signals(inputs.rows.join(alive, "asset_id", "left_semi"), inputs.statements)
    daily = stage(factors.daily_signals(signal_rows, with_ret, settings.model.lookbacks.signal_fill), "signals", by="asset_id", dealt=True)
    funded = stage(factors.fundamental_factors(daily, settings.model.fundamental_factors), "fundamental-factors", by="asset_id")
    priced = stage(priced.select("asset_id", "date", "t", *settings.model.price_factors), "price-factors", by="asset_id", dealt=True)
    made = priced.hint("merge").join(funded.drop("t"), ["asset_id", "date"])
    panel = align_factors_left(made, returns.select("asset_id", "date", "t", "price", "dollar_volume", "quality_ok", "ret", "fwd_ret"))
    panel = crosssection.winsorize(stage(panel, "factors", by="asset_id", dealt=True), names)
    if settings.neutral.mode == "sector":
        if inputs.sectors is None:
            raise ValueError("sector neutralization needs sectors")
        panel = panel.join(inputs.sectors, "asset_id", "left")  # broadcast where Spark knows it to be small, else without an exchange of the panel
    if settings.neutral.mode == "market":
        panel = panel.join(F.broadcast(usable_market(inputs.market, panel)), "date", "left")  # a row a date
        panel = moving.add_rolling_beta(panel, "beta", "mkt", "ret", settings.neutral.beta_rows, settings.neutral.beta_least)
    panel = crosssection.neutralize(panel, names, settings.neutral.mode)
    panel = crosssection.standardize(panel, names)
    return panel.withColumn("composite", crosssection.equal_weight(settings.model.price_factors, settings.model.fundamental_factors))


#: Dates on which the market must have a return.
LEAST_MARKET_DATES = 30


def usable_market(found: DataFrame | None, panel: DataFrame) -> DataFrame:
    """(date, mkt) on the panel's dates; fewer than LEAST_MARKET_DATES returns are an error."""
    if found is None:
        raise ValueError("market neutralization needs the market's returns")
    own = stage(found.join(panel.select("date").distinct(), "date", "left_semi").select("date", "mkt"), "market")
    n = own.where("mkt is not null").count()
    if n < LEAST_MARKET_DATES:
        raise ValueError(f"the market's asset has {n} returns on the panel's dates; {LEAST_MARKET_DATES} are needed")
    return own


def run_core(inputs: Inputs, settings: Settings, signal_rows: DataFrame | None = None, grid: DataFrame | None = None) -> Core:
    """Clean, score and mask. The clean panel, the factors and the scored panel are written, since several results read them, and dealt
    by asset, so that no window or join by asset after the clean panel needs an exchange of its own."""
    quality = settings.cleaning.quality
    grid = market.price_panel(inputs.rows) if grid is None else grid
    clean = cleaning.clean_panel(
        grid, settings.cleaning.rules, settings.cleaning.assets_per_date, quality.rows, quality.hard_events, quality.coverage
    )
    require_rows(clean.prices, f"cleaning leaves no price (dates need {settings.cleaning.assets_per_date} assets)")
    panel = stage(scored_panel(clean.prices, inputs, settings, signal_rows), "scored", by="asset_id")
    score = settings.model.output
    if score == "ridge":
        found = ridge.ridge_scores(panel, panel, panel, settings.trading.rebalance, settings.model.factors, settings.model.penalty, settings.model.ridge)
        panel = stage(panel.join(found.select("asset_id", "date", F.col("score").alias("ridge")), ["asset_id", "date"], "left"), "with-ridge")
    elif score not in (*settings.model.factors, "composite"):
        raise ValueError(f"there is no score {score!r}")
    panel = panel.withColumn("score", F.col(score)).withColumn("required_ok", F.col("score").isNotNull())
    cells = universe.universe(panel, settings.universe.assets, settings.universe.volume_rows, settings.universe.price_floor)
    cells = stage(cells, "universe", by="asset_id", dealt=True)
    masked = universe.tradable(cells, "score", [*settings.model.factors, "composite"])
    tradable_prices = masked.withColumn("price", F.when(F.col("tradable"), F.col("price")))
    return Core(
        masked, panel, clean, universe.universe_diagnostics(cells),
        lambda: qc.price_summary(clean.raw, "raw_daily").unionByName(qc.price_summary(tradable_prices, "tradable_daily")),
        lambda: qc.removed_prices(clean.raw, clean.prices), lambda: qc.factor_summary(masked, settings.model.factors, "in_universe"),
    )


def evaluate(core: Core, settings: Settings) -> Run:
    panel = core.panel
    pairs = evaluation.ic_inputs(panel, panel.select("asset_id", "date", "t", "fwd_ret"), settings.trading.rebalance, panel.select("asset_id", "date", "t", "price"))
    ic = stage(evaluation.ic_series(pairs, settings.trading.assets_for_ic), "ic")
    require_rows(ic, f"no rebalance date ({settings.trading.rebalance}) has {settings.trading.assets_for_ic} assets with a score and a return")
    base = panel.select("asset_id", "date", F.col("in_universe").alias("base"))
    result = backtest.long_short_backtest(
        panel, panel.select("asset_id", "date", "t", "fwd_ret"), settings.trading.rebalance, settings.trading.turnover_cost, settings.trading.borrow_cost
    )
    return Run(
        core, ic, evaluation.ic_stats(ic), evaluation.ic_coverage(pairs, base, settings.trading.assets_for_ic), result.curve, result.summary, evaluation.performance_stats(result.curve)
    )


def run(spark: SparkSession, source: Source, settings: Settings = Settings()) -> Run:
    """The whole run; every part of the result is a lazy DataFrame."""
    return evaluate(run_core(load(spark, source, settings), settings), settings)


def summary(result: Run) -> dict[str, float | None]:
    """The five headline numbers."""
    stats, perf = result.ic_stats.first(), result.performance.first()
    return {"mean_ic": stats["mean_ic"], "t_newey_west": stats["t_newey_west"], "annual_vol": perf["annual_vol"], "sharpe": perf["sharpe"], "max_drawdown": perf["max_drawdown"]}
