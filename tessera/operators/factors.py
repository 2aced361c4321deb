"""Factors: style scores from signals, and the registry of all seven."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import require_columns
from tessera.operators.crosssection import mean_of_available, normalize_components
from tessera.operators.moving import add_low_volatility
from tessera.operators.timeseries import add_leave_one_out_market, carried, momentum, reversal

#: The signals that the factors take.
SIGNALS = (
    "book_market", "earnings_yield", "fcf_yield", "dividend_yield", "roa", "asset_turnover", "debt_ratio", "gross_profit_margin",
    "operating_margin", "assets_growth", "sales_growth", "operating_income_growth", "earnings_growth",
)
PRICE_FACTORS = ("momentum", "reversal", "low_vol")
FUNDAMENTAL_FACTORS = ("value", "quality", "invest", "growth")
MARGINS = ("gross_profit_margin", "operating_margin")


@dataclass(frozen=True)
class Lookbacks:
    momentum: int = 252
    momentum_skip: int = 21
    reversal: int = 21
    low_vol: int = 252
    low_vol_min: int = 252
    signal_fill: int = 252


def daily_signals(signals: DataFrame, grid: DataFrame, rows: int = 252, names: Sequence[str] = SIGNALS) -> DataFrame:
    """Signals on the grid: those of the date itself, each carried on for at most `rows` rows."""
    exact = grid.select("asset_id", "date", "t").join(signals.select("asset_id", "date", *names), ["asset_id", "date"], "left")
    return exact.withColumns({n: carried(n, rows) for n in names})


def first_filled(panel: DataFrame, names: Sequence[str]) -> str:
    """The first column with any value in the whole panel; asks for one row a column at most."""
    require_columns(panel, names, "signals")
    for n in names:
        if panel.where(F.col(n).isNotNull()).limit(1).count():
            return n
    return names[0]


@dataclass(frozen=True)
class Style:
    """A factor that is the mean of normalized parts, if `at_least` of them are there. `parts`: an expression for each part's name."""

    parts: dict[str, str]
    at_least: int


def styled(panel: DataFrame, styles: dict[str, Style]) -> DataFrame:
    """The panel with a column for each style. The parts of all styles are normalized together: one aggregate of bounds and one
    window by date, however many styles there are."""
    parts = {f"__{name}_{k}": F.expr(v) for name, s in styles.items() for k, v in s.parts.items()}
    made = normalize_components(panel.withColumns(parts), list(parts))
    return made.withColumns({name: mean_of_available([f"__{name}_{k}" for k in s.parts], s.at_least) for name, s in styles.items()}).drop(*parts)


def value_style(panel: DataFrame, at_least: int = 2) -> Style:
    parts = {"bm": "book_market", "ey": "earnings_yield", "fy": "fcf_yield", "dy": "dividend_yield"}
    require_columns(panel, parts.values(), "value")
    return Style(parts, at_least)


def quality_style(panel: DataFrame, at_least: int = 3, margin: str | None = None) -> Style:
    """The margin is one column for the whole panel: the first of MARGINS that has any value."""
    require_columns(panel, ["roa", "asset_turnover", "debt_ratio"], "quality")
    margin = margin or first_filled(panel, [m for m in MARGINS if m in panel.columns] or list(MARGINS))
    return Style({"roa": "roa", "m": margin, "at": "asset_turnover", "d": "-debt_ratio"}, at_least)


def growth_style(panel: DataFrame, at_least: int = 2) -> Style:
    parts = {"s": "sales_growth", "o": "operating_income_growth", "e": "earnings_growth"}
    require_columns(panel, parts.values(), "growth")
    return Style(parts, at_least)


def value(panel: DataFrame, at_least: int = 2) -> DataFrame:
    return styled(panel, {"value": value_style(panel, at_least)})


def quality(panel: DataFrame, at_least: int = 3, margin: str | None = None) -> DataFrame:
    return styled(panel, {"quality": quality_style(panel, at_least, margin)})


def growth(panel: DataFrame, at_least: int = 2) -> DataFrame:
    return styled(panel, {"growth": growth_style(panel, at_least)})


def invest(panel: DataFrame) -> DataFrame:
    require_columns(panel, ["assets_growth"], "invest")
    return panel.withColumn("invest", -F.col("assets_growth"))


def price_factors(panel: DataFrame, looks: Lookbacks = Lookbacks(), names: Sequence[str] = PRICE_FACTORS) -> DataFrame:
    """The panel (with ret) with price factors. All share one partitioning by asset; the market of low_vol is
    an aggregate of a row a date."""
    out = add_leave_one_out_market(panel) if "low_vol" in names else panel
    made = {
        "momentum": lambda p: p.withColumn("momentum", momentum(looks.momentum, looks.momentum_skip)),
        "reversal": lambda p: p.withColumn("reversal", reversal(looks.reversal)),
        "low_vol": lambda p: add_low_volatility(p, "low_vol", "mkt", "ret", looks.low_vol, looks.low_vol_min),
    }
    for n in names:
        if n not in made:
            raise ValueError(f"unknown price factor {n!r}; there are {sorted(made)}")
        out = made[n](out)
    return out.drop("mkt")


#: Fundamental factors by name; users add their own here: a function from a panel with signals to one with the factor.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {"value": value, "quality": quality, "invest": invest, "growth": growth}
#: Those of them that are styles are made together, unless a user's function has their name.
_STYLES = {value: value_style, quality: quality_style, growth: growth_style}


def fundamental_factors(signals: DataFrame, names: Sequence[str] = FUNDAMENTAL_FACTORS) -> DataFrame:
    """(asset_id, date, t, factors) from signals on the grid."""
    if not names:
        raise ValueError("no fundamental factors are selected")
    for n in names:
        if n not in REGISTRY:
            raise ValueError(f"unknown fundamental factor {n!r}; there are {sorted(REGISTRY)}")
    styles = {n: _STYLES[REGISTRY[n]](signals) for n in names if REGISTRY[n] in _STYLES}
    out = styled(signals, styles) if styles else signals
    for n in names:
        if n not in styles:
            out = REGISTRY[n](out)
    return out.select("asset_id", "date", "t", *names)
