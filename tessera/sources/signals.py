"""Signals from statements and prices: yields, ratios and growth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import finite, ratio, require_columns, require_unique
from tessera.operators.factors import SIGNALS
from tessera.sources.market import as_of_sets


#: What the signals take from each set of statements.
INCOME, BALANCE, CASHFLOW = ["net_income", "shares", "revenue", "gross_profit", "operating_income", "operating_margin"], ["equity", "total_assets", "total_debt"], ["free_cash_flow", "dividends_paid"]
INCOME_GROWTH = {"sales_growth": "revenue", "operating_income_growth": "operating_income", "earnings_growth": "net_income"}


def _valuation() -> list[Column]:
    cap = F.col("close") * F.col("shares")
    book = ratio(cap, F.col("equity"))
    over_cap = lambda a, name: ratio(F.col(a), cap).alias(name)
    yields = [over_cap("net_income", "earnings_yield"), over_cap("free_cash_flow", "fcf_yield"), over_cap("dividends_paid", "dividend_yield")]
    return [book.alias("price_book"), ratio(F.lit(1.0), book).alias("book_market"), *yields]


def _financial() -> list[Column]:
    over = lambda a, b, name: ratio(F.col(a), F.col(b)).alias(name)
    by_assets = [over("net_income", "total_assets", "roa"), over("revenue", "total_assets", "asset_turnover"), over("total_debt", "total_assets", "debt_ratio")]
    return [*by_assets, over("gross_profit", "revenue", "gross_profit_margin"), F.col("operating_margin")]


def valuation_signals(market: DataFrame, income: DataFrame, balance: DataFrame, cashflow: DataFrame) -> DataFrame:
    """(asset_id, date, price_book, book_market, earnings_yield, fcf_yield, dividend_yield): market cap is close times the
    latest shares; trailing income, cash flow and dividends over it; price_book is it over equity."""
    rows = as_of_sets(market.select("asset_id", "date", "close"), {"i": (income, INCOME[:2]), "b": (balance, BALANCE[:1]), "c": (cashflow, CASHFLOW)})
    return rows.select("asset_id", "date", "close", "i.*", "b.*", "c.*").select("asset_id", "date", *_valuation())


def financial_signals(market: DataFrame, income: DataFrame, balance: DataFrame) -> DataFrame:
    """(asset_id, date, roa, asset_turnover, debt_ratio, gross_profit_margin, operating_margin)."""
    values = ["revenue", "gross_profit", "net_income", "operating_margin"]
    rows = as_of_sets(market.select("asset_id", "date"), {"i": (operating_margin_fallback(income), values), "b": (balance, BALANCE[1:])})
    return rows.select("asset_id", "date", "i.*", "b.*").select("asset_id", "date", *_financial())


def growth(statements: DataFrame, value: str, out: str, rows: int = 4) -> DataFrame:
    """`statements` with x / x `rows` statements before of the same asset, less 1."""
    w = Window.partitionBy("asset_id").orderBy("eff_date")
    return statements.withColumn(out, finite(ratio(F.col(value), F.lag(value, rows).over(w)) - 1))


def income_growth(income: DataFrame) -> DataFrame:
    return reduce(lambda df, x: growth(df, x[1], x[0]), INCOME_GROWTH.items(), income)


def growth_signals(market: DataFrame, income: DataFrame, balance: DataFrame) -> DataFrame:
    """(asset_id, date, sales_growth, operating_income_growth, earnings_growth, assets_growth): year on
    year over quarterly statements, at the market's dates."""
    sets = {"i": (income_growth(income), list(INCOME_GROWTH)), "b": (growth(balance, "total_assets", "assets_growth"), ["assets_growth"])}
    return as_of_sets(market.select("asset_id", "date"), sets).select("asset_id", "date", "i.*", "b.*")


def operating_margin_fallback(income: DataFrame) -> DataFrame:
    """`income` with operating_margin, if it isn't there; zero revenue gives NULL."""
    if "operating_margin" in income.columns:
        return income
    return income.withColumn("operating_margin", ratio(F.col("operating_income"), F.col("revenue")))


def book_market_fallback(signals: DataFrame) -> DataFrame:
    """With book_market from price_book, if it isn't there."""
    if "book_market" in signals.columns or "price_book" not in signals.columns:
        return signals
    return signals.withColumn("book_market", ratio(F.lit(1.0), F.col("price_book")))


def select_signals(signals: DataFrame) -> DataFrame:
    """The required signals, infinities as NULL; missing or repeated columns are errors. book_market may come as price_book."""
    require_unique(signals.columns, "signals")
    signals = book_market_fallback(signals)
    require_columns(signals, SIGNALS, "signals")
    return signals.select("asset_id", "date", *[finite(s).alias(s) for s in SIGNALS])


def signals(market: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """All signals on the market's rows. Only the three sets that are used are read, and all come in one as-of pass."""
    known = {
        "i": (income_growth(operating_margin_fallback(sets["income_ttm"])), [*INCOME, *INCOME_GROWTH]),
        "b": (growth(sets["balance_quarterly"], "total_assets", "assets_growth"), [*BALANCE, "assets_growth"]),
        "c": (sets["cashflow_ttm"], CASHFLOW),
    }
    rows = as_of_sets(market.select("asset_id", "date", "close"), known).select("asset_id", "date", "close", "i.*", "b.*", "c.*")
    return select_signals(rows.select("asset_id", "date", *_valuation(), *_financial(), *INCOME_GROWTH, "assets_growth"))
