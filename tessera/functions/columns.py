"""Column helpers: null-safe arithmetic, frames, and checks of names.

A panel is a long table (asset_id, date, t, ...): t numbers the dates of its
calendar from 1, every asset has a row for every date, and a missing value is NULL.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 (plain division raises in ANSI mode)."""
    return a / F.when(b != 0, b)


def finite(c: str | Column) -> Column:
    """NaN and infinities as NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def usable_price(c: str | Column) -> Column:
    """Prices that aren't finite or aren't positive as NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (c != float("inf")) & (c > 0), c)


def by_asset(*extra: str) -> WindowSpec:
    """One asset's rows along the calendar."""
    return Window.partitionBy(*extra, "asset_id").orderBy("t")


def back(rows: int, lag: int = 0, *extra: str) -> WindowSpec:
    """The `rows` rows of an asset that end `lag` rows before the present one."""
    return by_asset(*extra).rowsBetween(-(rows - 1) - lag, -lag)


def across(*extra: str) -> WindowSpec:
    """All assets of a date."""
    return Window.partitionBy(*extra, "date")


def positive(value: float, name: str) -> None:
    if value <= 0:
        raise ValueError(f"{name}: {value} isn't above 0")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """`df`, or ValueError if it has no row: a small job that stops at the first."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def require_columns(df: DataFrame, names: Iterable[str], label: str) -> None:
    """KeyError for missing columns, with the names that come close."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        near = {n: difflib.get_close_matches(n, df.columns, n=3) for n in missing}
        raise KeyError(f"{label}: missing columns {missing}; similar: {near}")


def require_unique(names: Iterable[str], label: str) -> None:
    names = list(names)
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"{label}: columns come twice: {twice}")


def _total(terms: list[Column], none: Column) -> Column:
    """The sum of the terms as a balanced tree, so that hundreds of them are no deep expression."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + (terms[-1:] if len(terms) % 2 else [])
    return terms[0] if terms else none


def count_non_null(names: Iterable[str]) -> Column:
    """How many of the columns are not NULL in a row."""
    return _total([F.col(n).isNotNull().cast("int") for n in names], F.lit(0))


def sum_or_zero(names: Iterable[str]) -> Column:
    return _total([F.coalesce(F.col(n), F.lit(0.0)) for n in names], F.lit(0.0))
