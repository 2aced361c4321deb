"""Small panels for tests."""

from __future__ import annotations

import datetime as dt


def panel(spark, columns: dict[int, list], name: str = "price", start: str = "2020-01-01", dates: list[str] | None = None):
    """A dense panel from a list of values for each asset, on consecutive days or the given dates."""
    n = len(next(iter(columns.values())))
    days = [dt.date.fromisoformat(d) for d in dates] if dates else [dt.date.fromisoformat(start) + dt.timedelta(i) for i in range(n)]
    rows = [(a, days[i], i + 1, None if v is None else float(v)) for a, vs in columns.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, f"asset_id long, date date, t int, {name} double")


def values(df, name: str, asset: int | None = None) -> list:
    """One column in the order of assets and dates."""
    rows = df.orderBy("asset_id", "date").collect()
    return [r[name] for r in rows if asset is None or r["asset_id"] == asset]
