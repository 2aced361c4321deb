"""Runs that append dates against one run over everything."""

import datetime as dt
import random

import pytest

from tessera.plans.refresh import Windows, refresh

WINDOWS = Windows(momentum=6, skip=1, volume=4, quality=5, hard_events=1, coverage=0.6)
SCHEMA = "asset_id long, date date, price double, dollar_volume double"


def history(seed=3, days=30):
    """Gaps, impossible moves, an asset that ends and one that starts late."""
    r = random.Random(seed)
    out = []
    for day in range(days):
        for a in (1, 2, 3, 4):
            if (a == 3 and day > 12) or (a == 4 and day < 15) or r.random() < 0.06:
                continue
            out.append((a, dt.date(2020, 1, 1) + dt.timedelta(day), r.uniform(5, 15) * (50 if r.random() < 0.03 else 1), r.uniform(1e6, 2e6)))
    return out


def cells(df):
    return {(r["asset_id"], r["date"]): r.asDict() for r in df.collect()}


def test_appended_dates_are_those_of_a_full_run(spark):
    rows = history()
    full = cells(refresh(spark.createDataFrame(rows, SCHEMA), None, WINDOWS).cells)
    got, tail = {}, None
    days = sorted({r[1] for r in rows})
    for a, b in ((0, 14), (14, 15), (15, 16), (16, 23), (23, 30)):
        part = spark.createDataFrame([r for r in rows if r[1] in days[a:b]], SCHEMA)
        step = refresh(part, tail, WINDOWS)
        tail, new = step.tail, cells(step.cells)
        assert not new.keys() & got.keys()
        got |= new
        assert tail.select("date").distinct().count() == min(b, WINDOWS.depth)
    for key in full.keys() - got.keys():  # before an asset's first refresh
        assert key[0] == 4 and full[key]["price"] is None and not full[key]["quality_ok"]
    assert got.keys() <= full.keys() and any(r["hard"] for r in full.values())
    for key, row in got.items():
        for name, value in row.items():
            assert value == (pytest.approx(full[key][name], rel=1e-9) if isinstance(value, float) else full[key][name]), (key, name)
    assert sum(r["momentum"] is not None for r in got.values()) > 20 and any(r["quality_ok"] for r in got.values())


def test_edges_of_a_refresh(spark):
    rows = history(days=8)
    first = refresh(spark.createDataFrame(rows, SCHEMA), None, WINDOWS)
    nothing = refresh(spark.createDataFrame([], SCHEMA), first.tail, WINDOWS)
    assert nothing.cells.count() == 0 and cells(nothing.tail) == cells(first.tail)
    with pytest.raises(ValueError, match="later ones"):
        refresh(spark.createDataFrame(rows[-1:], SCHEMA), first.tail, WINDOWS)
    empty = refresh(spark.createDataFrame([], SCHEMA), None, WINDOWS)
    assert empty.cells.count() == 0 and empty.tail.count() == 0
    again = refresh(spark.createDataFrame(rows, SCHEMA), empty.tail, WINDOWS)
    assert again.cells.count() == first.cells.count()
