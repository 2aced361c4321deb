"""Operators over blocks of time against the same over whole histories."""

import datetime as dt
import random

import pytest
from helpers import panel
from pyspark.sql import functions as F

from tessera.functions.stages import stage
from tessera.operators import cleaning, moving, timeseries
from tessera.operators.timeblocks import add_running, as_of_by_blocks, cut, joined
from tessera.sources.market import as_of


def one_asset(spark, n=400, seed=3):
    """One asset with gaps and a stretch that is missing, and one that has nothing."""
    r, p, prices = random.Random(seed), 10.0, []
    for i in range(n):
        p *= 1 + r.gauss(0, 0.02)
        prices.append(None if r.random() < 0.05 or 150 <= i < 175 else round(p, 4))
    return stage(panel(spark, {1: prices, 2: [None] * n}), "prices")


def rows_of(df, *names):
    return [(r["asset_id"], r["t"], *[r[n] for n in names]) for r in df.orderBy("asset_id", "t").collect()]


def along(df):
    """Whatever looks back 21 rows of prices, 1 row ahead."""
    out = timeseries.add_returns(df).withColumn("dollar_volume", F.col("price") * 7)
    w = timeseries.by_asset()
    out = out.withColumn("fwd", F.lead("price").over(w)).withColumn("mom", timeseries.momentum(12, 2)).withColumn("kept", timeseries.carried("price", 20))
    out = out.withColumn("mkt", F.sin(F.col("t")))
    return moving.add_low_volatility(moving.add_average_dollar_volume(out, "adv", 10), "vol", "mkt", "ret", 20, 10)


@pytest.mark.parametrize("rows", [21, 22, 64, 1000])
def test_bounded_windows_are_equal_over_blocks(spark, rows):
    df, names = one_asset(spark), ("price", "ret", "fwd", "mom", "kept", "adv", "vol")
    want, got = rows_of(along(df), *names), rows_of(joined(along(cut(df, 21, rows, 1))), *names)
    assert len(got) == len(want) == 800 and sum(w[-1] is not None for w in want) > 300
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and [x is None for x in g] == [x is None for x in w]
        assert [x for x in g if x is not None] == pytest.approx([x for x in w if x is not None], rel=1e-9, abs=1e-12)


def test_blocks_spread_one_asset(spark):
    df = cut(one_asset(spark).where("asset_id = 1"), 10, 20)
    sizes = [r["count"] for r in df.groupBy("asset_id").count().collect()]
    assert len(sizes) >= 20 and max(sizes) == 30  # no task gets more than a block and its reach
    assert df.count() <= 400 * 1.5 and joined(df).count() == 400


def test_blocks_too_short(spark):
    df = one_asset(spark)
    for bad in ((30, 20, 0), (5, 20, 21), (-1, 20, 0), (0, 0, 0)):
        with pytest.raises(ValueError):
            cut(df, *bad)


@pytest.mark.parametrize("rows", [1, 7, 400, 1000])
def test_running_values_go_on_from_block_to_block(spark, rows):
    df = one_asset(spark)
    parts = {"total": ("sum", F.col("price")), "n": ("count", F.col("price")), "grown": ("product", 1 + F.col("price") / 1e4), "top": ("max", F.col("price")), "latest": ("last", F.col("price"))}
    got = rows_of(add_running(df, parts, F.floor((F.col("t") - 1) / rows)), *parts)
    prices, want = {(r["asset_id"], r["t"]): r["price"] for r in df.collect()}, []
    for a in (1, 2):
        total, n, grown, top, latest = None, 0, None, None, None
        for t in range(1, 401):
            if (p := prices[a, t]) is not None:
                total, n, grown, top, latest = (total or 0) + p, n + 1, (grown or 1) * (1 + p / 1e4), max(top or 0, p), p
            want.append((a, t, total, n, grown, top, latest))
    for g, w in zip(got, want, strict=True):
        assert [x is None for x in g] == [x is None for x in w]
        assert [x for x in g if x is not None] == pytest.approx([x for x in w if x is not None])


def test_running_values_of_no_rows_and_unknown_kinds(spark):
    df = one_asset(spark).where("false")
    assert add_running(df, {"n": ("count", F.col("price"))}, F.lit(0)).collect() == []
    with pytest.raises(ValueError, match="median"):
        add_running(df, {"m": ("median", F.col("price"))}, F.lit(0))


@pytest.mark.parametrize("days", [1, 30, 365, 100000])
def test_as_of_is_equal_over_blocks(spark, days):
    r, day = random.Random(5), dt.date(1969, 6, 1)  # on both sides of day 0
    left = spark.createDataFrame([(a, day + dt.timedelta(r.randrange(900))) for a in (1, 2, 3) for _ in range(60)], "asset_id long, date date").distinct()
    # asset 1 has one old row for everything, asset 2 many with NULLs, asset 3 none, asset 4 isn't asked for
    known = {(1, day + dt.timedelta(2)): 1.5} | {(2, day + dt.timedelta(r.randrange(900))): r.choice([None, r.random()]) for _ in range(40)} | {(4, day): 9.0}
    right = spark.createDataFrame([(*k, v, float(i)) for i, (k, v) in enumerate(known.items())], "asset_id long, eff_date date, x double, y double")
    found = [sorted(map(tuple, df.collect()), key=str) for df in (as_of(left, right, ["x", "y"]), as_of_by_blocks(left, right, ["x", "y"], days))]
    assert found[0] == found[1] and any(row[3] is not None for row in found[1])
    assert as_of_by_blocks(left, right.where("false"), ["x"], days).where("x is not null").count() == 0


def test_quality_mask_over_blocks(spark):
    df = cleaning.clean_prices(one_asset(spark)).select("asset_id", "date", "t", "price", "hard")
    found = [rows_of(f, "quality_ok") for f in (cleaning.quality_mask(df, 30, 3, 0.8), joined(cleaning.quality_mask(cut(df, 31, 64), 30, 3, 0.8)))]
    assert found[0] == found[1]
