"""Sliding windows by blocks against true frames."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions.columns import back
from tessera.operators import moving, timeseries
from helpers import panel


def noisy(spark, rows=60, seed=0, base=0.0):
    r = random.Random(seed)
    series = lambda: [None if r.random() < 0.15 else base + r.gauss(0, 1) for _ in range(rows)]
    p = panel(spark, {a: series() for a in (1, 2, 3)}, "ret")
    mkt = panel(spark, {a: series() for a in (1, 2, 3)}, "mkt")
    return p.join(mkt.drop("t"), ["asset_id", "date"])


def close(df, a, b, rel=1e-9):
    for r in df.collect():
        assert (r[a] is None) == (r[b] is None), r
        assert r[a] is None or r[a] == pytest.approx(r[b], rel=rel, abs=1e-9), r


@pytest.mark.parametrize("rows", [1, 2, 7, 30, 60, 100])
def test_moments_are_those_of_frames(spark, rows):
    w = back(rows)
    p = moving.add_moments(noisy(spark), rows, {"m": ("ret", "mkt")}).withColumn("both", F.col("ret").isNotNull() & F.col("mkt").isNotNull())
    y, x = F.when(F.col("both"), F.col("ret")), F.when(F.col("both"), F.col("mkt"))
    p = p.withColumns({"n": F.count(y).over(w).cast("double"), "yy": F.var_pop(y).over(w), "xx": F.var_pop(x).over(w), "xy": F.covar_pop(y, x).over(w), "y": F.avg(y).over(w)})
    own = {f"m_{k}": F.when(F.col("m")["n"] > 0, F.col("m")[k] / F.when(F.col("m")["n"] > 0, F.col("m")["n"])) for k in ("yy", "xx", "xy")}
    p = p.withColumns(own).withColumn("m_n", F.col("m")["n"]).withColumn("m_y", F.when(F.col("m")["n"] > 0, F.col("m")["y"]))
    for name in ("n", "yy", "xx", "xy", "y"):
        close(p, f"m_{name}", name)


@pytest.mark.parametrize("rows,least", [(5, 3), (20, 10), (30, 30)])
def test_factors_are_those_of_frames(spark, rows, least):
    p = noisy(spark, seed=1)
    p = moving.add_low_volatility(p, "a", "mkt", "ret", rows, least).withColumn("b", timeseries.low_volatility("mkt", "ret", rows, least))
    close(p, "a", "b", 1e-7)
    p = moving.add_rolling_beta(p, "c", "mkt", "ret", rows, least).withColumn("d", timeseries.rolling_beta("mkt", "ret", rows, least))
    close(p, "c", "d")
    p = moving.add_average_dollar_volume(p, "e", rows, "ret").withColumn("f", timeseries.average_dollar_volume(rows, "ret"))
    close(p, "e", "f")


def test_large_levels_lose_no_digits(spark):
    """Variances of numbers near 10^8: a difference of running sums of squares would have none left."""
    p = moving.add_moments(noisy(spark, base=1e8), 10, {"m": ("ret", "mkt")}).withColumn("a", F.col("m")["yy"])
    near = moving.add_moments(noisy(spark), 10, {"m": ("ret", "mkt")}).select("asset_id", "date", F.col("m")["yy"].alias("b"))
    close(p.join(near, ["asset_id", "date"]), "a", "b", 1e-5)


def test_windows_need_no_further_exchange(spark):
    p = noisy(spark).repartition("asset_id")
    plan = moving.add_rolling_beta(p, "b", "mkt", "ret", 20, 5)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(asset_id#\d+L, \d+\)", plan)) == 1


def test_errors(spark):
    p = noisy(spark, 5)
    with pytest.raises(ValueError, match="isn't above 0"):
        moving.add_average_dollar_volume(p, lookback=0)
    with pytest.raises(ValueError, match="1 to 3 rows"):
        moving.add_low_volatility(p, lookback=3, min_rows=4)


def test_carried_values_have_an_age(spark):
    p = panel(spark, {1: [1.0, None, None, None, 2.0, None], 2: [None, None, 3.0, None, None, None]}, "v").withColumn("c", timeseries.carried("v", 2))
    frame = p.withColumn("d", F.last("v", ignorenulls=True).over(back(3)))
    close(frame, "c", "d")
