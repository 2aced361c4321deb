import math

import pytest
from helpers import panel, values
from pyspark.sql import functions as F

from tessera.functions.columns import require_columns
from tessera.operators import crosssection, factors, timeseries
from tessera.operators.grid import align_factors_left


def with_ret(spark, columns):
    return timeseries.add_returns(panel(spark, columns))


def test_momentum(spark):
    out = with_ret(spark, {1: [100, 102, 101, 104, 106, 107]}).withColumn("m", timeseries.momentum(4, 1))
    assert values(out, "m")[4] == pytest.approx(0.04) and values(out, "m")[:4] == [None] * 4
    with pytest.raises(ValueError):
        timeseries.momentum(4, 4)


def test_reversal(spark):
    out = with_ret(spark, {1: [100, 110, 121, 118.58]}).withColumn("r", timeseries.reversal(3))
    assert values(out, "r")[3] == pytest.approx(-0.1858)


def test_total_loss_leaves_no_compound(spark):
    out = panel(spark, {1: [0.1, -1.0, 0.1, 0.1]}, "ret").withColumn("c", timeseries.compounded("ret", 2))
    assert values(out, "c")[1:3] == [None, None] and values(out, "c")[3] == pytest.approx(0.21)


def test_fill_is_capped(spark):
    p = panel(spark, {1: [1.0] + [None] * 254}, "s").withColumn("f", timeseries.carried("s", 252))
    assert values(p, "f")[252] == 1.0 and values(p, "f")[253] is None


def test_zscore_is_by_population(spark):
    out = crosssection.standardize(panel(spark, {1: [1], 2: [2], 3: [3]}, "x"), ["x"])
    assert values(out, "x") == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5)])
    assert values(crosssection.standardize(panel(spark, {1: [1], 2: [1]}, "x"), ["x"]), "x") == [None, None]


def test_low_vol(spark):
    p = panel(spark, {1: [0.1, -0.1, 0.2], 2: [0.0, 0.1, -0.1]}, "ret").withColumn("mkt", F.col("ret") * 2)
    assert values(p.withColumn("v", timeseries.low_volatility("mkt", "ret", 3, 3)), "v", 1) == [None, None, pytest.approx(0.0, abs=1e-8)]
    with pytest.raises(ValueError):
        timeseries.low_volatility(lookback=3, min_rows=4)


def test_leave_one_out(spark):
    p = panel(spark, {1: [0.1], 2: [0.2], 3: [0.6]}, "ret").withColumn("m", timeseries.leave_one_out_market())
    assert values(p, "m") == pytest.approx([0.4, 0.35, 0.15])


def test_winsorize(spark):
    out = crosssection.winsorize(panel(spark, {1: [1], 2: [2], 3: [4], 4: [5], 5: [None]}, "x"), ["x"])
    assert values(out, "x")[:4] == pytest.approx([1.03, 2, 4, 4.97]) and values(out, "x")[4] is None


def test_neutralize(spark):
    p = panel(spark, {1: [1], 2: [3], 3: [10], 4: [5]}, "x").withColumn("sector", F.expr("case asset_id when 1 then 'A' when 2 then 'A' when 3 then 'B' end"))
    assert values(crosssection.neutralize(p, ["x"], "sector"), "x") == [-1, 1, 0, None]
    flat = panel(spark, {1: [1], 2: [2], 3: [4]}, "x").withColumn("beta", F.lit(0.5))
    assert values(crosssection.neutralize(flat, ["x"], "market"), "x") == pytest.approx([-4 / 3, -1 / 3, 5 / 3])
    one = panel(spark, {1: [1], 2: [None]}, "x").withColumn("beta", F.lit(0.5))
    assert values(crosssection.neutralize(one, ["x"], "market"), "x") == [None, None]
    with pytest.raises(ValueError):
        crosssection.neutralize(p, ["x"], "sector+market")


def test_composites(spark):
    p = panel(spark, {1: [1.0]}, "a").withColumns({"b": F.lit(3.0), "c": F.lit(None).cast("double")})
    assert values(p.withColumn("x", crosssection.candidate_composite(p, ["a", "b", "c", "absent"])), "x") == [2.0]
    assert values(p.withColumn("x", crosssection.candidate_composite(p, ["c", "a", "b"])), "x") == [None]  # the first is missing
    assert values(p.withColumn("x", crosssection.candidate_composite(p, ["c", "a", "b"], require_first=False)), "x") == [2.0]
    assert values(p.withColumn("x", crosssection.equal_weight(["a", "b"], [])), "x") == [2.0]
    assert values(p.withColumn("x", crosssection.equal_weight(["a", "c"], ["b"])), "x") == [None]


def signals(spark, **columns):
    p = panel(spark, {i + 1: [0.0] for i in range(3)}, "z")
    for name, vs in columns.items():
        p = p.withColumn(name, F.element_at(F.array(*[F.lit(v).cast("double") for v in vs]), F.col("asset_id").cast("int")))
    return p


def test_styles(spark):
    p = signals(spark, book_market=[1, 2, 3], earnings_yield=[1, 2, 3], fcf_yield=[None] * 3, dividend_yield=[None] * 3)
    assert values(factors.value(p), "value") == pytest.approx([-1.2, 0, 1.2], abs=0.05)
    q = signals(spark, roa=[1, 2, 3], asset_turnover=[1, 2, 3], debt_ratio=[3, 2, 1], gross_profit_margin=[None] * 3, operating_margin=[1, 2, 3])
    assert factors.first_filled(q, factors.MARGINS) == "operating_margin"
    assert values(factors.quality(q), "quality") == pytest.approx([-1.2, 0, 1.2], abs=0.05)
    few = signals(spark, roa=[1, 2, 3], asset_turnover=[None] * 3, debt_ratio=[3, 2, 1], operating_margin=[None] * 3)
    assert values(factors.quality(few, margin="operating_margin"), "quality") == [None] * 3
    assert values(factors.invest(signals(spark, assets_growth=[0.1, None, -0.2])), "invest") == [-0.1, None, 0.2]
    g = signals(spark, sales_growth=[1, 2, 3], operating_income_growth=[None] * 3, earnings_growth=[None] * 3)
    assert values(factors.growth(g), "growth") == [None] * 3


def test_missing_columns_are_named(spark):
    with pytest.raises(KeyError, match="book_market"):
        require_columns(signals(spark, book_markt=[1, 2, 3]), ["book_market"], "signals")
    with pytest.raises(ValueError):
        factors.fundamental_factors(signals(spark), [])


def test_left_alignment_keeps_the_returns_assets(spark):
    out = align_factors_left(panel(spark, {1: [1, 2]}, "f"), panel(spark, {1: [1, 2, 3], 2: [1, 2, 3]}, "fwd_ret"))
    assert values(out, "f") == [1, 2, None, None]


def test_bounds_of_large_dates_are_exact(spark):
    """From the tails alone, with ties, NULLs and a date without values, as Spark's exact percentile gives them."""
    v = "case when id % 7 = 0 then null when id % 5 = 0 then 40.0 else (id * 7919) % 1009 + id / 1e4 end"
    rows = spark.range(6000).selectExpr("id as asset_id", "date'2020-01-01' + cast(id % 3 as int) as date", f"case when id % 3 < 2 then {v} end as x", "-id * 0.5 as y")
    for lower, upper in ((0.01, 0.99), (0.05, 0.95), (0.0, 1.0)):
        got = {r["date"]: tuple(r)[1:] for r in crosssection.date_bounds(rows, ["x", "y"], lower, upper, few=100).collect()}
        ends = F.array(F.lit(lower), F.lit(upper))
        want = {r["date"]: (*(r["x"] or (None, None)), *r["y"]) for r in rows.groupBy("date").agg(F.percentile("x", ends).alias("x"), F.percentile("y", ends).alias("y")).collect()}
        assert got == want
