import numpy as np
import pytest
from helpers import panel, values
from pyspark.sql import functions as F

from tessera.operators import backtest, evaluation, timeseries
from tessera.operators.crosssection import decile_weights


def scored(spark, scores, returns, dates=None):
    s, r = panel(spark, scores, "score", dates=dates), panel(spark, returns, "fwd_ret", dates=dates)
    return s, r


def test_rebalance_dates(spark):
    dates = ["2020-01-30", "2020-01-31", "2020-02-03", "2020-02-28", "2020-03-02"]
    p = panel(spark, {1: [1] * 5}, dates=dates)
    assert [str(r[0]) for r in timeseries.rebalance_dates(p, "ME").orderBy("date").collect()] == ["2020-01-31", "2020-02-28", "2020-03-02"]
    assert [str(r[0]) for r in timeseries.rebalance_dates(p, "W-FRI").orderBy("date").collect()] == ["2020-01-31", "2020-02-03", "2020-02-28", "2020-03-02"]
    with pytest.raises(ValueError):
        timeseries.rebalance_dates(p, "fortnight")


@pytest.mark.parametrize(("prices", "want"), [([100, 101, None, 103, 104, 105], 0.05), ([100, 101, 102, None, None, None], -1.0), ([None, 1, 1, 1, 1, None], -1.0)])
def test_period_returns(spark, prices, want):
    p = panel(spark, {1: prices, 2: [1, 1, 1, 1, 1, 1]})
    ends = p.where("t in (1, 6)").select("date").distinct()
    out = timeseries.period_forward_returns(p, ends)
    assert values(out, "fwd_ret", 1) == [pytest.approx(want)]


def test_missing_end_that_comes_back_is_null(spark):
    p = panel(spark, {1: [100, None, 5], 2: [1, 1, 1]})
    ends = p.where("t <= 2").select("date").distinct()
    assert values(timeseries.period_forward_returns(p, ends), "fwd_ret", 1) == [None]


def test_terminal_missing(spark):
    out = timeseries.add_terminal_missing(panel(spark, {1: [1, None, 2, None], 2: [None, None, None, None]}, "x"), "x")
    assert values(out, "terminal", 1) == [False, False, False, True] and values(out, "terminal", 2) == [True] * 4


def test_last_date_has_no_future_return(spark):
    assert values(timeseries.add_future_returns(panel(spark, {1: [1, 2, 4]})), "fwd_ret") == [1, 1]


def test_ic_has_average_ranks_and_a_minimum(spark):
    s, r = scored(spark, {1: [1, 1], 2: [1, 2], 3: [2, 3], 4: [3, 4]}, {1: [1, 4], 2: [2, 3], 3: [3, None], 4: [4, None]})
    out = evaluation.ic_series(evaluation.ic_inputs(s, r, "D"), 3).collect()
    x, y = np.array([1.5, 1.5, 3, 4]), np.array([1, 2, 3, 4])
    assert len(out) == 1 and out[0]["ic"] == pytest.approx(np.corrcoef(x, y)[0, 1]) and out[0]["n"] == 4
    with pytest.raises(ValueError):
        evaluation.ic_inputs(s, r, "ME")


def test_ic_stats_follow_newey_west(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0.02, 0.1, 40)
    ic = panel(spark, {1: list(x)}, "ic").drop("asset_id")
    row = evaluation.ic_stats(ic).first()
    lag, c = evaluation.choose_nw_lag(40), x - x.mean()
    var = c @ c / 40 + sum(2 * (1 - k / (lag + 1)) * (c[k:] @ c[:-k]) / 40 for k in range(1, lag + 1))
    assert row["nw_lag"] == lag and row["t_newey_west"] == pytest.approx(x.mean() / np.sqrt(var / 40)) and row["t_naive"] == pytest.approx(x.mean() / (x.std(ddof=1) / np.sqrt(40)))
    acf = {r["lag"]: r["acf"] for r in evaluation.ic_autocorrelation(ic).collect()}
    assert acf[2] == pytest.approx(np.corrcoef(x[2:], x[:-2])[0, 1])
    assert evaluation.ic_stats(ic.limit(0)).first()["n_obs"] == 0
    assert evaluation.ic_stats(ic.limit(1)).first()["t_newey_west"] is None


def test_performance(spark):
    eq = panel(spark, {1: [1.1, 1.21, 0.605]}, "equity").drop("asset_id")
    row = evaluation.performance_stats(eq).first()
    moves = np.array([0.1, -0.5])
    assert row["max_drawdown"] == pytest.approx(-0.5) and row["annual_vol"] == pytest.approx(moves.std(ddof=1) * np.sqrt(252))
    assert row["sharpe"] == pytest.approx(moves.mean() / moves.std(ddof=1) * np.sqrt(252))


def test_tied_deciles(spark):
    w = {r["asset_id"]: r["book"] for r in decile_weights(panel(spark, {i: [1] for i in (1, 2, 3, 4)}, "score")).collect()}
    assert w == {1: "short", 4: "long"}
    assert decile_weights(panel(spark, {1: [1]}, "score")).count() == 0


def test_backtest_of_ties_and_costs(spark):
    s, r = scored(spark, {i: [1] for i in (1, 2, 3, 4)}, {1: [-0.5], 2: [0], 3: [0], 4: [0.5]})
    free = backtest.long_short_backtest(s, r, "D", 0.0)
    assert free.curve.first()["equity"] == pytest.approx(2.0)
    paid = backtest.long_short_backtest(s, r, "D", 0.001, 0.03).summary.first()
    assert list(paid) == pytest.approx([2.0, 0.504, 0.03])


def test_delisting_and_gaps(spark):
    s, r = scored(spark, {1: [1], 2: [2]}, {1: [0.0], 2: [None]})
    assert backtest.long_short_backtest(s, r, "D", 0.0).curve.first()["equity"] == pytest.approx(0.0)
    s, r = scored(spark, {1: [1, 1], 2: [2, 2]}, {1: [0.0, 0.0], 2: [None, 0.0]})
    assert values_of(backtest.long_short_backtest(s, r, "D", 0.0).curve) == pytest.approx([1.0, 1.0])


def values_of(curve):
    return [r["equity"] for r in curve.orderBy("date").collect()]


@pytest.mark.parametrize("bad", [{"turnover_cost": -0.1}, {"borrow_cost_annual": -0.1}])
def test_negative_costs(spark, bad):
    s, r = scored(spark, {1: [1]}, {1: [0.0]})
    with pytest.raises(ValueError):
        backtest.long_short_backtest(s, r, **bad)


def sequential(scores, rets, rebalance, cost, borrow):
    """The day-by-day recursion on arrays (dates x assets)."""
    n, m = scores.shape
    last = np.array([max((i for i in range(n) if not np.isnan(rets[i, a])), default=-1) for a in range(m)])
    lo, sh, out = np.zeros(m), np.zeros(m), []
    for i in range(n):
        c = 0.0
        if rebalance[i]:
            ok = [a for a in range(m) if not np.isnan(scores[i, a])]
            tl, ts = np.zeros(m), np.zeros(m)
            if len(ok) >= 2:
                order = sorted(ok, key=lambda a: scores[i, a])
                k = max(1, len(ok) // 10)
                top = min(k, len(ok) - k)
                ts[order[:k]], tl[order[len(order) - top :]] = 1 / k, 1 / top
            c = cost * (abs(tl - lo).sum() + abs(ts - sh).sum())
            lo, sh = tl, ts
        r = rets[i].copy()
        for a in range(m):
            if np.isnan(r[a]):
                r[a] = -1.0 if i > last[a] and lo[a] + sh[a] > 0 else 0.0
        out.append(lo @ r - sh @ r - c - borrow / 252 * sh.sum())
        for w in (lo, sh):
            g = w * (1 + r)
            w[:] = g / g.sum() if g.sum() != 0 else 0
    return np.cumprod(1 + np.array(out))


def test_closed_form_matches_the_recursion(spark):
    rng = np.random.default_rng(7)
    n, m = 75, 25
    scores, rets = rng.normal(size=(n, m)), rng.normal(0.001, 0.05, (n, m))
    scores[rng.random((n, m)) < 0.1] = np.nan
    rets[rng.random((n, m)) < 0.1] = np.nan
    rets[40:, :4] = np.nan
    nan = lambda v: [None if np.isnan(x) else float(x) for x in v]
    s, r = scored(spark, {a + 1: nan(scores[:, a]) for a in range(m)}, {a + 1: nan(rets[:, a]) for a in range(m)})
    days = [x[0] for x in s.select("date").distinct().orderBy("date").collect()]
    reb = [i == n - 1 or days[i].month != days[i + 1].month for i in range(n)]
    got = values_of(backtest.long_short_backtest(s, r, "ME", 0.001, 0.03).curve)
    assert got == pytest.approx(list(sequential(scores, rets, reb, 0.001, 0.03)), rel=1e-9)


def test_coverage_of_an_empty_base(spark):
    s, r = scored(spark, {1: [1, 2]}, {1: [1, 2]})
    pairs = evaluation.ic_inputs(s, r, "D")
    row = evaluation.ic_coverage(pairs, s.select("asset_id", "date", F.lit(False).alias("base")), 5).first()
    assert row["n_dates_below_min"] == 2 and row["coverage_p10"] is None


def test_ic_inputs_without_common_data(spark):
    s, r = panel(spark, {1: [1.0, 2.0]}, "score"), panel(spark, {2: [1.0, 2.0]}, "fwd_ret")
    with pytest.raises(ValueError, match="share no asset"):
        evaluation.ic_inputs(s, r, "D")
    with pytest.raises(ValueError, match="fewer than two rebalance dates"):
        evaluation.ic_inputs(s, r, "ME", panel(spark, {1: [1.0, 2.0]}, "price"))
