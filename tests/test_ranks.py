"""Ranks by ranges of values against one window."""

import datetime as dt
import random

import pytest
from helpers import panel
from pyspark.sql import functions as F

from tessera.functions.stages import stage
from tessera.operators import crosssection, evaluation, ranks


def rows(spark, seed=0):
    """One large date, full of ties (one value has a third of its rows), and small ones."""
    r = random.Random(seed)
    big = [(dt.date(2020, 1, 1), r.choice([0.0, r.randrange(40) / 8, r.gauss(0, 1)]), r.choice([1.0, r.gauss(0, 1)])) for _ in range(3000)]
    small = [(dt.date(2020, 1, 2 + k), float(k % 3), r.random()) for k in range(9)] + [(dt.date(2020, 3, 1), 5.0, 5.0)] * 4
    return spark.createDataFrame([(i, *x) for i, x in enumerate(big + small)], "asset_id long, date date, score double, fwd_ret double").repartition(5)


def test_ranges_rank_like_a_window(spark):
    df = stage(rows(spark), "ranked")
    found = [{r["asset_id"]: (r["rank_score"], r["rank_fwd_ret"]) for r in by(df, ["date"], ["score", "fwd_ret"]).collect()} for by in (ranks.by_window, ranks.by_ranges)]
    assert found[0] == found[1] and len(found[0]) == df.count()


def test_large_dates_go_by_ranges(spark, monkeypatch):
    df = stage(rows(spark, 1), "ranked")
    plans = [ranks.with_average_ranks(df, ["date"], ["score"], large)._jdf.queryExecution().executedPlan().toString() for large in (2999, 3000)]
    assert "rank(score" not in plans[0] and "rank(score" in plans[1]
    want = [tuple(r) for r in evaluation.ic_series(df, 3).orderBy("date").collect()]
    monkeypatch.setattr(ranks.with_average_ranks, "__defaults__", (10,))
    got = [tuple(r) for r in evaluation.ic_series(df, 3).orderBy("date").collect()]
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_no_rows(spark):
    none = stage(panel(spark, {1: [1.0]}, "score").where("false"), "none")
    assert ranks.with_average_ranks(none, ["date"], ["score"]).collect() == []


def test_places_by_ranges_are_those_of_a_window(spark):
    df = stage(rows(spark, 2), "placed")
    found = [sorted((r["asset_id"], r["place"], r["n"]) for r in ranks.with_places(df, ["date"], ["score", "asset_id"], large).collect()) for large in (10**6, 10)]
    assert found[0] == found[1] and len(found[0]) == df.count() and max(p for _, p, _ in found[0]) == 3000
    ranged = ranks.with_places(df, ["date"], ["score", "asset_id"], 10)
    assert ranged.columns == [*df.columns, "place", "n"]
    assert ranks.with_places(stage(df.where("false"), "none"), ["date"], ["score"]).collect() == []


def test_deciles_of_a_large_date_by_ranges(spark, monkeypatch):
    """A third of the large date's scores are equal, so that ties lie across the ends of ranges and of books."""
    df = rows(spark, 4).withColumn("t", F.lit(1))
    weights = lambda: sorted(tuple(r) for r in crosssection.decile_weights(df).collect())
    want = weights()
    monkeypatch.setattr(ranks.with_places, "__defaults__", (10,))
    assert weights() == want and sum(w[4] == "short" and w[1] == dt.date(2020, 1, 1) for w in [(r[0], r[1], r[2], r[4], r[3]) for r in want]) == 300
