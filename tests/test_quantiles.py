"""Exact quantiles by bracketing against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import quantiles
from tessera.operators.quantiles import exact_quantiles

SHARES = (0.0, 0.01, 0.5, 0.999, 1.0)


def columns():
    r = random.Random(3)
    return {
        "even": [r.random() for _ in range(4000)],
        "wide": [10.0 ** r.uniform(-300, 300) * r.choice((-1, 1)) for _ in range(3001)],
        "two values": [0.0] * 1500 + [1.0] * 1500,
        "mostly one": [0.0] * 2900 + [r.gauss(0, 1) for _ in range(100)],
        "one": [5.0] * 3000,
        "few": [3.0, None, 1.0],
    }


def expected(values):
    return np.quantile([v for v in values if v is not None], SHARES)


@pytest.mark.parametrize("most", [50, 10**6])
def test_quantiles_of_groups(spark, monkeypatch, most):
    """Within 50 values a task, and with summaries so rough that several rounds are needed."""
    if most == 50:
        monkeypatch.setattr(quantiles, "ACCURACY", 100)
    rows = [(g, v) for g, vs in columns().items() for v in vs] + [(None, float(k)) for k in range(300)] + [("none", None)]
    got = {r["g"]: r["q"] for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(4), "v", SHARES, "g", most).collect()}
    for g, vs in columns().items():
        np.testing.assert_allclose(got[g], expected(vs), rtol=1e-12)
    assert got[None] == pytest.approx(np.quantile(range(300), SHARES)) and got["none"] is None


def test_what_is_left_is_bounded(spark, monkeypatch):
    """No sorted list is longer than `most`."""
    asked = []
    ask = quantiles._ask

    def counting(values, columns):
        asked.append(columns)
        return ask(values, columns)

    monkeypatch.setattr(quantiles, "_ask", counting)
    df = spark.range(20_000).select((F.col("id") % 7000 * 1.0).alias("v"))
    got = exact_quantiles(df, "v", (0.25,), most=40).first()["q"]
    assert got == pytest.approx([np.quantile(np.arange(20_000) % 7000, 0.25)])
    assert len(asked) >= 3  # bracketed, counted, then what is left is sorted


def test_no_rows(spark):
    assert exact_quantiles(spark.createDataFrame([], "v double"), "v", (0.5,)).collect() == []
