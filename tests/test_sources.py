import datetime as dt

import pytest
from helpers import panel, values
from pyspark.sql import functions as F

from tessera.operators.factors import SIGNALS
from tessera.sources import market, signals
from tessera.streaming.bars import bars

D = dt.date


def test_business_days(spark):
    df = spark.createDataFrame([(D(2020, 2, 14),), (D(2020, 2, 15),), (D(2020, 2, 16),), (D(2020, 2, 12),)], "d date")
    out = [(str(r[1]), str(r[2])) for r in df.select("d", market.add_business_days("d", 1), market.add_business_days("d", 2)).collect()]
    assert out == [("2020-02-17", "2020-02-18"), ("2020-02-17", "2020-02-18"), ("2020-02-17", "2020-02-18"), ("2020-02-13", "2020-02-14")]
    with pytest.raises(ValueError):
        market.add_business_days("d", -1)


def statements(spark):
    rows = [(1, D(2019, 12, 31), D(2020, 2, 14), 1.0, 1), (1, D(2020, 3, 31), D(2020, 2, 14), 2.0, 2), (2, D(2019, 12, 31), None, 3.0, 3)]
    return spark.createDataFrame(rows, "asset_id long, report_date date, publish_date date, metric double, ingest_seq long")


def test_publish_alignment(spark):
    out = market.publish_aligned(statements(spark), 1, "keep_last").collect()
    assert [(r["asset_id"], str(r["eff_date"]), r["metric"]) for r in out] == [(1, "2020-02-17", 2.0)]
    with pytest.raises(Exception, match="duplicate statements"):
        market.publish_aligned(statements(spark), 1, "raise").collect()


def test_ids(spark):
    df = spark.createDataFrame([("1", D(2020, 1, 1), 1), ("1", D(2020, 1, 1), 2), ("x", D(2020, 1, 1), 3), ("2.0", D(2020, 1, 1), 4), (None, None, 5)], "asset_id string, date date, ingest_seq long")
    out = market.canonical(df, dedupe=True).orderBy("asset_id").collect()
    assert [(r["asset_id"], r["ingest_seq"]) for r in out] == [(1, 2), (2, 4)]
    assert {r[0] for r in market.company_ids(df).collect()} == {1, 2}


def test_sectors(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "asset_id long")
    companies = spark.createDataFrame([(1, "Tech"), (2, "  ")], "asset_id long, sector string")
    assert dict(market.sector_map(ids, companies).orderBy("asset_id").collect()) == {1: "Tech", 2: "Unknown", 3: "Unknown"}
    by_industry = market.sector_map(ids.limit(1), spark.createDataFrame([(1, 7)], "asset_id long, industry_id long"), spark.createDataFrame([(7, "Oil")], "industry_id long, sector string"))
    assert by_industry.first()["sector"] == "Oil"
    with pytest.raises(Exception, match="no asset has a sector"):
        market.sector_map(ids, companies.where("asset_id = 2")).collect()
    with pytest.raises(Exception, match="not an id"):
        market.sector_map(spark.createDataFrame([(101.5,)], "asset_id double"), companies).collect()


def test_price_panel(spark):
    rows = spark.createDataFrame(
        [(1, D(2020, 1, 1), 10.0, 9.0, 490.0), (1, D(2020, 1, 2), 0.0, 9.0, 1.0), (2, D(2020, 1, 2), float("inf"), 1.0, 1.0), (2, D(2020, 1, 3), 3.0, 1.0, 2.0)],
        "asset_id long, date date, adj_close double, close double, volume double",
    )
    out = market.price_panel(rows)
    assert values(out, "price") == [10, None, None, 3] and values(out, "dollar_volume", 1) == [4410.0, None]
    with pytest.raises(KeyError):
        market.price_panel(rows.drop("volume"))


def test_as_of_carries_whole_rows(spark):
    left = spark.createDataFrame([(1, D(2020, 1, d)) for d in (1, 3, 5)], "asset_id long, date date")
    right = spark.createDataFrame([(1, D(2020, 1, 2), 1.0, 1.0), (1, D(2020, 1, 5), None, 2.0)], "asset_id long, eff_date date, a double, b double")
    assert [(r["a"], r["b"]) for r in market.as_of(left, right, ["a", "b"]).orderBy("date").collect()] == [(None, None), (1, 1), (None, 2)]


def test_growth_and_fallbacks(spark):
    rows = spark.createDataFrame([(a, D(2019 + q // 4, 3 * (q % 4) + 1, 1), float(10 * a + q)) for a in (1, 2) for q in range(5)], "asset_id long, eff_date date, revenue double")
    out = signals.growth(rows, "revenue", "g").orderBy("asset_id", "eff_date").collect()
    assert [r["g"] for r in out][4] == pytest.approx(0.4) and [r["g"] for r in out][9] == pytest.approx(0.2) and out[5]["g"] is None
    m = signals.operating_margin_fallback(spark.createDataFrame([(1.0, 0.0), (1.0, 4.0)], "operating_income double, revenue double"))
    assert [r["operating_margin"] for r in m.collect()] == [None, 0.25]
    b = signals.book_market_fallback(spark.createDataFrame([(2.0,), (0.0,)], "price_book double"))
    assert [r["book_market"] for r in b.collect()] == [0.5, None]


def test_signal_selection(spark):
    p = panel(spark, {1: [1]}).withColumns({s: F.lit(float("inf")) for s in SIGNALS})
    assert signals.select_signals(p).first()["roa"] is None
    with pytest.raises(KeyError):
        signals.select_signals(p.drop("roa"))


def test_source_and_bars(spark, tmp_path, sf_dir):
    with pytest.raises(ValueError):
        market.Source(" ")
    ids = spark.createDataFrame([(1,)], "asset_id long")
    rows = spark.createDataFrame([(1, D(2020, 1, 1), 1.0, 1.0, 1.0, 1), (1, D(2021, 1, 1), 2.0, 1.0, 1.0, 2), (9, D(2021, 1, 1), 2.0, 1.0, 1.0, 3)], market.MARKET_SCHEMA)
    for kind in ("parquet", "csv", "json", "orc"):
        rows.write.format(kind).save(f"{tmp_path}/{kind}/market")
        assert market.market_rows(market.Source(f"{tmp_path}/{kind}", kind), spark, ids, "2020-06-01").count() == 1
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("asset_id"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"))
    events.write.parquet(f"{tmp_path}/events")
    stream = bars(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"))
    q = stream.writeStream.format("memory").queryName("stream_bars").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("stream_bars").count() == bars(events).count()
