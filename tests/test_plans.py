import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import stages
from tessera.functions.stages import stage
from tessera.operators import grid, qc
from tessera.operators.cleaning import CleanPanel
from tessera.plans import demo, pipeline, protocol, views
from tessera.plans.oracles import ORACLES
from tessera.plans.queries import QUERIES
from tessera.plans.settings import Cleaning, Model, Neutral, Quality, Reading, Trading, Universe
from tessera.sources.market import Source

TABLES = "region nation customer supplier part orders lineitem events".split()


def canon(rows):
    show = lambda v: "null" if v is None or v != v else (f"{v:.5g}" if isinstance(v, float) else str(v)[:10])
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", ["suspect_persistent_shift", "two_pass_clean", "qc_display", "sql_over_views", "low_vol", "market_neutral", "universe_mask", "asof_signals", "quality_factor", "backtest_equity", "factor_report", "windows_by_blocks", "asof_by_blocks", "equity_by_blocks"])
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert canon(got.select(*names).collect()) == canon(want.fetchall())


def test_registry(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(QUERIES) <= set(queries)
    assert entry.entry(spark).columns == ["date", "ic", "n"]


@pytest.mark.parametrize("part,bad", [
    (Neutral, {"mode": "both"}), (Neutral, {"mode": "market"}), (Neutral, {"beta_least": 300}), (Model, {"price_factors": ("x",)}), (Model, {"fundamental_factors": ()}), (Model, {"output": "ridge"}),
    (Trading, {"turnover_cost": -1.0}), (Trading, {"assets_for_ic": 0}), (Reading, {"days_to_known": -1}), (Quality, {"coverage": 1.5}), (Cleaning, {"assets_per_date": 0}), (Universe, {"price_floor": 0.0}),
])
def test_settings_are_checked(part, bad):
    with pytest.raises(ValueError):
        part(**bad)


def test_run_from_files(spark, sf_dir, tmp_path):
    """The whole run, from a folder of tables."""
    from dataclasses import replace

    bars = demo.bars(spark, sf_dir)
    bars.select("asset_id", "date", F.col("price").alias("adj_close"), F.col("price").alias("close"), (F.col("dollar_volume") / F.col("price")).alias("volume"), F.lit(1).cast("long").alias("ingest_seq")).write.parquet(f"{tmp_path}/market")
    demo.sectors(spark, sf_dir).write.parquet(f"{tmp_path}/companies")
    known = demo.statements(spark, sf_dir).withColumn("equity", F.col("total_assets") - F.col("total_debt")).withColumn("free_cash_flow", F.col("operating_income")).withColumn("dividends_paid", F.col("net_income"))
    for name in ("income_ttm", "balance_quarterly", "cashflow_ttm"):
        known.write.parquet(f"{tmp_path}/{name}")
    for name in ("income_quarterly", "balance_ttm", "cashflow_quarterly"):
        known.limit(1).write.parquet(f"{tmp_path}/{name}")
    base = demo.SETTINGS
    settings = replace(
        base, neutral=replace(base.neutral, mode="sector"), trading=replace(base.trading, assets_for_ic=3), cleaning=replace(base.cleaning, assets_per_date=3),
        universe=replace(base.universe, price_floor=None),
    )
    out = pipeline.run(spark, Source(str(tmp_path)), settings)
    assert set(pipeline.summary(out)) == {"mean_ic", "t_newey_west", "annual_vol", "sharpe", "max_drawdown"}
    assert out.core.factor_qc.count() == 7 and out.core.price_qc.count() == 2
    with pytest.raises(ValueError, match="market_asset_id"):
        pipeline.run(spark, Source(str(tmp_path)), replace(settings, neutral=replace(base.neutral, mode="market")))
    ridge = replace(settings, model=replace(base.model, output="ridge"), neutral=replace(base.neutral, mode="market", market_asset_id=1))
    core = pipeline.run_core(pipeline.load(spark, Source(str(tmp_path)), ridge), ridge)
    assert "ridge" in core.panel.columns
    with pytest.raises(ValueError):
        pipeline.run_core(pipeline.load(spark, Source(str(tmp_path)), settings), replace(settings, model=replace(base.model, output="nope")))


def test_protocol_rules(spark):
    days = spark.createDataFrame([("2010-05-01",), ("2012-12-31",), ("2013-01-01",), ("2014-01-01",)], "d string").select(F.col("d").cast("date").alias("d"))
    halves = lambda a, b: [r[0] for r in days.orderBy("d").select(protocol.first_half(F.col("d"), a, b)).collect()]
    assert halves("2010-01-01", "2014-12-31") == [True, True, False, False] and halves("2010-01-01", "2013-12-31") == [True, False, False, False]
    assert halves("2010-01-01", "2010-12-31")[0]
    with pytest.raises(ValueError, match="before it begins"):
        protocol.first_half(F.col("d"), "2011-01-01", "2010-12-31")
    report = spark.createDataFrame([("a", -1.0, -1.0, -1.0), ("b", -1.0, -1.0, None), ("c", 1.0, -1.0, -1.0)], "factor string, train_ic_mean_spearman double, train_ic_mean_first_half double, train_ic_mean_second_half double")
    assert protocol.select_factors(report, "drop_stably_negative") == ["b", "c"]
    with pytest.raises(ValueError):
        protocol.select_factors(report, "best")


def test_selected_scores(spark, sf_dir):
    from tessera.plans.queries import PRICED, _standardized

    panel = _standardized(spark, sf_dir).persist()
    ew = protocol.selected_scores(panel, PRICED, "ew", "all", "1996-01-01", "1998-12-31", "QE", "1999-01-01", "1999-12-31")
    assert ew.count() > 0
    with pytest.raises(ValueError):
        protocol.selected_scores(panel, PRICED, "ridge", "all", "1996-01-01", "1998-12-31", "QE", "1999-01-01")


def test_no_exchange_by_asset_after_the_clean_panel(spark, sf_dir, monkeypatch):
    """From the clean panel on, windows and joins by asset read stages that are dealt by asset; dates come as aggregates, or by one exchange."""
    seen = {}

    def recording(df, name, *args, **kwargs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen[name] = re.findall(r"Exchange hashpartitioning\((asset_id#[^)]*)\)", plan)
        return stage(df, name, *args, **kwargs)

    monkeypatch.setattr(pipeline, "stage", recording)
    QUERIES["research_core"](spark, sf_dir)
    assert {"price-factors", "fundamental-factors", "factors", "scored", "universe"} <= set(seen)
    assert {name: found for name, found in seen.items() if found and name != "signals"} == {}
    assert len(seen["signals"]) == 1  # statements and market rows meet by asset


def test_the_grid_reads_its_rows_once(spark, sf_dir, monkeypatch):
    written = []
    monkeypatch.setattr(grid, "stage", lambda df, *a, **k: written.append(df) or stage(df, *a, **k))
    plan = demo.grid(spark, sf_dir, "week")._jdf.queryExecution().executedPlan().toString()
    assert len(written) == 1 and "lineitem" not in plan and "hashpartitioning(asset_id" not in plan


def test_stages_are_deleted(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "asset_id")
    plain, dealt = stage(df, "plain"), stage(df, "dealt-out", by="asset_id")
    assert plain.count() == dealt.count() == 10 and stages.is_stage(dealt) and not stages.is_stage(df)
    folders = [plain._tessera_stage, dealt._tessera_stage]
    assert all(os.path.isdir(f) for f in folders)
    stages.unstage(plain)
    assert not os.path.exists(folders[0])
    assert stages.release_stages(spark) >= 1 and not os.path.exists(folders[1])
    assert stages.release_stages(spark) == 0


def test_scores_of_the_ridge_protocol(spark):
    """The ridge branch, on a hundred assets: factors chosen on the train window, then the tuned ridge of these, cut to the scoring window."""
    from tessera.operators.ridge import RidgeSettings, tune_ridge
    from tessera.plans.queries import PRICED, _standardized

    panel = stage(_standardized(spark, "/root/testdata/sf0.01"), "standardized", by="asset_id")
    arguments = ("rolling", 30)
    got = protocol.selected_scores(panel, PRICED, "ridge", "all", "1995-06-01", "1998-12-31", "ME", "2001-03-01", "2001-09-01", (1.0, 100.0), 3, *arguments)
    fit = tune_ridge(panel, panel, panel, "ME", PRICED, "2001-03-01", (1.0, 100.0), RidgeSettings(*arguments, refit_every=3))
    want = fit.scores.where("date between '2001-03-01' and '2001-09-01'")
    rows = lambda df: {(r["asset_id"], r["date"]): r["score"] for r in df.where("score is not null").collect()}
    assert rows(got) and rows(got) == pytest.approx(rows(want))


def test_views(spark):
    df = spark.createDataFrame([(1, 2.0)], "date int, score double")
    clean = CleanPanel(df, df, df)
    core = pipeline.Core(df, df, clean, df, df, df, df)
    names = views.register(core, "mine")
    assert "mine_tradable" in names and "mine_ic" not in names and spark.sql("select score from mine_tradable").first()[0] == 2.0
    assert "mine_ic" in views.register(pipeline.Run(core, *[df] * 6), "mine")
    with pytest.raises(ValueError, match="name of a view"):
        views.register(core, "no name")


def test_a_run_scans_line_items_once_and_deals_no_panel_by_date(spark, sf_dir, monkeypatch):
    """Bars and statements come from one written aggregate, and standardizing needs no window by date; nothing is done for quality tables that nobody asks for."""
    plans = {}

    def recording(df, name, *args, **kwargs):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name, *args, **kwargs)

    for module in (pipeline, demo, grid, qc):
        monkeypatch.setattr(module, "stage", recording)
    QUERIES["research_core"](spark, sf_dir)
    assert {name: p.count("lineitem.parquet") for name, p in plans.items() if "lineitem" in p} == {"sales": 1}
    assert [name for name in ("fundamental-factors", "scored") if "Window" in plans[name]] == []
    assert "factor-cells" not in plans


def test_quality_tables_are_made_once_when_asked_for(spark):
    df, made = spark.range(1), []
    core = pipeline.Core(df, df, CleanPanel(df, df, df), df, lambda: made.append("price") or df, df, lambda: made.append("factor") or df)
    assert made == [] and core.price_qc is df and core.price_qc is df and core.removed is df and made == ["price"]
