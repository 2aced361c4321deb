"""The corpus pipeline on a small folder of tables."""

from __future__ import annotations

import random

import corpus_pipeline
from tessera.llm.queries import QUERIES


def test_stages(spark, tmp_path):
    r = random.Random(1)
    vocab = [f"word{i}" for i in range(500)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(120)), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(5)]
    rows += [(200, "x ! " * 100, "en", "s1", 1), (201, None, None, None, None), (202, "few words", "en", "s1", 1)]
    leak = " ".join(r.choice(vocab) for _ in range(30))
    rows += [(300, f"{rows[0][1]} {leak} {rows[1][1]} tail", "en", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_dedup", "decontamination", "mixing_sources", "token_output"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {x["doc_id"] for x in docs.collect()}
    assert {200, 201, 202}.isdisjoint(kept["quality_rules"]) and set(range(40)) <= kept["quality_rules"]
    assert set(range(40)) <= kept["simhash_dedup"] and not kept["simhash_dedup"] & set(range(100, 105))
    assert kept["decontamination"] == set(range(40))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(x["n_tokens"] for x in out) > 0 and {x["doc_id"] for x in out} <= set(range(40))
    assert set(QUERIES) == {f"op{i}_{n}" for i, n in enumerate("line_dedup mixing decontamination simhash language_id token_output warc quality_rules url_filters substring_dedup conversation_repair whitening toxicity".split(), 1)} | {"url_alias_verdicts"}


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_nulls_repeats_and_other_columns(spark, tmp_path):
    body = " ".join(f"w{i}" for i in range(80))
    rows = [(1, body, "en", None, None, "x"), (1, body, "en", None, None, "x"), (None, body + " end", None, "s", 1, "y"), (2, None, None, None, None, "z"), (3, "", "en", "s", 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    spark.createDataFrame([(None, "other words of an item"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"]
        kept.append(sorted(((r["doc_id"], r["row"]) for r in docs.collect()), key=str))
    assert kept == [[(1, "x"), (1, "x"), (None, "y")], [(1, "x")], [(1, "x")], [(1, "x")]]
    assert [r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()] == [1]
