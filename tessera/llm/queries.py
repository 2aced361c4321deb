"""The registered queries of the operators, with production parameters on whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import conversations, decontaminate, language, line_dedup, mixing, quality, repeats, simhash, tokens, toxicity, urls, warc, whitening
from tessera.llm.shared import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file; TESSERA_TOKENIZER names another one."""
    if "TESSERA_TOKENIZER" in os.environ:
        return os.environ["TESSERA_TOKENIZER"]
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "source", "n_tokens", "pass", "place")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.learn_and_identify(table(spark, sf_dir, "documents"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.write_and_read(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_and_read(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_report(table(spark, sf_dir, "documents"))
    return out.drop("rejected_by")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def url_alias_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's operator with redirects derived from the table itself: the pages link to none of each other."""
    pages = table(spark, sf_dir, "pages")
    before = pages.select((F.col("page_id") + 1).alias("next"), F.col("url").alias("dst"))
    redirects = pages.where("page_id % 5 <> 0").join(before, F.col("page_id") == F.col("next")).select(F.col("url").alias("src"), "dst")
    return urls.filter_urls(pages, redirects=redirects).select("page_id", "verdict")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.sha256_of_kept(repeats.remove_repeats(table(spark, sf_dir, "documents")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.repair_report(damaged).withColumnRenamed("id", "conv_id")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond 64 bits, which the operator gives as a decimal, is null here."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.learn_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_mixing, op3_decontamination, op4_simhash, op5_language_id,
        op6_token_output, op7_warc, op8_quality_rules, op9_url_filters, op10_substring_dedup, op11_conversation_repair, op12_whitening, op13_toxicity, url_alias_verdicts,
    )
}
