"""Mixing sources to target weights by temperature (operator 2). DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import keyed_rows, materialize, require, row_key

#: Exponents tried in one job: five halvings of the interval at once.
_STEPS = 32


def count_words(text: Column) -> Column:
    """The default token count: words of a text, null or empty: 0."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def _measure(shares: DataFrame, alphas: list[float], budget_ratio: float) -> list[tuple[float, float, float]]:
    """(exponent, entropy, most repetitions) of the weights p^a / sum p^a for each exponent:
    one job that brings a row an exponent to the driver, however many sources there are."""
    power = F.exp(F.col("a") * F.ln("p"))
    rows = (
        shares.where("p > 0").select("p", F.explode(F.array(*[F.lit(a) for a in alphas])).alias("a"))
        .groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.col("a") * F.ln("p")).alias("s"), F.max(power / F.col("p")).alias("m"))
        .select("a", (F.ln("z") - F.col("s") / F.col("z")).alias("entropy"), (F.col("m") / F.col("z") * budget_ratio).alias("repeats"))
    )
    return sorted(tuple(r) for r in rows.collect())


def find_exponent(
    shares: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget_ratio: float = 1.0, rounds: int = 8
) -> float:
    """The exponent in [0, 1] for shares (column p). With exponent 1 sources keep their
    shares, with 0 all weigh the same; entropy and the most repetitions both fall as it rises. The smallest
    exponent (the evenest mix) is taken that keeps entropy at `target_entropy` nats or less, if that
    is given, and repetitions of any source's tokens at `max_repeats` or less, if that is. Where 1 still exceeds one, it is 1.
    Bisected, five halvings a job, to 2 ** -40."""
    low, high = 0.0, 1.0
    fits = lambda e, r: (target_entropy is None or e <= target_entropy + 1e-12) and (max_repeats is None or r <= max_repeats + 1e-12)
    for i in range(rounds):
        tried = _measure(shares, [low + (high - low) * k / _STEPS for k in range(_STEPS + 1)], budget_ratio)
        if not tried:
            return 1.0
        good = [a for a, e, r in tried if fits(e, r)]
        if not good:
            return 1.0
        if good[0] <= low:
            return low
        low, high = max(a for a, _, _ in tried if a < good[0]), good[0]
    return high


def weights(
    tokens: DataFrame, target_entropy_share: float | None = None, max_repeats: float | None = None, budget_tokens: int | None = None
) -> tuple[DataFrame, float]:
    """((source, total, weight, budget), exponent) from rows (source, total). `target_entropy_share` is a
    share of the entropy of equal weights. The budget is that of all tokens unless given."""
    stats = tokens.where("total > 0").agg(F.sum("total"), F.count("*")).first()
    whole, n = int(stats[0] or 0), int(stats[1])
    budget = whole if budget_tokens is None else budget_tokens
    shares = tokens.withColumn("p", F.col("total") / F.lit(float(max(whole, 1))))
    target = None if target_entropy_share is None else target_entropy_share * math.log(max(n, 1))
    alpha = find_exponent(shares, target, max_repeats, budget / max(whole, 1))
    power = F.when(F.col("p") > 0, F.exp(alpha * F.ln("p"))).otherwise(0.0)
    z = shares.agg(F.sum(power)).first()[0] or 1.0
    weight = power / F.lit(float(z))
    return shares.select("source", "total", weight.alias("weight"), F.round(weight * F.lit(float(budget))).cast("long").alias("budget")), alpha


def _passes(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, target_entropy_share: float | None, max_repeats: float | None,
    budget_tokens: int | None, seed: int,
) -> DataFrame:
    """(row_key, id, source, n_tokens, pass, last, taken, place): every row in every pass over its source, the last one, of
    which a part is taken, included."""
    rows = materialize(
        docs.select(
            row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("n_tokens")
        ),
        "mix-rows",
    )
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("total"))
    found, _ = weights(totals, target_entropy_share, max_repeats, budget_tokens)
    plan = materialize(
        found.select(
            F.col("source").alias("plan_source"), "total", "budget",
            F.when(F.col("total") > 0, F.expr("budget div total")).otherwise(1).alias("passes"),
            F.when(F.col("total") > 0, F.expr("budget % total")).otherwise(0).alias("rest"),
            F.greatest(F.lit(1), F.ceil(F.sqrt("total") / 16)).cast("long").alias("blocks"),
        ),
        "mix-plan",
    )
    salted = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "row_key"), F.col("blocks")))
    blocks = salted.groupBy("plan_source", "block", "passes").agg(F.sum("n_tokens").alias("block_tokens"))
    blocks = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), "passes")))
    turn = Window.partitionBy("plan_source", "pass").orderBy(F.xxhash64(F.lit(seed + 1), "plan_source", "pass", "block"), "block")
    starts = materialize(
        blocks.select(
            F.col("plan_source").alias("s"), F.col("block").alias("b"), "pass",
            F.coalesce(F.sum("block_tokens").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_block"),
        ),
        "mix-blocks",
    )
    inner = Window.partitionBy("plan_source", "block").orderBy(F.xxhash64(F.lit(seed + 2), "row_key"), "row_key").rowsBetween(Window.unboundedPreceding, -1)
    laid = salted.withColumn("before", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    placed = laid.join(starts, F.col("plan_source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    inside = F.col("before_block") + F.col("before")
    taken = (F.col("pass") < F.col("passes")) | ((F.col("n_tokens") > 0) & (inside < F.col("rest")))
    place = F.when(F.col("budget") > 0, (F.col("pass") * F.col("total") + inside) / F.col("budget")).otherwise(0.0)
    return placed.select("row_key", "id", "source", "n_tokens", "pass", (F.col("pass") == F.col("passes")).alias("last"), taken.alias("taken"), place.alias("place"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy_share: float | None = 0.99,
    max_repeats: float | None = 4.0, budget_tokens: int | None = None, seed: int = 0,
) -> DataFrame:
    """(row_key, id, source, n_tokens, pass, place): a row for each copy of a document in the mix.

    Each source's budget is realised by whole passes over it and a part of one more, in
    which documents come by blocks: a source is dealt by hash into about sqrt(tokens) / 16 blocks, each pass
    permutes the blocks anew, documents are permuted in their block, and of the last pass those that begin before
    the rest of the budget is used up are taken. `place` is the share of its source's budget that comes before the copy:
    in the order of place every stretch of the mix holds the sources by their weights. No source is gathered:
    running sums go over its blocks, a row each, and over one block's documents. A
    document that crosses the budget's end is in, so a source ends at most one document over.
    A null source is a source of its own. Rows without words have no tokens: they come along in each
    whole pass and cost nothing. Rows equal in id and text are told apart by a running number in their block.
    """
    require(docs, id_col, text_col, source_col)
    passes = _passes(docs, id_col, text_col, source_col, target_entropy_share, max_repeats, budget_tokens, seed)
    return passes.where("taken").select("row_key", "id", "source", "n_tokens", "pass", "place")


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy_share: float | None = 0.99,
    max_repeats: float | None = 4.0, budget_tokens: int | None = None, seed: int = 0,
) -> DataFrame:
    """The rows of `docs`, each as often as mix() takes it. Columns stay as they are, whatever their names.
    Rows equal in id and text come equally often, rounded up."""
    require(docs, id_col, text_col, source_col)
    passes = _passes(docs, id_col, text_col, source_col, target_entropy_share, max_repeats, budget_tokens, seed)
    found = passes.groupBy(F.col("row_key").alias("key")).agg(F.count_if("taken").alias("taken"), F.count_if("last").alias("rows")).where("taken > 0")
    plan = materialize(found.select("key", F.ceil(F.col("taken") / F.col("rows")).cast("int").alias("copies")), "mix")
    joined = keyed_rows(docs, id_col, text_col).join(plan.hint("merge"), F.col("k") == F.col("key"))
    return joined.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
