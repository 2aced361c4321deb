"""Quality rules as a short-circuit cascade (operator 8). DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, materialize, require

#: White space of a word list, and what is not.
SPACE, SOLID = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


Env = dict[str, Column]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is derived once for each row. What a lambda variable
    holds is never inlined again, however often `then` uses it and wherever Spark pushes it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _hashes(e: Env) -> Column:
    w = e["words"]
    return F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))


def _ranked(e: Env) -> Column:
    """The window hashes with their places, sorted; none if no hash comes twice."""
    h = e["hashes"]
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    return F.when(F.size(F.array_distinct(h)) < F.size(h), pairs).otherwise(none)


def _repeated_at(e: Env) -> Column:
    s = e["ranked"]
    same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
    places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(F.filter(places, lambda k: same(k, k + 1) | same(k, k - 1)), lambda k: F.get(s, k)["i"]))


def _covered(e: Env) -> Column:
    p = e["repeated_at"]
    rest = F.greatest(F.size(p) - 1, F.lit(0))
    gaps = F.zip_with(F.slice(p, F.lit(1), rest), F.slice(p, F.lit(2), rest), lambda a, b: F.least(F.lit(3), b - a))
    return F.when(F.size(p) > 0, F.aggregate(gaps, F.lit(3), lambda total, x: total + x)).otherwise(0).cast("long")


#: Features: what each is derived from, and how. All come from `body`, the text with null as empty.
FEATURES: dict[str, tuple[tuple[str, ...], Callable[[Env], Column]]] = {
    "words": (("body",), lambda e: F.array_remove(F.split(e["body"], SPACE), "")),
    "n_words": (("words",), lambda e: F.size(e["words"]).cast("long")),
    "word_chars": (("words",), lambda e: F.char_length(F.array_join(e["words"], "")).cast("long")),
    "n_symbols": (("body",), lambda e: F.regexp_count(e["body"], F.lit(r"[#*$%&|<>]")).cast("long")),
    "lines": (("body",), lambda e: F.filter(F.split(e["body"], "\n"), lambda x: x.rlike(SOLID))),
    "n_lines": (("lines",), lambda e: F.size(e["lines"]).cast("long")),
    "n_dup_lines": (("lines",), lambda e: (F.size(e["lines"]) - F.size(F.array_distinct(e["lines"]))).cast("long")),
    "hashes": (("words",), _hashes),
    "ranked": (("hashes",), _ranked),
    "repeated_at": (("ranked",), _repeated_at),
    "n_repeat_words": (("repeated_at",), _covered),
    "n_lettered": (("words",), lambda e: F.size(F.filter(e["words"], lambda w: w.rlike(r"\p{L}"))).cast("long")),
    "n_upper": (("body",), lambda e: F.regexp_count(e["body"], F.lit(r"\p{Lu}")).cast("long")),
    "n_letters": (("body",), lambda e: F.regexp_count(e["body"], F.lit(r"\p{L}")).cast("long")),
}


@dataclass(frozen=True)
class Rule:
    """`reject` is a condition over the features that `needs` names."""

    name: str
    needs: tuple[str, ...]
    reject: Callable[[Env], Column]


#: The first two are the base; the limits are those of published web-text filters.
BASE = (
    Rule("too_few_words", ("n_words",), lambda e: e["n_words"] < 50),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda e: 100 * e["n_repeat_words"] > 50 * e["n_words"]),
)
RULES = BASE + (
    Rule("symbols", ("n_words", "n_symbols"), lambda e: 10 * e["n_symbols"] > e["n_words"]),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda e: 10 * e["n_dup_lines"] > 3 * e["n_lines"]),
    Rule("word_length", ("n_words", "word_chars"), lambda e: (e["word_chars"] < 2 * e["n_words"]) | (e["word_chars"] > 15 * e["n_words"])),
    Rule("few_lettered_words", ("n_words", "n_lettered"), lambda e: 10 * e["n_lettered"] < 7 * e["n_words"]),
    Rule("upper_case", ("n_upper", "n_letters"), lambda e: 2 * e["n_upper"] > e["n_letters"]),
)


def with_features(env: Env, names: Sequence[str], then: Callable[[Env], Column]) -> Column:
    """`then` of the environment with the named features and what they are derived from."""
    for name in names:
        if name in env:
            continue
        needs, make = FEATURES[name]
        if all(n in env for n in needs):
            return let(make(env), lambda v: with_features({**env, name: v}, names, then))
        return with_features(env, needs, lambda e: with_features(e, names, then))
    return then(env)


def verdict(env: Env, rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, or NULL. A rule's features are derived
    in the branch that is reached only if no earlier rule rejected."""
    if not rules:
        return F.lit(None).cast("string")
    rule = rules[0]
    return with_features(env, rule.needs, lambda e: F.when(rule.reject(e), F.lit(rule.name)).otherwise(verdict(e, rules[1:])))


def _body(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _rejects(rule: Rule, text_col: str) -> Column:
    return let(_body(text_col), lambda b: with_features({"body": b}, rule.needs, rule.reject))


def _seconds(sample: DataFrame, measure: Column) -> tuple[float, int]:
    """(least seconds of three runs, result) of an aggregate over the sample; the first run compiles and isn't timed."""
    probe = sample.agg(measure)
    found = probe.first()[0]
    times = []
    for _ in range(3):
        began = time.perf_counter()
        probe.first()
        times.append(time.perf_counter() - began)
    return min(times), found or 0


def order_rules(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = 500) -> list[Rule]:
    """The rules by rejection per cost, highest first, as estimated on a sample: each rule alone is timed over it, less what a
    job that only measures the texts takes, and its rejections are counted. Only the order depends on the sample; the
    verdicts don't. On an empty table the order stays. The sample is drawn from the whole table with the probability that
    gives `sample_rows` rows on average (every row of a smaller table), and written to the shared folder; a
    sample of over 8 times that, which chance doesn't give, is cut."""
    require(docs, text_col)
    share = min(1.0, sample_rows / max(docs.count(), 1))
    drawn = docs.select(F.col(text_col).alias("text"))
    sample = materialize((drawn if share == 1 else drawn.sample(False, share, 11)).limit(8 * sample_rows), "rule-sample")
    rows = sample.count()
    base, _ = _seconds(sample, F.sum(F.octet_length("text")))
    scored = []
    for i, rule in enumerate(rules):
        seconds, rejected = _seconds(sample, F.count_if(_rejects(rule, "text")))
        scored.append((-(rejected / rows if rows else 0.0) / max(seconds - base, 1e-3), i, rule))
    discard(sample)
    return [rule for _, _, rule in sorted(scored, key=lambda x: x[:2])]


def judge(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """The columns of `docs` and rejected_by: the first rule in order that rejects
    the row, null if it is kept. Without `rules`, RULES in the order of
    order_rules(). Null text counts as empty. One expression over the text: no shuffle, no
    Python, and a filter on it moves down to the scan as it is. A column of docs that is
    called rejected_by is replaced.
    """
    require(docs, text_col)
    ordered = order_rules(docs, text_col) if rules is None else rules
    found = let(_body(text_col), lambda b: verdict({"body": b}, ordered))
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "rejected_by"], found.alias("rejected_by"))


def keep_accepted(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """The rows of `docs` that no rule rejects. Their columns stay as they are, whatever their names."""
    require(docs, text_col)
    ordered = order_rules(docs, text_col) if rules is None else rules
    return docs.where(let(_body(text_col), lambda b: verdict({"body": b}, ordered)).isNull())


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, rejected_by) of every row: the five counts are made for all rows, the other
    features only where the cascade comes to them. kept is false if a base rule or any
    other rule rejects the row. rejected_by names the first in cascade order.
    """
    require(docs, id_col, text_col)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    ordered = order_rules(docs, text_col) if rules is None else rules

    def report(e: Env) -> Column:
        failed = F.lit(False)
        for rule in BASE:
            failed = failed | rule.reject(e)
        return F.struct(*[e[c].alias(c) for c in counts], failed.alias("base_failed"), verdict(e, ordered).alias("rejected_by"))

    found = let(_body(text_col), lambda b: with_features({"body": b}, [*counts, "n_words"], report))
    rows = docs.select(F.col(id_col).alias("id"), found.alias("r"))
    kept = ~F.col("r.base_failed") & F.col("r.rejected_by").isNull()
    return rows.select(F.col("id").alias(id_col), *[f"r.{c}" for c in counts], "r.base_failed", kept.alias("kept"), "r.rejected_by")
