"""Operators across the assets of a date."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import across, count_non_null, ratio, sum_or_zero
from tessera.functions.stages import stage
from tessera.operators.ranks import with_places


#: Dates of fewer values give all of them to be sorted for their quantiles, larger ones only their tails.
FEW_VALUES = 2_000


def date_bounds(panel: DataFrame, names: Sequence[str], lower: float = 0.01, upper: float = 0.99, few: int = FEW_VALUES) -> DataFrame:
    """(date, low_<name>, high_<name>): each column's exact quantiles, by linear interpolation. Mergeable summaries find values that lie surely
    inside of the quantiles (at three times their share, off by a thousandth at most); then only what lies outside of these is collected and sorted."""
    cuts = [min(3 * lower + 0.01, 1.0), max(1 - 3 * (1 - upper) - 0.01, 0.0)]
    counted = [c for n in names for c in (F.count(n).alias(f"n_{n}"), F.percentile_approx(n, F.array(*map(F.lit, cuts)), F.lit(1_000)).alias(f"cut_{n}"))]
    marked = panel.select("date", *names).join(F.broadcast(panel.groupBy("date").agg(*counted)), "date")
    wanted = []
    for n in names:
        whole, cut = F.col(f"n_{n}") < few, lambda k, n=n: F.get(f"cut_{n}", F.lit(k))
        tail = lambda inside: F.sort_array(F.collect_list(F.when(whole | inside, F.col(n))))  # noqa: B023, E731
        wanted += [F.first(f"n_{n}").alias(f"n_{n}"), tail(F.col(n) <= cut(0)).alias(f"lowest_{n}"), tail(F.col(n) >= cut(1)).alias(f"highest_{n}")]

    def quantile(n: str, share: float, values: str, skipped: Column) -> Column:
        place = (F.col(f"n_{n}") - 1) * F.lit(float(share))
        at = lambda rank: F.element_at(values, (rank - skipped + 1).cast("int"))  # noqa: E731  # an error outside of what was collected
        below, above = at(F.floor(place)), at(F.ceil(place))
        between = F.when(below == above, below).otherwise((F.ceil(place) - place) * below + (place - F.floor(place)) * above)
        return F.when(F.col(f"n_{n}") > 0, between)

    made = []
    for n in names:
        made.append(quantile(n, lower, f"lowest_{n}", F.lit(0)).alias(f"low_{n}"))
        made.append(quantile(n, upper, f"highest_{n}", F.col(f"n_{n}") - F.size(f"highest_{n}")).alias(f"high_{n}"))
    return marked.groupBy("date").agg(*wanted).select("date", *made)


def winsorize(panel: DataFrame, names: Sequence[str], lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Clip each column at its date's quantiles (linear interpolation). The bounds of all columns are written, a row a date, and are
    broadcast; without bounds nothing is clipped. The panel is read three times, so it should be a written table."""
    bounds = stage(date_bounds(panel, names, lower, upper), "bounds")
    clipped = {n: F.when(F.col(n).isNotNull(), F.least(F.greatest(n, f"low_{n}"), f"high_{n}")) for n in names}
    return panel.join(F.broadcast(bounds), "date").withColumns(clipped).drop(*bounds.columns[1:])


def standardize(panel: DataFrame, names: Sequence[str]) -> DataFrame:
    """z-scores by the population deviation; NULL where that is 0. One aggregate gives the moments of all columns, a row a date, and is
    broadcast, so the panel keeps its dealing by asset; it is read twice, so it should be a written table, or little more than one."""
    moments = panel.groupBy("date").agg(*[f(n).alias(f"__{k}_{n}") for n in names for k, f in (("avg", F.avg), ("dev", F.stddev_pop))])
    out = panel.join(F.broadcast(moments), "date").withColumns({n: ratio(F.col(n) - F.col(f"__avg_{n}"), F.col(f"__dev_{n}")) for n in names})
    return out.select(*panel.columns)


def normalize_components(panel: DataFrame, names: Sequence[str]) -> DataFrame:
    return standardize(winsorize(panel, names), names)


def mean_of_available(names: Sequence[str], at_least: int) -> Column:
    """The mean of the columns that are there, if enough are."""
    n = count_non_null(names)
    return F.when(n >= at_least, ratio(sum_or_zero(names), n.cast("double")))


def sector_neutralize(panel: DataFrame, names: Sequence[str], sector: str = "sector") -> DataFrame:
    """Less the mean of the date's assets of one sector; NULL without a sector."""
    w = Window.partitionBy("date", sector)
    return panel.withColumns({n: F.when(F.col(sector).isNotNull(), F.col(n) - F.avg(n).over(w)) for n in names})


def market_neutralize(panel: DataFrame, names: Sequence[str], beta: str = "beta") -> DataFrame:
    """The residual of a regression on beta in each date, over assets that have both; NULL with fewer
    than two, and the centred score where beta doesn't vary."""
    w = across()
    out = panel
    for n in names:
        both = F.col(n).isNotNull() & F.col(beta).isNotNull()
        x, y = F.when(both, F.col(beta)), F.when(both, F.col(n))
        xc, yc = x - F.avg(x).over(w), y - F.avg(y).over(w)
        sxx, sxy = F.var_pop(x).over(w), F.covar_pop(x, y).over(w)
        fitted = F.when(sxx > 0, yc - sxy / F.when(sxx > 0, sxx) * xc).otherwise(yc)
        out = out.withColumn(f"__{n}", F.when(both & (F.count(y).over(w) >= 2), fitted))
    return out.drop(*names).withColumnsRenamed({f"__{n}": n for n in names})


MODES = ("none", "sector", "market")


def neutralize(panel: DataFrame, names: Sequence[str], mode: str = "none") -> DataFrame:
    """By one mode; the modes can't be combined."""
    if mode not in MODES:
        raise ValueError(f"neutralization_mode must be one of {MODES}, not {mode!r}")
    if mode == "sector":
        return sector_neutralize(panel, names)
    if mode == "market":
        return market_neutralize(panel, names)
    return panel


def equal_weight(price_factors: Sequence[str], fundamental_factors: Sequence[str], require_first: bool = True) -> Column:
    """The mean of the factors that are there, if 5 of all, 2 price and 2 fundamental ones are (or all, where
    there are fewer). `require_first`: NULL where the first factor is."""
    names = [*price_factors, *fundamental_factors]
    gate = count_non_null(names) >= min(5, len(names))
    gate = gate & (count_non_null(price_factors) >= min(2, len(price_factors)))
    gate = gate & (count_non_null(fundamental_factors) >= min(2, len(fundamental_factors)))
    if require_first:
        gate = gate & F.col(names[0]).isNotNull()
    return F.when(gate, ratio(sum_or_zero(names), count_non_null(names).cast("double")))


def candidate_composite(panel: DataFrame, names: Sequence[str], min_coverage: float = 0.60, require_first: bool = True) -> Column:
    """The mean of the named factors that are there, if enough are; names that the panel lacks are
    skipped. `require_first`: NULL where the first of them is."""
    present = [n for n in names if n in panel.columns]
    if not present:
        raise ValueError(f"none of the factors {list(names)} is in the panel")
    need = max(1, math.ceil(min_coverage * len(present)))
    gate = count_non_null(present) >= need
    if require_first:
        gate = gate & F.col(present[0]).isNotNull()
    return F.when(gate, ratio(sum_or_zero(present), count_non_null(present).cast("double")))


def decile_weights(scores: DataFrame, score: str = "score", *extra: str) -> DataFrame:
    """(…, book, weight) of the assets held: of n >= 2 scored assets the k = max(1, n div 10) lowest are short and
    the k highest (n - k at most) long, each with equal weights; ties are in the order of assets. The scored rows are written once, and a date
    of very many is sorted by ranges."""
    scored = stage(scores.where(F.col(score).isNotNull()).select(*extra, "asset_id", "date", "t", score), "scored-rows")
    ranked = with_places(scored, [*extra, "date"], [score, "asset_id"]).where("n >= 2")
    ranked = ranked.withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") * 0.1)).cast("int"))
    n_long = F.least(F.col("k"), F.col("n") - F.col("k"))
    book = F.when(F.col("place") <= F.col("k"), "short").when(F.col("place") > F.col("n") - n_long, "long")
    held = ranked.withColumn("book", book).where("book is not null")
    weight = 1.0 / F.when(F.col("book") == "short", F.col("k")).otherwise(n_long)
    return held.select(*extra, "asset_id", "date", "t", "book", weight.cast("double").alias("weight"))
