"""Moments over sliding windows at a cost that doesn't depend on their length.

A frame of fixed length is summed anew for each row. Here an asset's rows are cut into blocks as long as the window, so that
each window is the end of one block and the start of the next. Both come from running frames (one forwards, one
backwards), which are updated row by row, and are merged by the pairwise formula: means, squares and products
are about the means, so nothing large is subtracted. All steps keep the partitioning by asset: there are sorts, but no exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import by_asset, positive, ratio

_FIELDS = ("n", "y", "x", "yy", "xx", "xy")


def _running(y: Column, x: Column, frame, fields: tuple[str, ...]) -> Column:
    """Those of n, the means, the centred sums of squares and of products that are wanted, over a running frame; zeros where there is nothing."""
    n = F.count(y).over(frame)
    or_zero = lambda c: F.coalesce(c, F.lit(0.0))
    parts = (
        n.cast("double"), or_zero(F.avg(y).over(frame)), or_zero(F.avg(x).over(frame)), or_zero(F.var_pop(y).over(frame) * n), or_zero(F.var_pop(x).over(frame) * n),
        or_zero(F.covar_pop(y, x).over(frame) * n),
    )
    return F.struct(*[p.alias(name) for name, p in zip(_FIELDS, parts) if name in fields])


def _merged(a: Column, b: Column, fields: tuple[str, ...]) -> Column:
    """The moments of two sets of rows from those of each."""
    n = a["n"] + b["n"]
    share = lambda c: F.when(n > 0, c / F.when(n > 0, n)).otherwise(0.0)
    dy, dx, both = b["y"] - a["y"], b["x"] - a["x"], share(a["n"] * b["n"])
    parts = (n, a["y"] + dy * share(b["n"]), a["x"] + dx * share(b["n"]), a["yy"] + b["yy"] + dy * dy * both, a["xx"] + b["xx"] + dx * dx * both, a["xy"] + b["xy"] + dy * dx * both)
    return F.struct(*[p.alias(name) for name, p in zip(_FIELDS, parts) if name in fields])


def add_moments(panel: DataFrame, rows: int, pairs: dict[str, tuple[str, str]], fields: tuple[str, ...] = _FIELDS) -> DataFrame:
    """The panel with a struct (n, y, x, yy, xx, xy) for each name: of the pair of columns (y, x), over the last `rows` rows of the asset
    where both are there, their number, means, centred sums of squares and of products. `fields`: the ones that are wanted, since Spark
    doesn't find out by itself that others aren't; a field needs n and the means that its merging takes."""
    positive(rows, "rows")
    names = list(pairs)
    block = Window.partitionBy("asset_id", "__block").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rest = Window.partitionBy("asset_id", "__block").orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = {n: (F.when(F.col(x).isNotNull(), F.col(y)), F.when(F.col(y).isNotNull(), F.col(x))) for n, (y, x) in pairs.items()}
    out = panel.withColumn("__i", F.row_number().over(by_asset()) - 1).withColumn("__block", F.floor(F.col("__i") / rows))
    out = out.withColumns({f"__start_{n}": _running(*both[n], block, fields) for n in names})
    out = out.withColumns({f"__end_{n}": _running(*both[n], rest, fields) for n in names})
    # the window's first row lies in the block before, unless the window is a block
    out = out.withColumns({f"__end_{n}": F.lag(f"__end_{n}", rows - 1).over(by_asset()) for n in names})
    split = F.col("__i") % rows != rows - 1
    made = {n: F.when(split & F.col(f"__end_{n}").isNotNull(), _merged(F.col(f"__end_{n}"), F.col(f"__start_{n}"), fields)).otherwise(F.col(f"__start_{n}")) for n in names}
    return out.withColumns(made).drop("__i", "__block", *[f"__{k}_{n}" for k in ("start", "end") for n in names])


def add_low_volatility(panel: DataFrame, out: str = "low_vol", market: str = "mkt", ret: str = "ret", lookback: int = 252, min_rows: int = 252) -> DataFrame:
    """The negated residual volatility against `market`: population variance less what the
    market explains, floored at 0. NULL with fewer rows, or where the market doesn't vary."""
    if not 0 < min_rows <= lookback:
        raise ValueError(f"low volatility needs 1 to {lookback} rows, not {min_rows}")
    made, m = add_moments(panel, lookback, {"__m": (ret, market)}), F.col("__m")
    left = m["yy"] / m["n"] - F.pow(m["xy"] / m["n"], F.lit(2.0)) / (m["xx"] / m["n"])
    return made.withColumn(out, F.when((m["n"] >= min_rows) & (m["xx"] > 0), -F.sqrt(F.greatest(left, F.lit(0.0))))).drop("__m")


def add_rolling_beta(panel: DataFrame, out: str = "beta", market: str = "mkt", ret: str = "ret", lookback: int = 252, min_rows: int = 63) -> DataFrame:
    """Sample covariance with the market, where both are there, over the market's sample variance wherever it is."""
    made = add_moments(panel, lookback, {"__m": (ret, market), "__k": (market, market)})
    m, k = F.col("__m"), F.col("__k")
    beta = ratio(ratio(m["xy"], m["n"] - 1), ratio(k["yy"], k["n"] - 1))
    return made.withColumn(out, F.when((m["n"] >= min_rows) & (k["n"] >= min_rows), beta)).drop("__m", "__k")


def add_average_dollar_volume(panel: DataFrame, out: str = "adv", lookback: int = 63, volume: str = "dollar_volume") -> DataFrame:
    """The mean over the `lookback` rows before the present one, all of which must be there."""
    positive(lookback, "rows of average dollar volume")
    made = add_moments(panel, lookback, {"__m": (volume, volume)}, ("n", "y"))
    whole = F.when(F.col("__m")["n"] == lookback, F.col("__m")["y"])
    return made.withColumn(out, whole).withColumn(out, F.lag(out).over(by_asset())).drop("__m")
