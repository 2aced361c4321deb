"""Refresh: new dates are appended to a panel without computing the earlier ones again.

What later rows need of earlier ones is a bounded tail of the calendar: as many dates as the longest window, for every asset. A
refresh reads that tail and the new rows only, so its cost doesn't grow with the history, and gives the rows that a run over everything would."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import positive, require_columns
from tessera.functions.stages import stage
from tessera.operators import cleaning, moving, timeseries
from tessera.operators.cleaning import CleaningRules
from tessera.operators.grid import dense_grid


@dataclass(frozen=True)
class Windows:
    """What is kept up: momentum over momentum - skip rows, average dollar volume and the quality mask over the rows before."""

    momentum: int = 252
    skip: int = 21
    volume: int = 63
    quality: int = 252
    hard_events: int = 3
    coverage: float = 0.95
    rules: CleaningRules = field(default_factory=CleaningRules)

    def __post_init__(self) -> None:
        positive(self.volume, "rows of average dollar volume")
        positive(self.quality, "rows of the quality mask")

    @property
    def depth(self) -> int:
        """Dates to carry: the longest window, one for its first return, and one to judge that return's first price."""
        return max(self.momentum, self.volume, self.quality) + 2


@dataclass
class Refreshed:
    """cells: asset_id, date, t, price (clean), ret, hard, momentum, adv, quality_ok of the new dates; tail: what the next refresh needs."""

    cells: DataFrame
    tail: DataFrame


def refresh(rows: DataFrame, tail: DataFrame | None = None, windows: Windows = Windows()) -> Refreshed:
    """The cells of the dates of `rows` (asset_id, date, price, dollar_volume), which come after those of `tail`, the Refreshed.tail of
    the dates before, or None for the first run. Rows that aren't later than the tail are an error: a corrected history needs a full run.

    Every asset of the tail has a cell at every new date; without rows it stays missing. An asset that is new has cells
    from its first refresh on; in a full run it has cells before, too, which are all missing. t goes on from the tail's.
    No rows give no cells and the same tail. Repeated rows of a cell count once, as in dense_grid()."""
    require_columns(rows, ["asset_id", "date", "price", "dollar_volume"], "rows")
    new = rows.select("asset_id", "date", "price", "dollar_volume")
    last, offset = None, 0
    if tail is not None:
        last, first_t = tail.agg(F.max("date"), F.min("t")).first()  # one row
        offset = (first_t or 1) - 1
    if last is not None:
        if not new.where(F.col("date") <= F.lit(last)).isEmpty():
            raise ValueError(f"rows up to {last} are there already; a refresh takes later ones")
        new = tail.select(*new.columns).unionByName(new)
    grid = stage(dense_grid(new), "refresh-grid", by="asset_id", dealt=True)
    grid = grid.withColumn("t", F.col("t") + F.lit(offset))
    made = cleaning.quality_mask(cleaning.clean_prices(grid, windows.rules), windows.quality, windows.hard_events, windows.coverage)
    made = timeseries.add_returns(made.select("asset_id", "date", "t", "price", "dollar_volume", "hard", "quality_ok"))
    made = made.withColumn("momentum", timeseries.momentum(windows.momentum, windows.skip))
    made = moving.add_average_dollar_volume(made, "adv", windows.volume)
    if last is not None:
        made = made.where(F.col("date") > F.lit(last))
    cells = made.select("asset_id", "date", "t", "price", "ret", "hard", "momentum", "adv", "quality_ok")
    end = grid.agg(F.max("t")).first()[0] or 0
    return Refreshed(cells, stage(grid.where(F.col("t") > end - windows.depth), "refresh-tail", by="asset_id", dealt=True))
