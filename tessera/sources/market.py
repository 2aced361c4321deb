"""Sources: market rows, statements, companies, and how they come onto one key."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.columns import finite, ratio, require_columns, usable_price
from tessera.operators.grid import calendar, dense_grid

MARKET_SCHEMA = "asset_id long, date date, adj_close double, close double, volume double, ingest_seq long"
STATEMENT_SETS = ("income_ttm", "income_quarterly", "balance_ttm", "balance_quarterly", "cashflow_ttm", "cashflow_quarterly")


@dataclass(frozen=True)
class Source:
    """Where tables are: {folder}/{name}, read in `format` (parquet, csv, orc, json) with `options`."""

    folder: str
    format: str = "parquet"
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.folder.strip():
            raise ValueError("the source's folder is empty")

    def read(self, spark: SparkSession, name: str, schema: str | None = None) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.options)
        return (reader.schema(schema) if schema else reader).load(f"{self.folder.rstrip('/')}/{name}")


def numeric_id(c: str | Column) -> Column:
    """An id as a long; what isn't a whole number becomes NULL. It goes through a decimal, which holds every long exactly."""
    d = (F.col(c) if isinstance(c, str) else c).cast("string").try_cast("decimal(38,18)")
    return F.when(d == F.floor(d), d.try_cast("long"))


def company_ids(companies: DataFrame) -> DataFrame:
    """(asset_id): the distinct usable ids."""
    require_columns(companies, ["asset_id"], "companies")
    return companies.select(numeric_id("asset_id").alias("asset_id")).dropna().distinct()


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in `order`. An aggregate that combines map-side, so a key with many versions doesn't sort in one task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def canonical(df: DataFrame, universe: DataFrame | None = None, dedupe: bool = False, keys: tuple[str, ...] = ("asset_id", "date")) -> DataFrame:
    """Ids as longs (rows without one go), only those of `universe`, and with `dedupe` the last
    row of each key by ingest_seq, which stands for the order that rows came in."""
    require_columns(df, keys, "rows")
    out = df.withColumn("asset_id", numeric_id("asset_id")).where("asset_id is not null")
    if universe is not None:
        out = out.join(universe, "asset_id", "left_semi")
    if dedupe:
        require_columns(df, ["ingest_seq"], "rows")
        out = keep_last(out, list(keys), ["ingest_seq"])
    return out


def market_rows(source: Source, spark: SparkSession, universe: DataFrame | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Market rows of the range (pushed down to the scan) and the universe."""
    rows = source.read(spark, "market", MARKET_SCHEMA)
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return canonical(rows, universe, dedupe=True)


def proxy_returns(source: Source, spark: SparkSession, asset_id: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """(date, mkt): the daily returns of one asset's own usable prices, whether or not the universe has it."""
    rows = market_rows(source, spark, None, start, end).where(F.col("asset_id") == asset_id)
    price = usable_price("adj_close")
    return rows.select("date", (ratio(price, F.lag(price).over(Window.partitionBy("asset_id").orderBy("date"))) - 1).alias("mkt"))


def price_panel(rows: DataFrame) -> DataFrame:
    """The dense grid with price (adjusted close, unusable ones NULL) and dollar_volume
    (close times volume), over the dates that have any price."""
    require_columns(rows, ["adj_close", "close", "volume"], "market rows")
    made = rows.select("asset_id", "date", usable_price("adj_close").alias("price"), finite(F.col("close") * F.col("volume")).alias("dollar_volume"))
    dates = calendar(made.where("price is not null"))
    return dense_grid(made, dates)


def add_business_days(c: str | Column, n: int) -> Column:
    """`n` weekdays on; a weekend counts from the Friday before it."""
    d = F.col(c) if isinstance(c, str) else c
    if n < 0:
        raise ValueError("publish shift must not be negative")
    if n == 0:
        return d
    day = F.weekday(d)  # Monday is 0
    friday = F.when(day >= 5, F.date_sub(d, day - 4)).otherwise(d)
    into = F.least(day, F.lit(4)) + n
    return F.date_add(friday, (n + 2 * F.floor(into / 5)).cast("int"))


def publish_aligned(statements: DataFrame, shift_business_days: int = 1, duplicates: str = "raise") -> DataFrame:
    """Statements by eff_date, the day they can be known: publish_date plus the shift. Rows
    without a publish date go. Two rows of one (asset_id, eff_date): `raise` is an error when the
    plan runs, `keep_last` keeps the last by report date, fiscal year and period, and ingest_seq."""
    if duplicates not in ("raise", "keep_last"):
        raise ValueError(f"duplicates must be raise or keep_last, not {duplicates!r}")
    require_columns(statements, ["asset_id", "report_date", "publish_date"], "statements")
    out = statements.where("publish_date is not null").withColumn("eff_date", add_business_days("publish_date", shift_business_days))
    order = [c for c in ("report_date", "fiscal_year", "fiscal_period", "ingest_seq") if c in out.columns]
    drop = ["publish_date", "report_date", "ticker"]
    if duplicates == "keep_last":
        return keep_last(out, ["asset_id", "eff_date"], order).drop(*drop)
    n = F.count(F.lit(1)).over(Window.partitionBy("asset_id", "eff_date"))
    message = F.concat(F.lit("duplicate statements of asset "), F.col("asset_id").cast("string"), F.lit(" at "), F.col("eff_date").cast("string"))
    checked = out.withColumn("__n", n).withColumn("eff_date", F.when(F.col("__n") == 1, F.col("eff_date")).otherwise(F.raise_error(message).cast("date")))
    return checked.drop("__n", *drop)


def statements(source: Source, spark: SparkSession, universe: DataFrame | None = None, shift_business_days: int = 1, duplicates: str = "keep_last") -> dict[str, DataFrame]:
    """The six statement sets by name, aligned; each is read only if it is used."""
    if shift_business_days < 0:
        raise ValueError("publish shift must not be negative")
    read = lambda name: canonical(source.read(spark, name), universe, keys=("asset_id", "report_date"))
    return {name: publish_aligned(read(name), shift_business_days, duplicates) for name in STATEMENT_SETS}


def sector_map(ids: DataFrame, companies: DataFrame, industries: DataFrame | None = None) -> DataFrame:
    """(asset_id, sector) for each of `ids` (rows without a whole number as id are an error): the company's sector, or its
    industry's; blank is missing, the first by name counts, and what is missing is 'Unknown'. If all are missing the plan raises an error."""
    wanted = ids.select(
        F.coalesce(numeric_id("asset_id"), F.raise_error(F.concat(F.lit("not an id: "), F.coalesce(F.col("asset_id").cast("string"), F.lit("NULL")))).cast("long")).alias("asset_id")
    ).distinct()
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    if "sector" in companies.columns:
        named = companies.select(numeric_id("asset_id").alias("asset_id"), blank(F.col("sector")).alias("sector"))
    else:
        if industries is None:
            raise ValueError("companies have no sector; industries are needed")
        require_columns(companies, ["industry_id"], "companies")
        named = companies.join(F.broadcast(industries), "industry_id", "left").select(numeric_id("asset_id").alias("asset_id"), blank(F.col("sector")).alias("sector"))
    best = named.groupBy("asset_id").agg(F.min("sector").alias("sector"))
    out = wanted.join(best, "asset_id", "left")
    known = out.agg(F.count("sector").alias("known"))
    checked = out.crossJoin(F.broadcast(known))
    sector = F.when(F.col("known") > 0, F.coalesce("sector", F.lit("Unknown"))).otherwise(F.raise_error(F.lit("no asset has a sector")).cast("string"))
    return checked.select("asset_id", sector.alias("sector"))


def as_of_sets(left: DataFrame, sets: dict[str, tuple[DataFrame, list[str]]], left_date: str = "date", right_date: str = "eff_date") -> DataFrame:
    """`left` with a struct for each of `sets` (a table and its columns that are wanted): its latest row of the same asset at the
    left row's date or before, NULL before the first. Rows are carried whole, so a NULL in one stays NULL. Spark has no as-of join: all
    tables are put into one, in which one window carries rows on, at the cost of one exchange and one sort by asset for all sets together."""
    shape = {name: F.struct(*values) for name, (_, values) in sets.items()}
    rows = left.select("asset_id", F.col(left_date).alias("__at"), F.struct(*left.columns).alias("__left"), F.lit(1).alias("__side"))
    for name, (right, _) in sets.items():
        rows = rows.unionByName(right.select("asset_id", F.col(right_date).alias("__at"), shape[name].alias(name), F.lit(0).alias("__side")), allowMissingColumns=True)
    w = Window.partitionBy("asset_id").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.select("__left", "__side", *[F.last(name, ignorenulls=True).over(w).alias(name) for name in sets])
    return carried.where("__side = 1").select("__left.*", *sets)


def as_of(left: DataFrame, right: DataFrame, values: list[str], left_date: str = "date", right_date: str = "eff_date") -> DataFrame:
    """as_of_sets() with one table, whose columns `values` come beside the left ones."""
    return as_of_sets(left, {"__row": (right, values)}, left_date, right_date).select(*left.columns, "__row.*")
