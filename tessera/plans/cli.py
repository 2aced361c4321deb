"""python -m tessera.plans.cli FOLDER [--format parquet]: run with the defaults and print the summary."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tessera.functions.stages import release_stages
from tessera.operators.qc import display_tables
from tessera.plans.pipeline import run, summary
from tessera.plans.settings import Settings
from tessera.sources.market import Source


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("--format", default="parquet")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    result = run(spark, Source(given.folder, given.format), Settings())
    for name, value in summary(result).items():
        print(f"{name}: {value}")
    core = result.core
    raw, tradable = (core.price_qc.where(f"scope = '{scope}'") for scope in ("raw_daily", "tradable_daily"))
    for name, view in display_tables(raw, tradable, core.clean.summary, core.removed).items():
        print(name)
        view.show(truncate=False)
    core.factor_qc.show(truncate=False)
    release_stages(spark)


if __name__ == "__main__":
    main()
