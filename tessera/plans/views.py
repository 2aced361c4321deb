"""The stages of a run as temporary views, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.plans.pipeline import Core, Run


def catalogue(result: Run | Core) -> dict[str, DataFrame]:
    """The tables of a run (or of its core, before evaluation) by name. All are lazy: a view that is never asked costs nothing."""
    core = result.core if isinstance(result, Run) else result
    tables = {
        "clean_prices": core.clean.prices, "raw_prices": core.clean.raw, "cleaning_summary": core.clean.summary, "scored": core.unmasked, "tradable": core.panel,
        "universe_diagnostics": core.diagnostics, "price_qc": core.price_qc, "removed_prices": core.removed, "factor_qc": core.factor_qc,
    }
    if isinstance(result, Run):
        tables |= {
            "ic": result.ic, "ic_stats": result.ic_stats, "ic_diagnostics": result.ic_diagnostics, "curve": result.curve, "costs": result.costs, "performance": result.performance,
        }
    return tables


def register(result: Run | Core, prefix: str = "run") -> list[str]:
    """Make a temporary view `prefix`_name of each table of the catalogue; the names. spark.sql() reads them like any table,
    together with the user's own; views of an earlier run with the same prefix are replaced."""
    if not prefix.isidentifier():
        raise ValueError(f"{prefix!r} can't begin the name of a view")
    names = []
    for name, table in catalogue(result).items():
        table.createOrReplaceTempView(f"{prefix}_{name}")
        names.append(f"{prefix}_{name}")
    return names
