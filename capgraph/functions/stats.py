"""Statistical column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation over rows where both inputs are present, null (not
    an error) when either side is constant or there is a single row:
    ``covar_pop / (sd_pop(a) * sd_pop(b))`` with a null-on-zero division."""
    x = F.when(F.col(b).isNotNull(), F.col(a))
    y = F.when(F.col(a).isNotNull(), F.col(b))
    den = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(den > 0, F.covar_pop(x, y) / den)


def sql_corr(a: str, b: str) -> str:
    """The same expression as DuckDB SQL (for oracles)."""
    x = f"(CASE WHEN {b} IS NOT NULL THEN {a} END)"
    y = f"(CASE WHEN {a} IS NOT NULL THEN {b} END)"
    den = f"(stddev_pop({x}) * stddev_pop({y}))"
    return f"(CASE WHEN {den} > 0 THEN covar_pop({x}, {y}) / {den} END)"
