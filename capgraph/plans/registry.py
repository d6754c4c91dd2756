"""Registry of named queries: each is ``(spark, sf_dir) -> DataFrame`` with an
optional DuckDB oracle SQL string over the raw parquet views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = stable_sql_rounding(sql)
        return fn
    return deco


# Output rounding that both engines agree on.  Sums in different orders can
# differ in the last bit, and the two engines break exact decimal ties
# differently, so a double is first snapped to 10 decimals and then rounded
# half-up to the wanted digits in decimal arithmetic.
SNAP = "decimal(38,10)"


def round_stable(c: Column, digits: int = 6) -> Column:
    snapped = F.round(c.try_cast(SNAP), digits).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) > F.lit(1e20)), c).otherwise(snapped)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (see ``round_stable``)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_stable(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(cols)


def stable_sql_rounding(sql: str) -> str:
    """Rewrite every ``round(expr, d)`` of an oracle into the same
    snap-then-round-half-up form as ``round_stable``."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 0, j + 6, -1
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                comma = k
            k += 1
        inner = stable_sql_rounding(sql[j + 6:comma])
        digits = sql[comma + 1:k].strip()
        out.append(sql[i:j])
        out.append(f"CAST(round(TRY_CAST(({inner}) AS DECIMAL(38,10)), {digits}) AS DOUBLE)")
        i = k + 1
