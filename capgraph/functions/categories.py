"""Column expressions for the reference's labels and thresholds.

Thresholds are parameters with the reference's values as defaults.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Graph size classes (nodes), density classes, runtime bands
# (seconds), correlation-strength cut-offs.
SIZE_LIMITS = (5000, 20000)            # small < 5000 <= medium < 20000 <= large
DENSITY_LIMITS = (0.001, 0.01)         # sparse < .001 <= medium < .01 <= dense
RUNTIME_BANDS = (10.0, 30.0, 60.0)     # fast < 10 <= medium < 30 <= slow < 60 <= very_slow
CORRELATION_STRENGTH = (0.7, 0.5, 0.3)  # Strong, Moderate, Weak, else Very Weak


def size_category(nodes: Column, limits=SIZE_LIMITS) -> Column:
    return (F.when(nodes < limits[0], F.lit("small"))
            .when(nodes < limits[1], F.lit("medium")).otherwise(F.lit("large")))


def density_category(density: Column, limits=DENSITY_LIMITS) -> Column:
    return (F.when(density < limits[0], F.lit("sparse"))
            .when(density < limits[1], F.lit("medium")).otherwise(F.lit("dense")))


def runtime_category(t: Column, bands=RUNTIME_BANDS) -> Column:
    return (F.when(t < bands[0], F.lit("fast")).when(t < bands[1], F.lit("medium"))
            .when(t < bands[2], F.lit("slow")).otherwise(F.lit("very_slow")))


def correlation_strength(r: Column, cuts=CORRELATION_STRENGTH) -> Column:
    return (F.when(r >= cuts[0], F.lit("Strong")).when(r >= cuts[1], F.lit("Moderate"))
            .when(r >= cuts[2], F.lit("Weak")).otherwise(F.lit("Very Weak")))


def canonical_name(name: str) -> str:
    """One spelling for algorithm names: lower case, no separators
    (``ConnectedComponents`` and ``connected_components`` agree)."""
    return re.sub(r"[^a-z0-9]", "", name.lower())
