"""All registered queries.  Importing the query modules fills the registry."""

from __future__ import annotations

from . import graph_queries, ml_queries, policy_queries, run_queries  # noqa: F401
from .registry import ORACLE, QUERIES


def _with_checkpoint(fn):
    def run(spark, sf_dir):
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries():
    return {k: _with_checkpoint(v) for k, v in QUERIES.items()}


def oracle_sql():
    return dict(ORACLE)
