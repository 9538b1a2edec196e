"""Registry of named queries (Spark) and their DuckDB oracle SQL."""

from __future__ import annotations

from . import (collect_plans, context_plans, evaluate_plans, generate_plans, harvest_plans, intent_plans, io_plans, misc_plans,
               source_plans, stream_plans)

_MODULES = [harvest_plans, generate_plans, context_plans, collect_plans, evaluate_plans, stream_plans, io_plans,
            misc_plans, source_plans, intent_plans]


def _with_checkpoint_dir(fn):
    """Queries that cut lineage need the session's checkpoint dir: use the
    cluster's ``spark.checkpoint.dir``; set a private one only when unset."""
    def run(spark, sf_dir):
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def all_queries() -> dict:
    out = {}
    for m in _MODULES:
        out.update({k: _with_checkpoint_dir(v) for k, v in m.QUERIES.items()})
    return out


def all_oracles() -> dict:
    out = {}
    for m in _MODULES:
        out.update(m.ORACLE)
    return out
