"""Named queries (Spark) and their DuckDB oracle SQL."""

from __future__ import annotations


def load_all():
    """Import every query module so that its queries register."""
    from runlens.plans import q_runs  # noqa: F401
    for mod in ("q_prep", "q_vectors", "q_io", "q_stats", "q_models", "q_stream"):
        try:
            __import__(f"runlens.plans.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"runlens.plans.{mod}":
                raise
    from runlens.plans.registry import ORACLE, QUERIES
    return QUERIES, ORACLE
