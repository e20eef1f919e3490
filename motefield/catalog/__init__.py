"""Named queries over the benchmark tables."""

from importlib import import_module

MODULES = ["unit_queries", "window_queries", "result_queries", "log_queries", "model_queries"]


def load():
    from motefield.catalog.registry import ORACLES, QUERIES

    for name in MODULES:
        import_module(f"motefield.catalog.{name}")
    return QUERIES, ORACLES
