"""Registered queries: each pairs a Spark job with the SQL that checks it."""

from importlib import import_module

MODULES = ("grids", "traces", "resampling", "catalogue", "audits", "models", "contracts")


def load_all() -> None:
    for name in MODULES:
        import_module(f"beamspark.plans.{name}")
