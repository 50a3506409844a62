"""Registered queries, one module per group of the inventory."""

import importlib

from .registry import ORACLES, QUERIES

for _module in (
    "sources", "filters", "features", "anomalies", "clusters", "models", "folds", "ensembles",
    "scores", "explanations", "experiments", "monitoring", "versions", "rules", "profiles",
    "dashboards", "joins", "sets", "ordering", "frames", "scalar_functions", "streams", "callbacks",
):
    try:
        importlib.import_module(f"{__name__}.{_module}")
    except ModuleNotFoundError as error:
        if error.name != f"{__name__}.{_module}":
            raise

__all__ = ["ORACLES", "QUERIES"]
