"""Registered queries: every operator bound to the given tables, with its SQL."""

from __future__ import annotations

import importlib

MODULES = ["preparation", "descriptives", "tests_of_hypotheses", "charts", "models", "quality", "series_and_vectors", "experiments_and_process"]


def catalog() -> dict:
    out: dict = {}
    for name in MODULES:
        found = importlib.import_module(f"{__name__}.{name}").QUERIES
        repeated = out.keys() & found.keys()
        if repeated:
            raise ValueError(f"registered twice: {sorted(repeated)}")
        out.update(found)
    return out
