"""All named queries."""

from __future__ import annotations

import importlib

from wearline.plans.catalog import ORACLES, QUERIES

for _module in ("features", "datasets", "fleet", "stats", "models", "streams"):
    importlib.import_module(f"wearline.plans.queries_{_module}")

__all__ = ["ORACLES", "QUERIES"]
