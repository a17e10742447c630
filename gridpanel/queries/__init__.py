"""Registered queries over the driver tables, one module per part of the inventory."""

import importlib

MODULES = ("relational", "spatial", "allocation", "design", "scoring", "draws", "metrics", "estimators")


def load_all() -> dict:
    from gridpanel.queries.base import REGISTRY

    for name in MODULES:
        importlib.import_module(f"gridpanel.queries.{name}")
    return REGISTRY
