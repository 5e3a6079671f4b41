"""Registered queries, grouped as the operators are."""

import importlib
import pkgutil

from bourse.plans.registry import REGISTRY

for _module in pkgutil.iter_modules(__path__):
    if _module.name.endswith("_queries"):
        importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["REGISTRY"]
