"""All catalogue modules merged into one mapping."""

from __future__ import annotations

import importlib
import pkgutil

import rankspark.plans as plans

QUERIES, ORACLES = {}, {}

for _info in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
    if _info.name.startswith("catalog_"):
        _module = importlib.import_module(f"rankspark.plans.{_info.name}")
        for _name, _fn in _module.QUERIES.items():
            if _name in QUERIES:
                raise ValueError(f"duplicate query {_name}")
            QUERIES[_name] = _fn
        ORACLES.update(_module.ORACLES)
