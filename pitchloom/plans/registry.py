"""All registered queries, gathered from the plan modules."""

from __future__ import annotations

import importlib

MODULES = ("stream_plans", "graph_plans", "threat_plans", "season_plans", "score_plans", "store_plans")

QUERIES: dict = {}
ORACLES: dict = {}

for _name in MODULES:
    _module = importlib.import_module(f"pitchloom.plans.{_name}")
    _both = set(QUERIES) & set(_module.BOOK.queries)
    if _both:
        raise ValueError(f"query names registered twice: {sorted(_both)}")
    QUERIES.update(_module.BOOK.queries)
    ORACLES.update(_module.BOOK.oracles)
