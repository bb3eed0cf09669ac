"""Registered queries: every operator bound to the shared tables."""

from importlib import import_module

FAMILIES = (
    "assets", "jobs", "specs", "evaluation", "ranking", "tuning", "masks", "text", "streams", "learning", "io",

)

QUERIES: dict = {}
ORACLES: dict = {}
for _family in FAMILIES:
    _module = import_module(f"darkroom.plans.{_family}")
    QUERIES.update(_module.plans.queries)
    ORACLES.update(_module.plans.oracles)
