"""Registered queries by subject."""

import importlib

MODULES = (
    "ingest",
    "catalog",
    "profiles",
    "recommend",
    "collaborative",
    "text",
    "evaluation",
    "experiments",
    "metrics",
    "quality",
    "graph",
    "streams",
    "learned",
)


def load_modules() -> None:
    for module in MODULES:
        importlib.import_module(f"tastelake.plans.{module}")
