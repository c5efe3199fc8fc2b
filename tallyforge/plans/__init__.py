"""Queries over the supplied tables."""

import importlib

MODULES = ["training", "joins", "analytics", "science", "pipelines", "more", "forecasts"]


def load_core():
    from tallyforge.plans.registry import CORE

    for name in MODULES:
        importlib.import_module(f"tallyforge.plans.{name}")
    return CORE
