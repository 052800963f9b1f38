"""Registered queries: operators applied to the given tables, each with its SQL twin."""

from tideline.plans.registry import ORACLES, QUERIES


MODULES = ("text", "corpus", "score", "evaluate", "dialog", "mt", "cost", "content", "io", "stream", "neardup")


def load() -> tuple[dict, dict]:
    import importlib

    for name in MODULES:
        importlib.import_module(f"tideline.plans.{name}")

    return QUERIES, ORACLES
