"""Helpers for array columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(arr) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def let(value, body) -> Column:
    """``body`` applied to ``value`` computed once: inside a lambda a name is not re-evaluated."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
