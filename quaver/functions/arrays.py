"""Helpers for expressions on arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where use names it inside another lambda."""
    return F.get(F.transform(F.array(value), use), 0)
