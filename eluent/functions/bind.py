"""A value bound inside of a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once: an expression that a lambda refers to would be evaluated anew for every element."""
    return F.get(F.transform(F.array(value), body), 0)
