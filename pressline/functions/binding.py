"""Evaluate a value once inside a larger column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Lambdas of higher-order functions repeat what they capture for every element; a value
    that was bound here is only read.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))
