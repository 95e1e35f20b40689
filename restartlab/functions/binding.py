"""Local names inside column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression.

    Needed where a lambda uses an array built by an earlier column: the
    optimizer may inline that column into the lambda and build it per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
