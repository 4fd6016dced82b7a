"""Binding an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    Catalyst copies an expression into every place that refers to it when it
    moves a filter below a projection; a lambda variable cannot be copied apart.
    The body also stays out of the generated method, which the JVM stops
    compiling beyond 8,000 bytes.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
