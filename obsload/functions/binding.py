"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it.

    A filter pushed below a projection copies the projected expression to each place it is used, and
    branches of a condition are not shared by the code generator; binding keeps plan and work linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
