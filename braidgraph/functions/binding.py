"""Naming an intermediate value inside a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row.

    A Column that is used several times is written out at every use; projections that
    name it are merged again by the optimizer. A lambda's variable stays bound.
    """
    return F.transform(F.array(value), body).getItem(0)
