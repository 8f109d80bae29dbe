"""Values that are computed once a row, however often an expression uses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row; an expression that holds the value itself several times would compute it as often."""
    return F.transform(F.array(value), body)[0]
