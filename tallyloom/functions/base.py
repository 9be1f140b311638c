"""What other expressions are built with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)
