"""What columns of other modules are made with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once: an expression that stands within a lambda is worked out anew for each element, and one that a lambda's function takes is for each time it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
