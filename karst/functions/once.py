"""A value that is computed once a row and used in many places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use) -> Column:
    """use(value); put into several lambdas as it stands, the value would be computed anew in each, for each of their elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
