"""Small helpers shared by query definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def out(c: Column, kind: str, name: str) -> Column:
    """Output typing shared with the oracle: BIGINT for counts, DOUBLE rounded to 6."""
    if kind == "int":
        return c.cast("bigint").alias(name)
    return F.round(c.cast("double"), 6).alias(name)
