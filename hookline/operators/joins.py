"""Join helpers: broadcast only behind a measured size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_bounded(big: DataFrame, small: DataFrame, on, how: str = "inner",
                 max_rows: int = 100_000) -> DataFrame:
    """Join ``big`` with ``small``, broadcasting ``small`` only if it is proven small.

    The row count of ``small`` is measured first (a cheap job: ``small`` is
    expected to be a filtered or aggregated side). At or below ``max_rows`` it is
    broadcast; above, the join is left to the planner (sort-merge on the key,
    with AQE free to re-plan), so a side that grows with the data never ends up
    in every executor's memory.
    """
    n = small.limit(max_rows + 1).count()      # stops once the bound is exceeded
    side = F.broadcast(small) if n <= max_rows else small
    return big.join(side, on, how)
