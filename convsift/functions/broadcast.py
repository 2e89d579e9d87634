"""Broadcast hints only behind a proven size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows a side may have (by construction, e.g. after ``limit(n)``) and still be
# broadcast.  Each such row is a handful of ids and numbers, so 200k rows stay
# far below the default 8 GB broadcast ceiling and a few tens of MB in practice.
MAX_BROADCAST_ROWS = 200_000


def broadcast_if_bounded(df: DataFrame, row_bound: int | None) -> DataFrame:
    """Hint ``broadcast`` when the caller can prove ``df`` has at most
    ``row_bound`` rows and that bound is small; otherwise leave the choice to
    AQE, which still broadcasts at run time if the real size is small."""
    if row_bound is not None and 0 <= row_bound <= MAX_BROADCAST_ROWS:
        return F.broadcast(df)
    return df
