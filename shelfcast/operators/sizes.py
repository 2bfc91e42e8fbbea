"""Broadcast by hint only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.config import BROADCAST_MAX_ROWS


def is_small(max_rows: int) -> bool:
    return max_rows <= BROADCAST_MAX_ROWS


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``max_rows`` is a count or a parameter that bounds ``df``; a larger one is left to the planner."""
    return F.broadcast(df) if is_small(max_rows) else df
