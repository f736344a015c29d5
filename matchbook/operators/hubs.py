"""Joins on keys that a few hub keys dominate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A hub holds more than this share of the rows, so there are at most
# 1 / HUB_SHARE hubs and their rows of a one-row-per-key table can be broadcast.
HUB_SHARE = 0.001
# Keys with no more rows than this fit any task and are never hubs.
HUB_FLOOR = 1_000_000


def hub_threshold(rows: int, share: float = HUB_SHARE, floor: int = HUB_FLOOR) -> float:
    return max(rows * share, floor)


def hub_join(fact: DataFrame, lookup: DataFrame, on: list[str], is_hub: Column) -> DataFrame:
    """Inner join of ``fact`` to a one-row-per-key ``lookup``.

    Rows of hub keys meet a broadcast of the few hub rows and are never shuffled;
    the other keys are shuffled, and none of them is large.
    """
    hubs = lookup.filter(is_hub)
    hot = fact.join(F.broadcast(hubs), on)
    cold = fact.join(F.broadcast(hubs.select(*on)), on, "left_anti").join(
        lookup.filter(~is_hub), on
    )
    return hot.unionByName(cold)
