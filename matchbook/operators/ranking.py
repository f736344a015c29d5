"""Top-k with a total order, and ranks of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.runtime import cut


def top_ranked(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows with a 1-based rank.

    The limit comes first, so each task keeps ``k`` rows and the window that
    numbers them sees ``k`` rows in all.
    """
    best = df.orderBy(*order).limit(k)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def best_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of each group; tasks cut every group to ``k`` before the shuffle."""
    numbered = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(rank, numbered).filter(F.col(rank) <= k)


# Row numbers of ``monotonically_increasing_id`` hold the partition above these bits.
_ROW_BITS = 33


def rank_rows(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Every row with its 1-based rank as a long; ``order`` must be total.

    Rows are sorted by range partitions. A row's rank is its number within its partition
    plus the rows of the partitions before: one count for each partition comes to the
    driver and goes back as a small table, so no task sees more than its own rows. The
    checkpoint fixes both, so that a lost task can't sort anew. An empty table stays empty.
    """
    place = "_place"
    placed, _ = cut(df.orderBy(*order).withColumn(place, F.monotonically_increasing_id()))
    part = F.shiftright(place, _ROW_BITS)
    # One row for each partition that isn't empty.
    counted = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, offsets = 0, []
    for row in sorted(counted, key=lambda row: row["part"]):
        offsets.append((row["part"], before))
        before += row["n"]
    known = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    number = F.col(place) - F.shiftleft(part, _ROW_BITS) + F.col("_before") + 1
    return placed.join(F.broadcast(known), part == F.col("_part")).select(
        *df.columns, number.alias(rank)
    )
