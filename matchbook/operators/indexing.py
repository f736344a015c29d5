"""Indexes of text categories, most frequent first, without a list of labels in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.operators.ranking import rank_rows
from matchbook.runtime import cut


def label_indexes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, label, n, label_index`` of every label: 0 is the most frequent one.

    Equal counts go by the label. All columns are counted in one pass and ranked in one
    sort, by range partitions; null is no label.
    """
    named = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("label")) for c in columns]
    counted = (
        df.select(F.explode(F.array(*named)).alias("value"))
        .select("value.column_name", "value.label")
        .filter(F.col("label").isNotNull())
        .groupBy("column_name", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = [F.asc("column_name"), F.desc("n"), F.asc("label")]
    ranked, _ = cut(rank_rows(counted, order))
    # A row for each column.
    first = ranked.groupBy("column_name").agg(F.min("rank").alias("first"))
    return ranked.join(F.broadcast(first), "column_name").select(
        "column_name", "label", "n", (F.col("rank") - F.col("first")).alias("label_index")
    )


def with_indexes(df: DataFrame, indexes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``<column>_index`` for each column, looked up by join.

    A label that the index doesn't know, and null, get the number of known labels. The join
    is left to the optimizer: broadcast if the labels of a column are few by their size,
    else shuffled, where adaptive execution splits a hot label.
    """
    out = df
    for c in columns:
        labels = indexes.filter(F.col("column_name") == c)
        known = labels.agg(F.count(F.lit(1)).alias("_known"))
        labels = labels.select(F.col("label").alias(c), F.col("label_index").alias(f"{c}_index"))
        # One row against all others.
        out = out.join(labels, c, "left").join(F.broadcast(known))
        index = F.coalesce(f"{c}_index", "_known")
        out = out.withColumn(f"{c}_index", index.cast("int")).drop("_known")
    return out.select(*df.columns, *[f"{c}_index" for c in columns])
