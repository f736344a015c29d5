"""Table profiles, each in a single pass over the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from matchbook.functions.columns import is_missing, number_from_text


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")
    )


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def describe(df: DataFrame) -> DataFrame:
    """Count, mean, deviation, least and greatest value of numeric and text columns.

    One row per column. Bounds of numeric columns are numbers, bounds of text
    columns are text; text that reads as a number enters the mean.
    """
    rows = []
    for field in df.schema.fields:
        c = F.col(field.name)
        numeric = isinstance(field.dataType, NumericType)
        if not numeric and not isinstance(field.dataType, StringType):
            continue
        number = c.cast("double") if numeric else number_from_text(c)
        rows.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.count(c).alias("n"),
                F.avg(number).alias("mean"),
                F.stddev(number).alias("stddev"),
                _if(numeric, F.min(number), "double").alias("min_number"),
                _if(numeric, F.max(number), "double").alias("max_number"),
                _if(not numeric, F.min(c), "string").alias("min_text"),
                _if(not numeric, F.max(c), "string").alias("max_text"),
            )
        )
    return _rows(df, rows)


def missing_census(df: DataFrame) -> DataFrame:
    """Type and number of null or empty values of every column."""
    return _rows(
        df,
        [
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(data_type).alias("data_type"),
                F.count_if(is_missing(name)).alias("n_missing"),
            )
            for name, data_type in df.dtypes
        ],
    )


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def number_summary(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.avg(value).alias("mean_value"),
        F.stddev(value).alias("stddev_value"),
    )


def _if(wanted: bool, c: Column, data_type: str) -> Column:
    return c if wanted else F.lit(None).cast(data_type)


def _rows(df: DataFrame, structs: list[Column]) -> DataFrame:
    """One row per aggregate struct, out of one aggregate over ``df``."""
    return df.agg(F.array(*structs).alias("profile")).select(F.inline("profile"))
