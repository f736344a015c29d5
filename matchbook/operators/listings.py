"""Cleaning, features and splits of listing records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.functions.columns import (
    amount_from_text,
    composite_key,
    default_when_null,
    has_text,
    key_bucket,
    positive_flag,
    ratio_or_zero,
    within,
)

PRICE_RANGE = (10.0, 1000.0)


def clean_prices(
    df: DataFrame, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Price text as a number, the last column; rows without one, or out of the range, are dropped.

    The text is parsed once a row: exploding the list of no or one price both drops the
    row and hands the number on, where a filter and a projection would each parse it.
    """
    price = F.array(amount_from_text("price"))
    if low is None:
        kept = F.filter(price, lambda p: p.isNotNull())
    else:
        kept = F.filter(price, lambda p: within(p, low, high))
    return df.select(*[c for c in df.columns if c != "price"], F.explode(kept).alias("price"))


def prepare_listings(
    raw: DataFrame, low: float = PRICE_RANGE[0], high: float = PRICE_RANGE[1]
) -> DataFrame:
    """Listings ready for the price model: ``label`` is the log of the price.

    A null number takes its default before the cast, so text that is no number
    stays null and is left to the imputer. One narrow projection: nothing shuffles.
    """
    named = raw.filter(has_text("neighbourhood") & has_text("room_type"))
    kept = clean_prices(named, low, high)
    numbers = kept.select(
        composite_key("host_id", "id").alias("id"),
        "neighbourhood",
        "room_type",
        F.ln("price").alias("label"),
        default_when_null("latitude", "double", 0.0).alias("latitude"),
        default_when_null("longitude", "double", 0.0).alias("longitude"),
        F.col("minimum_nights").try_cast("double").alias("minimum_nights"),
        default_when_null("number_of_reviews", "int", 0).alias("number_of_reviews"),
        default_when_null("reviews_per_month", "double", 0.0).alias("reviews_per_month"),
        default_when_null("calculated_host_listings_count", "double", 1).alias(
            "calculated_host_listings_count"
        ),
        default_when_null("availability_365", "double", 0).alias("availability_365"),
    )
    return numbers.select(
        "*",
        ratio_or_zero("number_of_reviews", "availability_365").alias("reviews_per_availability"),
        positive_flag("number_of_reviews").alias("has_reviews"),
        F.log1p("minimum_nights").alias("log_minimum_nights"),
        F.log1p("availability_365").alias("log_availability"),
    )


def in_training_share(key: str = "id", percent: int = 80) -> Column:
    return key_bucket(key) < percent


def split(df: DataFrame, key: str = "id", percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, chosen by a hash of the key."""
    training = in_training_share(key, percent)
    return df.filter(training), df.filter(~training)


def fold_number(key: str = "id", folds: int = 5) -> Column:
    """Fold of a row; taken from other hash digits than the split, so independent of it."""
    return key_bucket(key, folds, offset=9)
