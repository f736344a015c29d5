"""Scans and the column lists of the player, match, tournament and listing tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.functions.columns import date_from_text


def _columns(declared: str) -> dict[str, str]:
    return dict(column.split() for column in declared.split(","))


PLAYER_SCHEMA = _columns(
    "player_id string, first_name string, last_name string, flag_code string, "
    "residence string, birthplace string, birthdate string, turned_pro int, "
    "weight_kg int, height_cm int, handedness string, backhand string"
)

MATCH_SCHEMA = _columns(
    "match_id string, tourn_id string, tourn_name string, tourn_place string, "
    "tourn_start_date string, tourn_end_date string, tourn_round string, "
    "tourn_round_order int, winner_id string, loser_id string, winner_seed int, "
    "loser_seed int, match_score string, winner_sets int, loser_sets int, "
    "winner_games int, loser_games int, winner_tiebreaks_won int, "
    "loser_tiebreaks_won int, tourn_currency string, tourn_value string"
)

TOURNAMENT_SCHEMA = _columns(
    "tourn_id int, tourn_name string, tourn_type string, tourn_location string, "
    "tourn_start_year int, winner_id string, tourn_winner string"
)

# Listing numbers arrive as text: cleaning decides what a bad value becomes.
LISTING_SCHEMA = _columns(
    "id string, host_id string, neighbourhood_group string, neighbourhood string, "
    "room_type string, latitude string, longitude string, price string, "
    "minimum_nights string, number_of_reviews string, reviews_per_month string, "
    "calculated_host_listings_count string, availability_365 string"
)


def read_csv_table(spark: SparkSession, path: str, schema: Mapping[str, str]) -> DataFrame:
    """Read a CSV file with a header, taking the columns of ``schema`` by name.

    The header decides the order of the columns and the declared types replace
    inference, so the file is scanned once. Text that does not fit a type is null.
    """
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        *[F.col(name).try_cast(data_type).alias(name) for name, data_type in schema.items()]
    )


def read_parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def player_dim(raw: DataFrame) -> DataFrame:
    """Player table: flag code as nationality, birth date parsed."""
    return raw.select(
        "player_id",
        "first_name",
        "last_name",
        F.col("flag_code").alias("nationality"),
        "residence",
        "birthplace",
        date_from_text("birthdate").alias("date_of_birth"),
        "turned_pro",
        "weight_kg",
        "height_cm",
        "handedness",
        "backhand",
    )


def match_fact(raw: DataFrame) -> DataFrame:
    """Match table: winner columns as ``source_*``, loser columns as ``destination_*``."""
    both_sides = [
        F.col(f"{theirs}_{what}").alias(f"{ours}_{what}")
        for what in ("seed", "sets", "games", "tiebreaks_won")
        for theirs, ours in (("winner", "source"), ("loser", "destination"))
    ]
    return raw.select(
        "match_id",
        "tourn_id",
        "tourn_name",
        "tourn_place",
        date_from_text("tourn_start_date").alias("tourn_start_date"),
        date_from_text("tourn_end_date").alias("tourn_end_date"),
        "tourn_round",
        "tourn_round_order",
        F.col("winner_id").alias("source"),
        F.col("loser_id").alias("destination"),
        *both_sides,
        "match_score",
        "tourn_currency",
        "tourn_value",
    )


def tournament_dim(raw: DataFrame) -> DataFrame:
    return raw.select(
        "tourn_id",
        "tourn_name",
        "tourn_type",
        "tourn_start_year",
        "winner_id",
        "tourn_winner",
    )
