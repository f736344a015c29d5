"""The star schema seen as players, matches, tournaments and listings.

A line item is a match between the customer who ordered and the supplier who
delivered: the supplier wins unless the line was returned. An order is a
tournament, played on the day it was placed. A line item with its part is a
listing. Null, blank and malformed values are made from real columns, so that
the cleaning rules have something to clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.operators.graph import PropertyGraph
from matchbook.operators.listings import prepare_listings
from matchbook.plans.season import season_graph
from matchbook.sources import match_fact, player_dim, read_parquet_table, tournament_dim

FIRST_YEAR, LAST_YEAR = 1996, 2000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet_table(spark, folder, name)


def _returned(supplier_side: Column, customer_side: Column, winner: bool) -> Column:
    customer_wins = F.col("l_returnflag") == "R"
    first, second = (customer_side, supplier_side) if winner else (supplier_side, customer_side)
    return F.when(customer_wins, first).otherwise(second)


def _line_key() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def _text(c: Column, data_type: str = "int") -> Column:
    return c.cast(data_type).cast("string")


def _lines_with(spark: SparkSession, folder: str, orders: DataFrame) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


def tour_graph(
    spark: SparkSession, folder: str, which: Column | None = None
) -> PropertyGraph:
    """Players with numeric ids: customers from 0 upwards, suppliers from -1 downwards.

    ``which`` is a condition on the stored columns; it reaches the scan.
    """
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("n_nationkey"),
    )
    suppliers = table(spark, folder, "supplier").select(
        _supplier_id("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("n_nationkey"),
    )
    vertices = (
        customers.unionByName(suppliers)
        .join(nation, "n_nationkey", "left")
        .select("id", "name", "country")
    )
    match_type = (
        F.when(F.col("l_quantity") >= 50, "F")
        .when(F.col("l_quantity") >= 46, "S")
        .when(F.col("l_linestatus") == "O", "G1")
        .otherwise("G2")
    )
    points = F.when(match_type == "F", 11).when(match_type == "S", 5).otherwise(1)
    ends = _supplier_id("l_suppkey"), F.col("o_custkey")
    played = _lines_with(spark, folder, table(spark, folder, "orders"))
    if which is not None:
        played = played.filter(which)
    edges = played.select(
        _line_key().alias("match_id"),
        _returned(*ends, winner=True).alias("src"),
        _returned(*ends, winner=False).alias("dst"),
        match_type.alias("match_type"),
        points.alias("points"),
        F.lit(1).alias("head2head"),
    )
    return PropertyGraph(vertices, edges)


def _supplier_id(name: str) -> Column:
    return -F.col(name) - 1


def raw_players(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    customers = table(spark, folder, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("player_id"),
        F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("first_name"),
        F.col("c_name").alias("last_name"),
        F.col("c_nationkey").alias("n_nationkey"),
        F.col("c_mktsegment").alias("residence"),
        F.col("c_custkey").alias("number"),
        F.col("c_acctbal").alias("balance"),
    )
    suppliers = table(spark, folder, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("player_id"),
        F.lit("Supplier").alias("first_name"),
        F.col("s_name").alias("last_name"),
        F.col("s_nationkey").alias("n_nationkey"),
        F.lit(None).cast("string").alias("residence"),
        F.col("s_suppkey").alias("number"),
        F.col("s_acctbal").alias("balance"),
    )
    born = F.date_add(F.lit("1960-01-01").cast("date"), (F.col("number") % 15000).cast("int"))
    in_debt = F.col("balance") < 0
    return (
        customers.unionByName(suppliers)
        .join(nation, "n_nationkey", "left")
        .select(
            "player_id",
            "first_name",
            "last_name",
            F.col("n_name").alias("flag_code"),
            "residence",
            F.col("n_name").alias("birthplace"),
            F.when(in_debt, "unknown")
            .otherwise(F.date_format(born, "yyyy.MM.dd"))
            .alias("birthdate"),
            (F.col("n_nationkey") + 1980).alias("turned_pro"),
            F.floor(F.abs("balance") / 100).cast("int").alias("weight_kg"),
            (F.col("n_nationkey") + 150).alias("height_cm"),
            F.when(in_debt, "Left-Handed").otherwise("Right-Handed").alias("handedness"),
            F.when(in_debt, None).otherwise("Two-Handed Backhand").alias("backhand"),
        )
    )


def _tournament_name() -> Column:
    """Priority and calendar day, the same every year: ``URGENT 03-17``."""
    return F.concat_ws(
        " ", F.expr("substring(o_orderpriority, 3)"), F.date_format("o_orderdate", "MM-dd")
    )


def raw_matches(spark: SparkSession, folder: str) -> DataFrame:
    # What an order alone decides is worked out once per order, ahead of the join.
    undated = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    events = table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        _tournament_name().alias("tourn_name"),
        F.col("o_orderpriority").alias("tourn_place"),
        F.when(undated, F.date_format("o_orderdate", "yyyy/MM/dd"))
        .otherwise(F.date_format("o_orderdate", "yyyy.MM.dd"))
        .alias("tourn_start_date"),
        F.concat(F.lit("$"), F.floor("o_totalprice").cast("bigint")).alias("tourn_value"),
    )
    quantity = F.col("l_quantity").cast("int")
    ends = F.concat(F.lit("S"), "l_suppkey"), F.concat(F.lit("C"), "o_custkey")
    return _lines_with(spark, folder, events).select(
        _line_key().alias("match_id"),
        F.col("o_orderkey").alias("tourn_id"),
        "tourn_name",
        "tourn_place",
        "tourn_start_date",
        F.date_format("l_shipdate", "yyyy.MM.dd").alias("tourn_end_date"),
        F.when(F.col("l_quantity") >= 50, "Finals")
        .when(F.col("l_quantity") >= 46, "Semi-Finals")
        .otherwise(F.concat(F.lit("Round Robin Day "), "l_linenumber"))
        .alias("tourn_round"),
        F.col("l_linenumber").alias("tourn_round_order"),
        _returned(*ends, winner=True).alias("winner_id"),
        _returned(*ends, winner=False).alias("loser_id"),
        quantity.alias("winner_seed"),
        F.nullif("l_linenumber", F.lit(7)).alias("loser_seed"),
        F.concat_ws("-", quantity, "l_linenumber").alias("match_score"),
        F.when(quantity > 25, 3).otherwise(2).alias("winner_sets"),
        (F.col("l_linenumber") % 2).alias("loser_sets"),
        quantity.alias("winner_games"),
        F.col("l_linenumber").alias("loser_games"),
        F.round(F.col("l_discount") * 100).cast("int").alias("winner_tiebreaks_won"),
        F.round(F.col("l_tax") * 100).cast("int").alias("loser_tiebreaks_won"),
        F.lit("$").alias("tourn_currency"),
        "tourn_value",
    )


def raw_tournaments(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    undecided = F.col("o_orderstatus") == "P"
    category = (
        F.when(F.col("o_totalprice") >= 490000, "Grand Slam")
        .when(F.col("o_totalprice") >= 475000, "Masters 1000")
        .when(F.col("o_totalprice") >= 450000, "ATP 500")
        .otherwise("ATP 250")
    )
    return (
        table(spark, folder, "orders")
        .join(names, "o_custkey", "left")
        .select(
            F.col("o_orderkey").alias("tourn_id"),
            _tournament_name().alias("tourn_name"),
            category.alias("tourn_type"),
            F.lower("o_orderpriority").alias("tourn_location"),
            F.year("o_orderdate").alias("tourn_start_year"),
            F.when(undecided, None).otherwise(F.concat(F.lit("C"), "o_custkey")).alias("winner_id"),
            F.when(undecided, None).otherwise(F.col("c_name")).alias("tourn_winner"),
        )
    )


def players(spark: SparkSession, folder: str) -> DataFrame:
    return player_dim(raw_players(spark, folder))


def matches(spark: SparkSession, folder: str) -> DataFrame:
    return match_fact(raw_matches(spark, folder))


def tournaments(spark: SparkSession, folder: str) -> DataFrame:
    return tournament_dim(raw_tournaments(spark, folder))


def seasons(spark: SparkSession, folder: str) -> PropertyGraph:
    return season_graph(players(spark, folder), matches(spark, folder), FIRST_YEAR, LAST_YEAR)


def raw_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their parts; price in whole units as text such as ``$1,049``."""
    # What a part alone decides is worked out once per part, ahead of the join.
    parts = table(spark, folder, "part").select(
        "p_partkey",
        "p_type",
        F.when(F.col("p_brand") == "Brand#13", None)
        .when(F.col("p_brand") == "Brand#14", "")
        .otherwise(F.col("p_brand"))
        .alias("neighbourhood"),
        _text(F.nullif("p_size", F.lit(50))).alias("latitude"),
        F.col("p_retailprice").cast("string").alias("longitude"),
        _text(F.nullif(F.col("p_size") % 10, F.lit(0))).alias("calculated_host_listings_count"),
    )
    lines = table(spark, folder, "lineitem")
    quantity, tax, discount = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    units = F.floor(F.col("l_extendedprice") / 100).cast("bigint")
    price = F.when(units < 1000, F.concat(F.lit("$"), units)).otherwise(
        F.concat(F.lit("$"), F.format_number(units, 0))
    )
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("id"),
        _text(F.col("l_suppkey"), "bigint").alias("host_id"),
        F.col("l_linestatus").alias("neighbourhood_group"),
        "neighbourhood",
        F.when((F.col("p_type") == "PROMO") & (F.col("l_linenumber") == 7), "")
        .otherwise(F.col("p_type"))
        .alias("room_type"),
        "latitude",
        "longitude",
        F.when(quantity == 13, "")
        .when(quantity == 17, "1.2.3")
        .when(quantity == 19, None)
        .otherwise(price)
        .alias("price"),
        _text(F.nullif("l_linenumber", F.lit(7))).alias("minimum_nights"),
        F.when(tax == 0.0, None)
        .when(tax == 0.08, "n/a")
        .otherwise(_text(quantity))
        .alias("number_of_reviews"),
        F.when(tax == 0.0, None).otherwise(tax.cast("string")).alias("reviews_per_month"),
        "calculated_host_listings_count",
        F.when(discount == 0.1, None)
        .otherwise(_text(F.round(discount * 100)))
        .alias("availability_365"),
    )


def listings(spark: SparkSession, folder: str) -> DataFrame:
    return prepare_listings(raw_listings(spark, folder))
