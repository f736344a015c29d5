"""Every query by name, as a function of the session and the table folder."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.functions import columns as fx
from matchbook.operators import indexing, metrics, price_model, profile
from matchbook.operators import listings as prep
from matchbook.operators.graph import endpoint_ids
from matchbook.operators.pagerank import pagerank
from matchbook.operators.ranking import rank_rows
from matchbook.plans import season, tour, warehouse
from matchbook.sources.inference import infer_types

Query = Callable[[SparkSession, str], DataFrame]

# Arguments of the event and title queries on the test tables.
EVENT = ("Urgent 03-17", 1997)
TITLE_YEAR = 1998

SCORE_DIGITS = 6

LABELLED = ("host_id", "neighbourhood", "room_type")

# Columns of the matches that a description takes: text and numbers.
DESCRIBED_MATCH = ("tourn_place", "tourn_round", "source", "destination", "source_seed", "destination_seed")


def rounded(df: DataFrame, digits: int = SCORE_DIGITS) -> DataFrame:
    """Fractions rounded, so that the order of a sum does not show.

    Done in double arithmetic: ``round`` goes through decimals, row by row.
    """
    return df.select(
        *[
            nearest(F.col(name), digits).alias(name) if data_type == "double" else F.col(name)
            for name, data_type in df.dtypes
        ]
    )


def nearest(c: Column, digits: int = SCORE_DIGITS) -> Column:
    scale = 10.0**digits
    steps = F.floor(F.abs(c) * scale + 0.5)
    # Beyond that a double has no such digits; NaN counts as larger than all.
    fine = F.abs(c) * scale < 2.0**52
    return F.when(fine, F.signum(c) * steps / scale).otherwise(c)


def _table(name: str, make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: make(warehouse.table(spark, folder, name))


def _from(role: Callable, make: Callable) -> Query:
    return lambda spark, folder: make(role(spark, folder))


def _prepared(*wanted: str) -> Query:
    return _from(warehouse.listings, lambda df: rounded(df.select("id", *wanted)))


def _event(graph):
    return season.one_event(graph, *EVENT)


def _important(spark: SparkSession, folder: str, **options):
    return season.important_matches(
        warehouse.seasons(spark, folder), warehouse.tournaments(spark, folder), **options
    )


def _titles(make: Callable) -> Query:
    return _from(warehouse.tournaments, lambda df: make(df, TITLE_YEAR))


def _pagerank(spark: SparkSession, folder: str) -> DataFrame:
    reversed_graph = warehouse.tour_graph(spark, folder).reverse()
    return rounded(pagerank(reversed_graph, tol=0.001))


# Feature stages on the prepared listings.


def _fit(stages, rows: DataFrame):
    """Fit with the rows held, so that they are cleaned once for all fitted stages."""
    with price_model.held(rows) as kept:
        return stages.fit(kept)


def string_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = warehouse.listings(spark, folder).select("id", *price_model.CATEGORIES)
    indexes = indexing.label_indexes(rows, price_model.CATEGORIES)
    return indexing.with_indexes(rows, indexes, price_model.CATEGORIES)


def label_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """Every label of the listings' text columns with its index."""
    return indexing.label_indexes(warehouse.raw_listings(spark, folder), LABELLED)


def mean_impute(spark: SparkSession, folder: str) -> DataFrame:
    rows = warehouse.listings(spark, folder)
    imputed = _fit(price_model.imputer(), rows).transform(rows)
    return rounded(imputed.select("id", *[f"{c}_imp" for c in price_model.IMPUTED]))


def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    """Width of each one-hot vector and the slot it sets."""
    rows = warehouse.listings(spark, folder)
    stages = Pipeline(stages=[price_model.string_indexer(), price_model.one_hot_encoder()])
    encoded = _fit(stages, rows).transform(rows)
    slots = []
    for c in price_model.CATEGORIES:
        slot = vector_to_array(f"{c}_vec")
        slots += [
            F.size(slot).alias(f"{c}_width"),
            (F.array_position(slot, 1.0) - 1).alias(f"{c}_slot"),
            F.aggregate(slot, F.lit(0.0), lambda a, b: a + b).alias(f"{c}_sum"),
        ]
    return encoded.select("id", *slots)


def assemble_features(spark: SparkSession, folder: str) -> DataFrame:
    """The assembled vector, its numbers taken out again by position.

    They are rounded as one list: written out for each, the code of the rows grows so
    large that the JVM leaves it uncompiled.
    """
    rows = warehouse.listings(spark, folder)
    assembled = _fit(price_model.feature_pipeline(), rows).transform(rows)
    slots = assembled.select("id", vector_to_array("features").alias("slots"))
    n = len(price_model.ASSEMBLED)
    numbers = F.transform(F.slice("slots", -n, n), lambda c: nearest(c)).alias("numbers")
    return slots.select("id", F.size("slots").alias("n_slots"), numbers).select(
        "id",
        "n_slots",
        *[F.get("numbers", F.lit(i)).alias(f"f_{name}") for i, name in enumerate(price_model.ASSEMBLED)],
    )


# Models.


def _linear_on_reviews() -> Pipeline:
    """Log price over the number of reviews; a listing without that number gets the mean."""
    filled = Imputer(inputCols=["number_of_reviews"], outputCols=["reviews"], strategy="mean")
    one_feature = VectorAssembler(inputCols=["reviews"], outputCol="features")
    return Pipeline(stages=[filled, one_feature, price_model.regressor("lr")])


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("number_of_reviews").cast("double").alias("number_of_reviews")
    return warehouse.listings(spark, folder).select("id", "label", number)


def linear_regression(spark: SparkSession, folder: str) -> DataFrame:
    model = price_model.fit(_linear_on_reviews(), _reviews(spark, folder), key=None).stages[-1]
    line = (float(model.coefficients[0]), float(model.intercept))
    return rounded(spark.createDataFrame([line], "slope double, intercept double"))


def _linear_scores(spark: SparkSession, folder: str) -> DataFrame:
    training, test = prep.split(_reviews(spark, folder))
    return price_model.fit(_linear_on_reviews(), training, key=None).transform(test)


def _pipeline_scores(model: Estimator, key: str | None) -> Query:
    """Held-out listings scored by the whole pipeline: every one of them."""

    def scored(spark: SparkSession, folder: str) -> DataFrame:
        training, test = prep.split(warehouse.listings(spark, folder))
        return price_model.fit(price_model.price_pipeline(model), training, key).transform(test)

    return scored


def _linear_pipeline_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _pipeline_scores(price_model.regressor("lr"), None)(spark, folder)


def _forest_scores(spark: SparkSession, folder: str) -> DataFrame:
    training, test = prep.split(warehouse.listings(spark, folder))
    return _forest(training).transform(test)


def rf_predict(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.prediction_report(_forest_scores(spark, folder), "id")


def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    training, test = prep.split(warehouse.listings(spark, folder))
    model = _forest(training)
    return price_model.top_importances(model, model.transform(test))


def _forest(training: DataFrame):
    """The first point of the full grid."""
    forest = price_model.regressor("rf").setNumTrees(50).setMaxDepth(5)
    return price_model.fit(price_model.price_pipeline(forest), training)


def cv_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Mean RMSE over five folds for each of the 36 points of the grid, the best one marked."""
    training, _ = prep.split(warehouse.listings(spark, folder))
    folded = training.withColumn("fold", prep.fold_number())
    forest = price_model.regressor("rf")
    grid = price_model.forest_grid(forest)
    found = price_model.grid_search(forest, grid, folded, "fold", parallelism=4)
    names = ["numTrees", "maxDepth", "minInstancesPerNode", "maxBins"]
    rows = [
        (*[point[forest.getParam(n)] for n in names], score, i == found.best_index)
        for i, (point, score) in enumerate(zip(grid, found.scores, strict=True))
    ]
    return spark.createDataFrame(
        rows,
        "num_trees int, max_depth int, min_instances int, max_bins int, "
        "mean_rmse double, is_best boolean",
    )


def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse.listings(spark, folder).select(
        "id",
        F.when(prep.in_training_share(), "train").otherwise("test").alias("part"),
        prep.fold_number().alias("fold"),
    )


SCANS: Mapping[str, Query] = {
    "scan_table": _table("customer", lambda df: df),
    "table_shape": _table("lineitem", profile.table_shape),
    "player_dim": warehouse.players,
    "match_fact": warehouse.matches,
    "tournament_dim": warehouse.tournaments,
    "preview": _table(
        "orders",
        lambda df: profile.preview(df, ["o_orderkey"]),
    ),
}

TYPED: Mapping[str, Query] = {
    "infer_listing_types": _from(warehouse.raw_listings, infer_types),
    "infer_match_types": _from(
        warehouse.raw_matches,
        lambda df: infer_types(df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])),
    ),
    "preview_players": _from(warehouse.players, lambda df: profile.preview(df, ["player_id"])),
    "preview_matches": _from(warehouse.matches, lambda df: profile.preview(df, ["match_id"])),
    "describe_players": _from(
        warehouse.players,
        lambda df: rounded(profile.describe(df.drop("date_of_birth")), 4),
    ),
    "describe_matches": _from(
        warehouse.matches, lambda df: rounded(profile.describe(df.select(*DESCRIBED_MATCH)), 4)
    ),
}

EXPRESSIONS: Mapping[str, Query] = {
    "project_rename": _from(
        warehouse.raw_matches,
        lambda df: df.select(
            "match_id", F.col("winner_id").alias("source"), F.col("loser_id").alias("destination")
        ),
    ),
    "parse_date": _from(
        warehouse.raw_players,
        lambda df: df.select(
            "player_id", "birthdate", fx.date_from_text("birthdate").alias("date_of_birth")
        ),
    ),
    "full_name": _from(
        warehouse.raw_players,
        lambda df: df.select(
            "player_id", fx.full_name("first_name", "last_name").alias("full_name")
        ),
    ),
    "composite_id": _from(
        warehouse.raw_listings,
        lambda df: df.select(fx.composite_key("host_id", "id").alias("host_id_id")),
    ),
    "null_default_cast": _from(
        warehouse.raw_listings,
        lambda df: rounded(
            df.select(
                fx.composite_key("host_id", "id").alias("id"),
                fx.default_when_null("number_of_reviews", "int", 0).alias("number_of_reviews"),
                fx.default_when_null("reviews_per_month", "double", 0.0).alias(
                    "reviews_per_month"
                ),
            )
        ),
    ),
    "clean_price": _from(
        warehouse.raw_listings,
        lambda df: prep.clean_prices(df).select(
            fx.composite_key("host_id", "id").alias("id"), "price"
        ),
    ),
    "outlier_range": _from(
        warehouse.raw_listings,
        lambda df: prep.clean_prices(df)
        .filter(fx.within("price", *prep.PRICE_RANGE))
        .select(fx.composite_key("host_id", "id").alias("id"), "price"),
    ),
    "log_label": _prepared("label"),
    "log1p_features": _prepared("log_minimum_nights", "log_availability"),
    "safe_ratio": _prepared("reviews_per_availability"),
    "has_flag": _prepared("has_reviews"),
    "points_case": _from(
        warehouse.tournaments,
        lambda df: df.select(
            "tourn_id", "tourn_type", fx.points_by_category("tourn_type").alias("points")
        ),
    ),
    "edge_style": _from(warehouse.tour_graph, tour.edge_style),
}

PROFILES: Mapping[str, Query] = {
    "describe_table": _table("lineitem", lambda df: rounded(profile.describe(df), 4)),
    "null_census": _from(warehouse.raw_listings, profile.missing_census),
    "count_by_category": _table(
        "part", lambda df: profile.count_by(df, "p_type").orderBy(F.desc("n"), "p_type")
    ),
    "top_neighbourhoods": _table(
        "part",
        lambda df: profile.count_by(df, "p_brand").orderBy(F.desc("n"), "p_brand").limit(10),
    ),
    "price_stats": _table(
        "lineitem", lambda df: rounded(profile.number_summary(df, F.col("l_extendedprice")), 4)
    ),
    "price_stats_clean": _from(
        warehouse.listings, lambda df: rounded(profile.number_summary(df, F.exp("label")), 4)
    ),
}

GRAPHS: Mapping[str, Query] = {
    "graph_vertices": _from(warehouse.seasons, lambda g: g.vertices),
    "graph_edges": _from(warehouse.seasons, lambda g: g.edges),
    "graph_size": _from(warehouse.seasons, lambda g: g.size()),
    "triplets": _from(warehouse.tour_graph, lambda g: g.triplets()),
    "reverse_edges": _from(
        warehouse.tour_graph, lambda g: g.reverse().edges.select("match_id", "src", "dst")
    ),
    "involved_ids": _from(warehouse.tour_graph, lambda g: endpoint_ids(g.edges)),
    "subgraph_edges": _from(warehouse.seasons, lambda g: _event(g).edges),
    "subgraph_vertices": _from(warehouse.seasons, lambda g: _event(g).vertices),
    "pagerank": _pagerank,
}

TOUR: Mapping[str, Query] = {
    "match_details": _from(warehouse.tour_graph, tour.match_details),
    "match_list": _from(warehouse.tour_graph, tour.match_list),
    "stage_ranking": _from(warehouse.tour_graph, tour.stage_ranking),
    "stage_results": _from(warehouse.tour_graph, tour.stage_results),
    "total_points": _from(warehouse.tour_graph, tour.total_points),
    "overall_winner": _from(warehouse.tour_graph, tour.overall_winner),
    "points_ranking": _from(
        warehouse.tour_graph,
        lambda g: rank_rows(tour.points_of_all(g), [F.desc("points"), F.asc("id")]),
    ),
    "repeat_pairs": _from(warehouse.tour_graph, tour.repeat_pairs),
    "ever_won": _from(warehouse.tour_graph, tour.ever_won),
    "ever_lost": _from(warehouse.tour_graph, tour.ever_lost),
    "won_and_lost": _from(warehouse.tour_graph, tour.won_and_lost),
    "never_won": _from(warehouse.tour_graph, tour.never_won),
    "never_lost": _from(warehouse.tour_graph, tour.never_lost),
    "win_counts": _from(warehouse.tour_graph, tour.win_counts),
    "win_counts_top": _from(warehouse.tour_graph, tour.win_counts_top),
    "pagerank_top": _from(warehouse.tour_graph, lambda g: rounded(tour.pagerank_top(g))),
}

SEASON: Mapping[str, Query] = {
    "edges_by_tournament": _from(warehouse.seasons, season.edges_by_tournament),
    "edges_by_year": _from(warehouse.seasons, season.edges_by_year),
    "vertices_by_country": _from(warehouse.seasons, season.vertices_by_country),
    "tournament_results": _from(
        warehouse.seasons, lambda g: season.tournament_results(g, *EVENT)
    ),
    "important_edges": lambda spark, folder: _important(spark, folder).edges,
    "important_edges_same_year": lambda spark, folder: _important(
        spark, folder, same_year=True
    ).edges,
    "important_vertices": lambda spark, folder: _important(spark, folder).vertices,
    "important_match_counts": lambda spark, folder: season.important_match_counts(
        _important(spark, folder)
    ),
    "round_robin_matches": _from(
        warehouse.seasons, lambda g: season.round_robin_matches(g.edges)
    ),
    "round_robin_groups": _from(warehouse.seasons, season.round_robin_groups),
    "group_players": _from(warehouse.seasons, season.group_players),
    "group_wins": _from(warehouse.seasons, season.group_wins),
    "group_qualifiers": _from(warehouse.seasons, season.group_qualifiers),
    "group_qualifiers_with_wins": _from(
        warehouse.seasons, lambda g: season.group_qualifiers(g, winless=False)
    ),
    "top_by_titles": _titles(season.top_by_titles),
    "top_by_points": _titles(season.top_by_points),
    "top_detail": _titles(season.top_detail),
}

PRICES: Mapping[str, Query] = {
    "prepare_listings": _from(warehouse.listings, rounded),
    "hash_split": hash_split,
    "string_index": string_index,
    "label_indexes": label_indexes,
    "mean_impute": mean_impute,
    "one_hot": one_hot,
    "assemble_features": assemble_features,
    "linear_regression": linear_regression,
    "regression_metrics": lambda spark, folder: rounded(
        metrics.regression_metrics(_linear_scores(spark, folder))
    ),
    "score_errors": lambda spark, folder: rounded(
        metrics.error_report(_linear_scores(spark, folder), "id")
    ),
    "linear_pipeline_metrics": lambda spark, folder: rounded(
        metrics.regression_metrics(_linear_pipeline_scores(spark, folder))
    ),
    "forest_metrics": lambda spark, folder: rounded(
        metrics.regression_metrics(_forest_scores(spark, folder))
    ),
    "forest_errors": lambda spark, folder: rounded(
        metrics.error_report(_forest_scores(spark, folder), "id")
    ),
    "rf_predict": rf_predict,
    "feature_importance": feature_importance,
    "cv_metrics": cv_metrics,
}


def all_queries() -> dict[str, Query]:
    return {**SCANS, **TYPED, **EXPRESSIONS, **PROFILES, **GRAPHS, **TOUR, **SEASON, **PRICES}
