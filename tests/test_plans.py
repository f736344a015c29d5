"""What the optimizer must make of the queries."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from matchbook.operators.graph import PropertyGraph
from matchbook.operators.ranking import best_per_group
from matchbook.plans import registry, tour

QUERIES = registry.all_queries()
LOOPS_AND_FITS = {
    "pagerank",
    "pagerank_top",
    "round_robin_groups",
    "group_players",
    "group_qualifiers",
    "group_qualifiers_with_wins",
    "string_index",
    "mean_impute",
    "one_hot",
    "assemble_features",
    "linear_regression",
    "regression_metrics",
    "score_errors",
    "rf_predict",
    "linear_pipeline_metrics",
    "forest_metrics",
    "forest_errors",
    "feature_importance",
    "cv_metrics",
}


def plan(df, final=False):
    if final:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def setting(spark):
    changed = {}

    def change(key, value):
        changed.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield change
    for key, value in changed.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LOOPS_AND_FITS))
def test_no_cross_product_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas"):
        assert operator not in text


@pytest.mark.parametrize("name", ["ever_won", "won_and_lost"])
def test_matches_are_read_once(spark, name):
    final = plan(QUERIES[name](spark, SMALL), final=True).split("== Initial Plan ==")[0]
    assert final.count("lineitem.parquet") == 1


def test_price_is_parsed_once_a_row(spark):
    assert plan(QUERIES["prepare_listings"](spark, SMALL)).count("[^0-9.]") == 1


def test_rounding_keeps_what_has_no_such_digits(spark):
    values = [1.0e13, -2.5e14, float("inf"), float("-inf"), float("nan"), None, 1.23456789, -0.1234565]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = [r["x"] for r in registry.rounded(df).collect()]
    assert found[:4] == values[:4] and found[4] != found[4] and found[5] is None
    assert found[6] == 1.234568 and found[7] == -0.123457


def test_stage_filter_runs_before_the_join(spark):
    text = plan(QUERIES["stage_results"](spark, SMALL))
    lines = next(part for part in text.split("FileScan")[1:] if "lineitem" in part)
    assert "l_quantity" in lines.split("DataFilters:")[1].split("PushedFilters")[0]


def test_edges_are_read_once_for_a_top_k(spark):
    text = plan(QUERIES["overall_winner"](spark, SMALL), final=True)
    final = text.split("== Initial Plan ==")[0]
    assert final.count("lineitem.parquet") == 1


@pytest.mark.parametrize(
    "name", ["overall_winner", "win_counts_top", "edges_by_tournament", "top_by_titles", "preview"]
)
def test_top_k_does_not_sort_everything(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "TakeOrderedAndProject" in text
    assert "rangepartitioning" not in text


def test_scan_reads_only_what_is_used(spark):
    text = plan(QUERIES["win_counts"](spark, SMALL))
    lines = next(part for part in text.split("FileScan")[1:] if "lineitem" in part)
    assert "l_extendedprice" not in lines and "l_shipdate" not in lines


def test_points_are_summed_before_the_shuffle(spark):
    text = plan(QUERIES["total_points"](spark, SMALL))
    assert "partial_sum(points" in text


def test_groups_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    best = best_per_group(df, ["g"], [F.desc("id")], 2)
    above, below = plan(best).split("Exchange", 1)
    assert "WindowGroupLimit" in above and "WindowGroupLimit" in below


def test_hot_player_is_split(spark, setting):
    """A third of all matches won by one player: adaptive execution splits that partition."""
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "10KB")
    setting("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    setting("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    ids = spark.range(0, 60_000, 1, 8).select(F.col("id"))
    edges = ids.select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("src"),
        ((F.col("id") * 31) % 60_000).alias("dst"),
    )
    vertices = ids.select("id", F.concat(F.lit("player "), "id").alias("name"))
    graph = PropertyGraph(vertices, edges)
    named = graph.triplets(["name"])
    assert named.count() == 60_000
    assert named.filter("src_name is null or dst_name is null").count() == 0
    assert "skew=true" in plan(named, final=True)


def test_assembled_numbers_are_rounded_in_one_expression(spark, capsys):
    """Rounding written out for each number makes a method that the JVM leaves uncompiled."""
    registry.PRICES["assemble_features"](spark, SMALL).explain()
    plan = capsys.readouterr().out
    assert plan.count("SIGNUM") == 1


def test_the_sentences_of_matches_are_made_after_the_sort(spark):
    vertices = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    edges = spark.createDataFrame(
        [("m2", 1, 2, "F"), ("m1", 1, 2, "S")], "match_id string, src long, dst long, match_type string"
    )
    found = tour.match_list(PropertyGraph(vertices, edges))
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < text.index("concat_ws") < text.index("Sort [")
    assert [tuple(r) for r in found.collect()] == [
        ("m1", "a", "a beat b in match S"),
        ("m2", "a", "a beat b in match F"),
    ]
