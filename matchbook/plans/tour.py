"""Questions about one tournament.

Vertices are ``(id, name, country)``; edges are ``(match_id, src, dst, match_type,
points, head2head)``. Points belong to the winner of a match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.functions.columns import edge_color, edge_label, edge_pen_width
from matchbook.operators.graph import PropertyGraph
from matchbook.operators.pagerank import pagerank

GROUP_STAGES = ("G1", "G2")
KNOCKOUT_STAGES = ("S", "F")


def match_details(graph: PropertyGraph) -> DataFrame:
    """All matches by winner; the match id keeps a much-repeated winner sortable in parts."""
    return graph.edges.orderBy("src", "match_id")


def match_list(graph: PropertyGraph) -> DataFrame:
    """Who beat whom, by name of the winner; sorted first, so that no sentence is shuffled."""
    named = graph.triplets(["name"]).select("match_id", "src_name", "dst_name", "match_type")
    sentence = F.concat_ws(
        " ", "src_name", F.lit("beat"), "dst_name", F.lit("in match"), "match_type"
    )
    return named.orderBy("src_name", "match_id").select(
        "match_id", "src_name", sentence.alias("sentence")
    )


def stage_ranking(graph: PropertyGraph, stages: Sequence[str] = GROUP_STAGES) -> DataFrame:
    """Points of every winner within each stage."""
    points = (
        graph.edges.filter(F.col("match_type").isin(*stages))
        .groupBy("match_type", F.col("src").alias("id"))
        .agg(F.sum("points").alias("points"))
    )
    return (
        _with_name(graph, points)
        .select("match_type", "id", "name", "points")
        .orderBy("match_type", F.desc("points"), "id")
    )


def stage_results(graph: PropertyGraph, stages: Sequence[str] = KNOCKOUT_STAGES) -> DataFrame:
    """Who beat whom in the given stages, and for how many points."""
    played = graph.edges.filter(F.col("match_type").isin(*stages))
    return PropertyGraph(graph.vertices, played).triplets(["name"]).select(
        "match_id",
        "match_type",
        F.col("src_name").alias("winner"),
        F.col("dst_name").alias("loser"),
        "points",
    )


def points_by_winner(graph: PropertyGraph) -> DataFrame:
    return graph.edges.groupBy(F.col("src").alias("id")).agg(F.sum("points").alias("points"))


def total_points(graph: PropertyGraph) -> DataFrame:
    """Points of every winner over all matches."""
    return (
        _with_name(graph, points_by_winner(graph))
        .select("id", "name", "points")
        .orderBy(F.desc("points"), "id")
    )


def points_of_all(graph: PropertyGraph) -> DataFrame:
    """``id, name, points`` of every player; one who never won has none."""
    points = F.coalesce("points", F.lit(0).cast("long")).alias("points")
    return graph.vertices.join(points_by_winner(graph), "id", "left").select("id", "name", points)


def overall_winner(graph: PropertyGraph) -> DataFrame:
    best = points_by_winner(graph).orderBy(F.desc("points"), "id").limit(1)
    return _with_name_of_few(graph, best).select("id", "name", "points")


def repeat_pairs(graph: PropertyGraph) -> DataFrame:
    """Pairs that met more than once, whoever won."""
    met = (
        graph.edges.groupBy(F.least("src", "dst").alias("id_1"), F.greatest("src", "dst").alias("id_2"))
        .agg(F.count(F.lit(1)).alias("n_matches"))
        .filter(F.col("n_matches") > 1)
    )
    named = _with_name(graph, _with_name(graph, met, "id_1", "name_1"), "id_2", "name_2")
    return named.select("id_1", "name_1", "id_2", "name_2", "n_matches")


def ever_won(graph: PropertyGraph) -> DataFrame:
    return graph.vertices_with("src").orderBy("name", "id")


def ever_lost(graph: PropertyGraph) -> DataFrame:
    return graph.vertices_with("dst").orderBy("name", "id")


def won_and_lost(graph: PropertyGraph) -> DataFrame:
    """Both ends of an edge come out of one pass over the edges."""
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.lit(True).alias("won")),
        F.struct(F.col("dst").alias("id"), F.lit(False).alias("won")),
    )
    played = graph.edges.select(F.explode(ends).alias("end")).select("end.*")
    both = played.groupBy("id").agg(F.bool_or("won").alias("won"), F.bool_and("won").alias("always"))
    both = both.filter(F.col("won") & ~F.col("always")).select("id")
    return graph.vertices.join(both, "id", "left_semi").orderBy("name", "id")


def never_won(graph: PropertyGraph) -> DataFrame:
    return graph.vertices_without("src").orderBy("name", "id")


def never_lost(graph: PropertyGraph) -> DataFrame:
    return graph.vertices_without("dst").orderBy("name", "id")


def win_counts(graph: PropertyGraph) -> DataFrame:
    return (
        _with_name(graph, graph.degrees("src", "wins"))
        .select("id", "name", "wins")
        .orderBy(F.desc("wins"), "id")
    )


def win_counts_top(graph: PropertyGraph, k: int = 3) -> DataFrame:
    best = graph.degrees("src", "wins").orderBy(F.desc("wins"), "id").limit(k)
    return _with_name_of_few(graph, best).select("id", "name", "wins")


def pagerank_top(graph: PropertyGraph, k: int = 3, tol: float = 0.001) -> DataFrame:
    """Most important players: rank flows from the loser to the winner."""
    best = pagerank(graph.reverse(), tol).orderBy(F.desc("rank"), "id").limit(k)
    return _with_name_of_few(graph, best).select("id", "name", "rank")


def edge_style(graph: PropertyGraph) -> DataFrame:
    """Label, color and pen width of every edge in a drawing."""
    return graph.edges.select(
        "match_id",
        "src",
        "dst",
        edge_label("match_type", "points").alias("label"),
        edge_color("match_type").alias("color"),
        edge_pen_width("match_type").alias("pen_width"),
    )


def _with_name(
    graph: PropertyGraph, df: DataFrame, id_col: str = "id", name_col: str = "name"
) -> DataFrame:
    names = graph.vertices.select(F.col("id").alias(id_col), F.col("name").alias(name_col))
    return df.join(names, id_col, "left")


def _with_name_of_few(graph: PropertyGraph, few: DataFrame) -> DataFrame:
    """Names for a limited number of rows: the few rows travel, the vertices do not."""
    names = graph.vertices.select("id", "name").join(
        F.broadcast(few.select("id")), "id", "left_semi"
    )
    return few.join(F.broadcast(names), "id", "left")
