"""Questions about the matches and titles of several seasons.

Vertices are ``(id, first_name, last_name, nationality, full_name)``; edges are
``(match_id, src, dst, tournament, round, round_order, match_score, year)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.functions.columns import (
    IMPORTANT_CATEGORIES,
    full_name,
    points_by_category,
    same_text,
)
from matchbook.operators.components import connected_groups
from matchbook.operators.graph import PropertyGraph
from matchbook.operators.profile import count_by
from matchbook.operators.ranking import best_per_group, top_ranked
from matchbook.runtime import cut, let_go

EVENT = ["tournament", "year"]
ROUND_ROBIN = "Round Robin"


def player_vertices(players: DataFrame, one_row_per_id: bool = False) -> DataFrame:
    """Distinct players with their full name.

    An id with two spellings stays twice unless ``one_row_per_id`` is set, which
    keeps the least of the rows.
    """
    rows = players.select(
        F.col("player_id").cast("string").alias("id"),
        "first_name",
        "last_name",
        "nationality",
        full_name("first_name", "last_name").alias("full_name"),
    )
    if not one_row_per_id:
        return rows.distinct()
    payload = [c for c in rows.columns if c != "id"]
    least = rows.groupBy("id").agg(F.min(F.struct(*payload)).alias("row"))
    return least.select("id", *[F.col(f"row.{c}").alias(c) for c in payload])


def match_edges(matches: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Matches of a range of years; a match without a start date has no year."""
    return (
        matches.withColumn("year", F.year("tourn_start_date"))
        .filter(F.col("year").between(first_year, last_year))
        .select(
            "match_id",
            F.col("source").cast("string").alias("src"),
            F.col("destination").cast("string").alias("dst"),
            F.col("tourn_name").alias("tournament"),
            F.col("tourn_round").alias("round"),
            F.col("tourn_round_order").alias("round_order"),
            "match_score",
            "year",
        )
    )


def season_graph(
    players: DataFrame, matches: DataFrame, first_year: int = 2020, last_year: int = 2022
) -> PropertyGraph:
    return PropertyGraph(
        player_vertices(players), match_edges(matches, first_year, last_year)
    )


def edges_by_tournament(graph: PropertyGraph, k: int = 15) -> DataFrame:
    return (
        count_by(graph.edges, "tournament", name="n_matches")
        .orderBy(F.desc("n_matches"), "tournament")
        .limit(k)
    )


def edges_by_year(graph: PropertyGraph) -> DataFrame:
    return count_by(graph.edges, "year", name="n_matches").orderBy("year")


def vertices_by_country(graph: PropertyGraph) -> DataFrame:
    return count_by(graph.vertices, "nationality", name="n_players").orderBy(
        F.desc("n_players"), "nationality"
    )


def one_event(graph: PropertyGraph, tournament: str, year: int) -> PropertyGraph:
    """Subgraph of one tournament in one year."""
    return graph.subgraph(same_text("tournament", tournament) & (F.col("year") == year))


def tournament_results(graph: PropertyGraph, tournament: str, year: int) -> DataFrame:
    """Matches of one event in playing order; an unknown player keeps a null name."""
    played = one_event(graph, tournament, year).edges
    named = PropertyGraph(graph.vertices, played).triplets(["full_name"])
    return named.select(
        "year",
        "round_order",
        "round",
        F.col("src_full_name").alias("winner"),
        F.col("dst_full_name").alias("loser"),
        "match_score",
        "match_id",
    ).orderBy("round_order", "match_id")


def important_matches(
    graph: PropertyGraph,
    tournaments: DataFrame,
    categories: Sequence[str] = IMPORTANT_CATEGORIES,
    name_col: str = "tourn_name",
    same_year: bool = False,
) -> PropertyGraph:
    """Subgraph of tournaments that have one of the categories.

    A tournament counts in every year once its name has the category in any year;
    with ``same_year`` only the years in which it has it count. ``name_col`` names
    the column that holds the spelling used by the matches.
    """
    wanted = tournaments.filter(F.col("tourn_type").isin(*categories))
    keys, edge_keys = [F.lower(name_col)], [F.lower("tournament")]
    if same_year:
        keys.append(F.col("tourn_start_year"))
        edge_keys.append(F.col("year"))
    return graph.subgraph_in(wanted.select(*keys), edge_keys)


def important_match_counts(important: PropertyGraph) -> DataFrame:
    return count_by(important.edges, "tournament", name="n_matches").orderBy(
        F.desc("n_matches"), "tournament"
    )


def round_robin_matches(edges: DataFrame, prefix: str = ROUND_ROBIN) -> DataFrame:
    return edges.filter(F.col("round").startswith(prefix))


def event_round_robin(graph: PropertyGraph) -> DataFrame:
    """Round-robin matches with the lower-case name of their event: spellings are one event."""
    played = round_robin_matches(graph.edges)
    return played.withColumn("tournament", F.lower("tournament"))


def round_robin_groups(graph: PropertyGraph) -> DataFrame:
    """Groups of players who met in the round robin of an event, for every event."""
    return connected_groups(event_round_robin(graph), EVENT)


def group_players(graph: PropertyGraph) -> DataFrame:
    named = graph.vertices.select("id", "full_name", "nationality")
    return round_robin_groups(graph).join(named, "id")


def group_wins(graph: PropertyGraph) -> DataFrame:
    """Round-robin wins of every player in every event."""
    return (
        event_round_robin(graph)
        .groupBy(*EVENT, F.col("src").alias("id"))
        .agg(F.count(F.lit(1)).alias("wins"))
    )


#: Ids that are sent to all tasks at once, if there are no more.
FEW_IDS = 100_000


def group_qualifiers(graph: PropertyGraph, k: int = 2, winless: bool = True) -> DataFrame:
    """The ``k`` players of each group with most wins.

    A player without a win counts zero wins; without ``winless`` such a player
    cannot qualify, and a group may send fewer than ``k``.
    """
    # The wins come out of the task that finds the groups of an event.
    players = connected_groups(event_round_robin(graph), EVENT, wins="wins")
    if not winless:
        players = players.filter("wins > 0")
    named = graph.vertices.select("id", "full_name", "nationality")
    known = _of_known(players, named)
    # Every id left has a name, so that names are looked up for k ids of a group only; an id
    # with two names takes two places.
    place = [*EVENT, "group_id"], [F.desc("wins"), F.asc("id")], k
    best = best_per_group(known, *place).drop("rank").join(named, "id")
    columns = [*EVENT, "id", "group_id", "full_name", "nationality", "wins"]
    return best_per_group(best.select(*columns), *place)


def _of_known(players: DataFrame, named: DataFrame) -> DataFrame:
    """The rows with an id of ``named``; where all have one, none of them is shuffled."""
    ids = players.select("id").distinct()
    strangers, seen = cut(ids.join(named, "id", "left_anti"), n=F.count(F.lit(1)))
    let_go(players.sparkSession)
    if not seen["n"]:
        return players
    few = seen["n"] <= FEW_IDS
    return players.join(F.broadcast(strangers) if few else strangers, "id", "left_anti")


def titles_won(
    tournaments: DataFrame, year: int, categories: Sequence[str] = IMPORTANT_CATEGORIES
) -> DataFrame:
    """Decided tournaments of the year that have one of the categories."""
    return tournaments.filter(
        (F.col("tourn_start_year") == year)
        & F.col("tourn_type").isin(*categories)
        & F.col("winner_id").isNotNull()
        & F.col("tourn_winner").isNotNull()
    )


def top_by_titles(tournaments: DataFrame, year: int, k: int = 10) -> DataFrame:
    titles = count_by(
        titles_won(tournaments, year), "winner_id", "tourn_winner", name="titles"
    )
    return top_ranked(titles, [F.desc("titles"), F.asc("winner_id")], k)


def top_by_points(tournaments: DataFrame, year: int, k: int = 10) -> DataFrame:
    """Titles weighted by category."""
    weighted = titles_won(tournaments, year).withColumn("points", points_by_category("tourn_type"))
    totals = weighted.groupBy("winner_id", "tourn_winner").agg(
        F.sum("points").alias("total_points")
    )
    return top_ranked(totals, [F.desc("total_points"), F.asc("winner_id")], k)


def top_detail(tournaments: DataFrame, year: int, k: int = 10) -> DataFrame:
    """The titles behind each of the top players by points: one join, not a query each."""
    best = top_by_points(tournaments, year, k).select("rank", "winner_id", "total_points")
    return (
        titles_won(tournaments, year)
        .withColumn("points", points_by_category("tourn_type"))
        .join(F.broadcast(best), "winner_id")
        .select(
            "rank",
            "winner_id",
            "tourn_winner",
            "total_points",
            "tourn_id",
            "tourn_name",
            "tourn_type",
            "points",
        )
        .orderBy("rank", "tourn_id")
    )
