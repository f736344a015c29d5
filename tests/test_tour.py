import pytest
from conftest import rows

from matchbook.operators.components import connected_groups
from matchbook.operators.graph import PropertyGraph, endpoint_ids
from matchbook.operators.pagerank import pagerank
from matchbook.plans import tour as q


def names(df):
    return [row["name"] for row in df.collect()]


def test_size(tour):
    assert dict(rows(tour.size())) == {"vertices": 8, "edges": 15}


def test_match_details_run_by_winner(tour):
    found = rows(q.match_details(tour).select("src", "dst", "points"))
    assert len(found) == 15
    assert [r[0] for r in found] == sorted(r[0] for r in found)


def test_match_list(tour):
    sentences = [row["sentence"] for row in q.match_list(tour).collect()]
    assert sentences[0] == "Andy Murray beat David Ferrer in match G2"
    assert "Novak Djokovic beat Roger Federer in match F" in sentences


def test_stage_ranking(tour):
    assert rows(q.stage_ranking(tour).select("match_type", "name", "points")) == [
        ("G1", "Roger Federer", 3),
        ("G1", "Novak Djokovic", 2),
        ("G1", "Kei Nishikori", 1),
        ("G2", "Rafael Nadal", 3),
        ("G2", "Stan Wawrinka", 2),
        ("G2", "Andy Murray", 1),
    ]


def test_stage_results(tour):
    found = q.stage_results(tour).select("match_type", "winner", "loser", "points")
    assert sorted(rows(found)) == [
        ("F", "Novak Djokovic", "Roger Federer", 11),
        ("S", "Novak Djokovic", "Rafael Nadal", 5),
        ("S", "Roger Federer", "Stan Wawrinka", 5),
    ]


def test_total_points_and_winner(tour):
    assert rows(q.total_points(tour).select("name", "points")) == [
        ("Novak Djokovic", 18),
        ("Roger Federer", 8),
        ("Rafael Nadal", 3),
        ("Stan Wawrinka", 2),
        ("Kei Nishikori", 1),
        ("Andy Murray", 1),
    ]
    assert rows(q.overall_winner(tour)) == [(1, "Novak Djokovic", 18)]


def test_repeat_pairs(tour):
    assert rows(q.repeat_pairs(tour)) == [(1, "Novak Djokovic", 3, "Roger Federer", 2)]


def test_winners_and_losers(tour):
    winners = {1, 3, 7, 11, 15, 17}
    assert {r[0] for r in rows(q.ever_won(tour))} == winners
    assert {r[0] for r in rows(q.ever_lost(tour))} == {1, 3, 5, 7, 11, 15, 17, 19}
    assert {r[0] for r in rows(q.won_and_lost(tour))} == winners
    assert names(q.never_won(tour)) == ["David Ferrer", "Tomas Berdych"]
    assert rows(q.never_lost(tour)) == []


def test_win_counts(tour):
    assert dict(rows(q.win_counts(tour).select("name", "wins"))) == {
        "Novak Djokovic": 4,
        "Roger Federer": 4,
        "Rafael Nadal": 3,
        "Stan Wawrinka": 2,
        "Andy Murray": 1,
        "Kei Nishikori": 1,
    }
    assert names(q.win_counts_top(tour)) == ["Novak Djokovic", "Roger Federer", "Rafael Nadal"]


def test_edge_style(tour):
    styles = {
        (r["label"], r["color"], r["pen_width"]) for r in q.edge_style(tour).collect()
    }
    assert styles == {
        ("G1 (1 pts)", "#388E3C", 1),
        ("G2 (1 pts)", "#388E3C", 1),
        ("S (5 pts)", "#F57C00", 2),
        ("F (11 pts)", "#D32F2F", 3),
    }


def test_triplets_keep_edges_of_unknown_players(spark, tour):
    stray = spark.createDataFrame(
        [("x", 1, 99, "G1", 1, 1)],
        "match_id string, src long, dst long, match_type string, points int, head2head int",
    )
    graph = PropertyGraph(tour.vertices, tour.edges.union(stray))
    last = graph.triplets().filter("dst = 99").first()
    assert (last["src_name"], last["dst_name"]) == ("Novak Djokovic", None)
    assert graph.triplets().count() == 16


def test_subgraph_keeps_touched_vertices(tour):
    part = tour.subgraph(tour.edges["match_type"] == "S")
    assert part.edges.count() == 2
    assert {r["id"] for r in part.vertices.collect()} == {1, 3, 15, 17}


def test_reverse_and_degrees(tour):
    assert sorted(rows(tour.reverse().degrees("src", "n"))) == sorted(
        rows(tour.degrees("dst", "n"))
    )
    assert endpoint_ids(tour.edges).count() == 8


# Ranks of the reversed tournament at tolerance 0.001 and in the limit.
AT_0_001 = {
    1: 3.38239885,
    3: 3.26566698,
    17: 0.39139511,
    15: 0.27466323,
    7: 0.19274613,
    11: 0.19274613,
    5: 0.15019179,
    19: 0.15019179,
}
CONVERGED = {
    1: 3.3831875,
    3: 3.2666046875,
    17: 0.3908953125,
    15: 0.2743125,
    7: 0.1925,
    11: 0.1925,
    5: 0.15,
    19: 0.15,
}


@pytest.mark.parametrize(
    "tol, expected, within", [(1e-3, AT_0_001, 1e-8), (1e-4, CONVERGED, 2e-3)]
)
def test_pagerank_golden(tour, tol, expected, within):
    found = dict(rows(pagerank(tour.reverse(), tol)))
    assert found == pytest.approx(expected, abs=within)
    assert sum(found.values()) == pytest.approx(8)


def test_pagerank_top(tour):
    assert names(q.pagerank_top(tour)) == ["Novak Djokovic", "Roger Federer", "Rafael Nadal"]


def test_group_stage_components(tour):
    groups = connected_groups(tour.edges.filter("match_type in ('G1', 'G2')"))
    assert dict(rows(groups)) == {1: 1, 3: 1, 5: 1, 7: 1, 11: 11, 15: 11, 17: 11, 19: 11}
