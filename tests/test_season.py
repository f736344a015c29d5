import datetime

import pytest
from conftest import rows

from matchbook.operators.graph import PropertyGraph
from matchbook.plans import season
from matchbook.sources import (
    MATCH_SCHEMA,
    PLAYER_SCHEMA,
    TOURNAMENT_SCHEMA,
    match_fact,
    player_dim,
    read_csv_table,
    tournament_dim,
)

FINALS = "World Finals"


def csv(path, columns, records):
    lines = [",".join(columns)]
    lines += [",".join(str(r.get(c, "")) for c in columns) for r in records]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def player(pid, first, last, flag, born="1990.05.01"):
    return dict(player_id=pid, first_name=first, last_name=last, flag_code=flag, birthdate=born)


def match(n, winner, loser, name=FINALS, rnd="Round Robin Day 1", order=1, start="2020.11.15"):
    return dict(
        match_id=f"m{n:02d}",
        tourn_name=name,
        tourn_start_date=start,
        tourn_round=rnd,
        tourn_round_order=order,
        winner_id=winner,
        loser_id=loser,
        winner_sets=2,
        loser_sets=1,
        match_score='"6-4, 6-3"',
    )


PLAYERS = [
    player("a1", "Ann", "Ash", "AAA"),
    player("a2", "Bea", "Bay", "AAA"),
    player("a3", "Cat", "Cox", "BBB"),
    player("a4", "", "Dee", "BBB", born="unknown"),
    player("b1", "Eve", "Elm", "CCC"),
    player("b2", "Fay", "Fox", "CCC"),
    player("b3", "Gia", "Gum", "CCC"),
    player("b4", "Hal", "Hay", "DDD"),
    player("b4", "Hal", "Hay", "DDD"),
    player("z9", "Ida", "Ivy", "DDD"),
    player("z9", "Ida", "Ivy", "EEE"),
]

MATCHES = [
    match(1, "a1", "a2"),
    match(2, "a1", "a3"),
    match(3, "a1", "a4"),
    match(4, "a2", "a3"),
    match(5, "a2", "a4", rnd="Round Robin Day 2"),
    match(6, "a3", "a4", rnd="Round Robin Day 3"),
    match(7, "b2", "b1"),
    match(8, "b2", "b3", name="WORLD FINALS"),
    match(9, "b2", "b4"),
    match(10, "a1", "b4", rnd="Semi-Finals", order=2),
    match(11, "b2", "a2", rnd="Semi-Finals", order=2),
    match(12, "a1", "b2", rnd="Finals", order=3),
    match(13, "a1", "ghost", name="City Open", rnd="Finals", start="2021.02.01"),
    match(14, "b1", "a1", name="City Open", rnd="Finals", start="2020.02.01"),
    match(15, "a1", "a2", name="City Open", start="2019.02.01"),
    match(16, "a1", "a2", name="City Open", start=""),
    match(17, "a1", "a2", name="City Open", start="2020-02-01"),
    match(18, "a4", "b3", name="Town Cup", rnd="Finals", start="2022.06.01"),
]


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("season")
    # The column order of the files differs from the declared one.
    players = read_csv_table(
        spark, csv(folder / "players.csv", list(reversed(PLAYER_SCHEMA)), PLAYERS), PLAYER_SCHEMA
    )
    matches = read_csv_table(
        spark, csv(folder / "matches.csv", list(MATCH_SCHEMA), MATCHES), MATCH_SCHEMA
    )
    return season.season_graph(player_dim(players), match_fact(matches))


def tournament(tid, name, kind, year, winner="", pid="", slug=""):
    return dict(
        tourn_id=tid,
        tourn_name=name,
        tourn_type=kind,
        tourn_location=slug,
        tourn_start_year=year,
        tourn_winner=winner,
        winner_id=pid,
    )


# Titles of one year by winner, the number of each category.
TITLES_2020 = {
    ("d643", "Novak Djokovic"): {"Grand Slam": 1, "Masters 1000": 2, "ATP 500": 1},
    ("re44", "Andrey Rublev"): {"ATP 500": 3},
    ("n409", "Rafael Nadal"): {"Grand Slam": 1, "ATP 500": 1},
    ("gd64", "Cristian Garin"): {"ATP 500": 1},
    ("mc65", "Gael Monfils"): {"ATP 500": 1},
    ("mm58", "Daniil Medvedev"): {"Masters 1000": 1},
    ("tb69", "Dominic Thiem"): {"Grand Slam": 1},
}


@pytest.fixture(scope="module")
def tournaments(spark, tmp_path_factory):
    records = []
    for (pid, name), kinds in TITLES_2020.items():
        for kind, n in kinds.items():
            for _ in range(n):
                tid = len(records) + 1
                records.append(tournament(tid, f"Event {tid}", kind, 2020, name, pid))
    records += [
        tournament(90, "Small Cup", "ATP 250", 2020, "Novak Djokovic", "d643"),
        tournament(91, "Undecided", "Grand Slam", 2020),
        tournament(92, "Earlier", "Grand Slam", 2019, "Novak Djokovic", "d643"),
        tournament(93, "City Open", "ATP 500", 2020, "", "b1", "city-open"),
        tournament(94, "City Open", "ATP 250", 2021, "Ann Ash", "a1", "city-open"),
        tournament(95, "\"Town, Cup\"", "ATP 250", 2022, "Dee", "a4", "town cup"),
        tournament(96, "World Finals", "", 2020, "Ann Ash", "a1"),
    ]
    path = csv(tmp_path_factory.mktemp("tour") / "t.csv", list(TOURNAMENT_SCHEMA), records)
    return read_csv_table(spark, path, TOURNAMENT_SCHEMA)


def test_players(graph):
    found = {(r["id"], r["full_name"], r["nationality"]) for r in graph.vertices.collect()}
    assert ("a4", "Dee", "BBB") in found
    assert {("z9", "Ida Ivy", "DDD"), ("z9", "Ida Ivy", "EEE")} <= found
    assert graph.vertices.count() == 10


def test_one_row_per_player_when_asked(spark):
    raw = spark.createDataFrame(
        [(p["player_id"], p["first_name"] or None, p["last_name"], p["flag_code"]) for p in PLAYERS],
        "player_id string, first_name string, last_name string, nationality string",
    )
    found = season.player_vertices(raw, one_row_per_id=True)
    assert found.count() == 9
    assert found.filter("id = 'z9'").first()["nationality"] == "DDD"


def test_dates(spark, graph):
    raw = spark.createDataFrame(
        [("1990.05.01",), ("unknown",), ("1990-05-01",), (None,)], "birthdate string"
    )
    from matchbook.functions.columns import date_from_text

    found = [r[0] for r in raw.select(date_from_text("birthdate")).collect()]
    assert found == [datetime.date(1990, 5, 1), None, None, None]


def test_edges_stay_within_the_years(graph):
    assert {r["match_id"] for r in graph.edges.select("match_id").collect()} == {
        f"m{n:02d}" for n in [*range(1, 15), 18]
    }
    assert graph.edges.filter("match_id = 'm01'").first()["match_score"] == "6-4, 6-3"


def test_counts(graph):
    assert rows(season.edges_by_year(graph)) == [(2020, 13), (2021, 1), (2022, 1)]
    assert rows(season.edges_by_tournament(graph, 2)) == [(FINALS, 11), ("City Open", 2)]
    assert rows(season.vertices_by_country(graph))[0] == ("CCC", 3)


def test_tournament_results(graph):
    found = season.tournament_results(graph, "  world FINALS ", 2020)
    assert found.count() == 12
    assert [r["round_order"] for r in found.collect()] == [1] * 9 + [2, 2, 3]
    assert found.collect()[-1]["winner"] == "Ann Ash"
    stranger = season.tournament_results(graph, "city open", 2021).first()
    assert (stranger["winner"], stranger["loser"]) == ("Ann Ash", None)
    assert season.tournament_results(graph, "no such", 2020).count() == 0


def test_event_subgraph(graph):
    finals = season.one_event(graph, FINALS, 2020)
    assert finals.edges.count() == 12
    assert finals.vertices.count() == 8


def test_round_robin_groups(graph):
    finals = season.one_event(graph, FINALS, 2020)
    # One match spells the name in capitals: it belongs to the same event.
    found = season.round_robin_groups(finals)
    assert {(r["id"], r["group_id"]) for r in found.collect()} == {
        ("a1", "a1"),
        ("a2", "a1"),
        ("a3", "a1"),
        ("a4", "a1"),
        ("b1", "b1"),
        ("b2", "b1"),
        ("b3", "b1"),
        ("b4", "b1"),
    }


def test_qualifiers(graph):
    def places(df):
        return {
            (r["group_id"], r["rank"], r["id"], r["wins"])
            for r in df.filter(f"tournament = '{FINALS.lower()}'").collect()
        }

    with_winless = places(season.group_qualifiers(graph))
    assert with_winless == {
        ("a1", 1, "a1", 3),
        ("a1", 2, "a2", 2),
        ("b1", 1, "b2", 3),
        ("b1", 2, "b1", 0),
    }
    assert places(season.group_qualifiers(graph, winless=False)) == {
        place for place in with_winless if place[3]
    }


def test_qualifiers_with_strangers_and_namesakes(spark, monkeypatch):
    """A player without a name takes no place; an id with two names takes two."""
    won = {"x": 4, "a": 3, "b": 2, "c": 1}
    matches = [("Cup", 2020, "Round Robin", w, "d") for w, n in won.items() for _ in range(n)]
    matches += [("Open", 2020, "Round Robin", "b", "x")]
    names = [("a", "Ann"), ("b", "Bea"), ("b", "Bee"), ("c", "Cat"), ("d", "Dee")]
    graph = PropertyGraph(
        spark.createDataFrame([(*n, "AAA") for n in names], "id string, full_name string, nationality string"),
        spark.createDataFrame(
            matches, "tournament string, year int, round string, src string, dst string"
        ),
    )
    expected = [("cup", "a", 3, 1), ("cup", "b", 2, 2), ("open", "b", 1, 1), ("open", "b", 1, 2)]
    for few in (season.FEW_IDS, 0):
        monkeypatch.setattr(season, "FEW_IDS", few)
        found = season.group_qualifiers(graph)
        assert sorted(rows(found.select("tournament", "id", "wins", "rank"))) == expected
        assert {r["group_id"] for r in found.collect()} == {"a", "b"}
        # All places are held by winners, so they are the same without the winless.
        found = season.group_qualifiers(graph, winless=False)
        assert sorted(rows(found.select("tournament", "id", "wins", "rank"))) == expected


def test_names_are_looked_up_for_the_best_only(spark, graph):
    """The cut to ``k`` players of a group stands below the join with the names."""
    plan = season.group_qualifiers(graph)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number") >= 2 and "full_name" not in plan[plan.rindex("Window ["):].split("MapInArrow")[0]


def test_important_matches(graph, tournaments):
    def ids(**options):
        found = season.important_matches(graph, tournaments, **options)
        return {r["match_id"] for r in found.edges.collect()}

    assert ids() == {"m13", "m14"}
    assert ids(same_year=True) == {"m14"}
    assert ids(categories=["ATP 250"], name_col="tourn_location") == {"m18"}
    important = season.important_matches(graph, tournaments)
    assert {r["id"] for r in important.vertices.collect()} == {"a1", "b1"}
    assert rows(season.important_match_counts(important)) == [("City Open", 2)]


def test_top_by_titles(tournaments):
    found = season.top_by_titles(tournament_dim(tournaments), 2020)
    assert rows(found.select("rank", "winner_id", "titles").orderBy("rank")) == [
        (1, "d643", 4),
        (2, "re44", 3),
        (3, "n409", 2),
        (4, "gd64", 1),
        (5, "mc65", 1),
        (6, "mm58", 1),
        (7, "tb69", 1),
    ]


def test_top_by_points(tournaments):
    found = season.top_by_points(tournaments, 2020)
    assert rows(found.select("winner_id", "total_points").orderBy("rank")) == [
        ("d643", 225),
        ("n409", 125),
        ("tb69", 100),
        ("re44", 75),
        ("mm58", 50),
        ("gd64", 25),
        ("mc65", 25),
    ]
    detail = season.top_detail(tournaments, 2020, 2)
    assert [(r["rank"], r["points"]) for r in detail.collect()] == [
        (1, 100),
        (1, 50),
        (1, 50),
        (1, 25),
        (2, 100),
        (2, 25),
    ]


def test_csv_quotes_and_blanks(tournaments):
    quoted = tournaments.filter("tourn_id = 95").first()
    assert quoted["tourn_name"] == "Town, Cup"
    assert tournaments.filter("tourn_id = 96").first()["tourn_type"] is None
