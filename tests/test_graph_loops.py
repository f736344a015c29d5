"""Iterative operators against plain Python, with and without hubs."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow as pa
import pytest
from conftest import rows

from matchbook import runtime
from matchbook.operators import components
from matchbook.operators.components import connected_groups
from matchbook.operators.graph import PropertyGraph
from matchbook.operators.pagerank import pagerank
from matchbook.plans import season

HUB_SETTINGS = [{}, {"hub_share": 0.05, "hub_floor": 0}]


def brute_groups(edges):
    above = {}

    def top(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        above[high] = low
    return {x: top(x) for x in list(above)}


def brute_pagerank(ids, edges, tol, max_rounds=None):
    weight = Counter(edges)
    out = Counter()
    for (src, _), w in weight.items():
        out[src] += w
    rank = dict.fromkeys(ids, 0.15)
    delta = dict(rank)
    done = 0
    while any(d > tol for d in delta.values()) and done != max_rounds:
        gain = defaultdict(float)
        for (src, dst), w in weight.items():
            if delta[src] > tol:
                gain[dst] += 0.85 * delta[src] * w / out[src]
        delta = {i: gain.get(i, 0.0) for i in ids}
        rank = {i: rank[i] + delta[i] for i in ids}
        done += 1
    return rank


def random_edges(n, m, seed, hub_every=3):
    """Parallel edges and self-loops included; a third of the edges leave id 0."""
    draw = random.Random(seed)
    return [
        (0 if i % hub_every == 0 else draw.randrange(n), draw.randrange(n)) for i in range(m)
    ]


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


@pytest.mark.parametrize("options", HUB_SETTINGS)
@pytest.mark.parametrize("hub_every", [3, 10_000])
def test_groups_match_union_find(spark, options, hub_every):
    edges = random_edges(300, 170, 5, hub_every)
    found = dict(rows(connected_groups(frame(spark, edges), **options)))
    assert found == brute_groups(edges)


def test_groups_within_scope(spark):
    edges = [("a", 1, 2), ("a", 2, 3), ("b", 2, 4), ("b", 7, 7), ("c", 9, 3), ("c", 4, 9)]
    df = spark.createDataFrame(edges, "event string, src long, dst long")
    assert sorted(rows(connected_groups(df, ["event"]))) == [
        ("a", 1, 1),
        ("a", 2, 1),
        ("a", 3, 1),
        ("b", 2, 2),
        ("b", 4, 2),
        ("b", 7, 7),
        ("c", 3, 3),
        ("c", 4, 3),
        ("c", 9, 3),
    ]


def scoped_edges(scopes=6, n=120, m=90):
    return [(f"e{s}", *edge) for s in range(scopes) for edge in random_edges(n, m, s, 10_000)]


def brute_scoped(edges):
    wanted = []
    for scope in {e[0] for e in edges}:
        found = brute_groups([(a, b) for s, a, b in edges if s == scope])
        wanted += [(scope, i, group) for i, group in found.items()]
    return sorted(wanted)


def test_whole_scopes_need_no_rounds(spark, monkeypatch):
    """Each scope is contracted where its links meet; no round passes over them again."""
    monkeypatch.setattr(components, "_raise", None)
    edges = scoped_edges()
    df = spark.createDataFrame(edges, "event string, src long, dst long")
    assert sorted(rows(connected_groups(df, ["event"]))) == brute_scoped(edges)


@pytest.mark.parametrize("chunk", [1, 7, 100])
def test_scopes_cut_in_chunks(spark, chunk):
    """Scopes larger than a chunk, and one far larger than the others."""
    edges = scoped_edges() + [("hot", *e) for e in random_edges(400, 600, 9)]
    df = spark.createDataFrame(edges, "event string, src long, dst long")
    assert sorted(rows(connected_groups(df, ["event"], chunk=chunk))) == brute_scoped(edges)


def test_long_chain_needs_few_rounds(spark, monkeypatch):
    n = 1000
    order = list(range(n))
    random.Random(2).shuffle(order)
    cuts = []
    settle = components.cut
    monkeypatch.setattr(components, "cut", lambda df, **m: cuts.append(1) or settle(df, **m))
    found = connected_groups(frame(spark, list(zip(order, order[1:], strict=False))))
    assert {r[1] for r in rows(found)} == {0}
    assert len(cuts) < 30


def test_groups_of_text_ids_and_no_edges(spark):
    df = spark.createDataFrame([("b", "c"), ("c", "a"), (None, "z")], "src string, dst string")
    assert dict(rows(connected_groups(df))) == {"a": "a", "b": "a", "c": "a"}
    assert rows(connected_groups(df.filter("src = 'none'"))) == []


@pytest.mark.parametrize("options", HUB_SETTINGS)
def test_pagerank_matches_brute_force(spark, options):
    edges = random_edges(60, 400, 9)
    ids = list(range(65))
    graph = PropertyGraph(spark.createDataFrame([(i,) for i in ids], "id long"), frame(spark, edges))
    found = dict(rows(pagerank(graph, tol=1e-4, normalise=False, **options)))
    assert found == pytest.approx(brute_pagerank(ids, edges, 1e-4), abs=1e-12)
    fixed = dict(rows(pagerank(graph, tol=0.0, max_rounds=4, normalise=False, **options)))
    assert fixed == pytest.approx(brute_pagerank(ids, edges, 0.0, 4), abs=1e-12)


def test_pagerank_ranks_sum_to_vertices(spark):
    edges = random_edges(40, 200, 1)
    graph = PropertyGraph(spark.createDataFrame([(i,) for i in range(40)], "id long"), frame(spark, edges))
    assert sum(dict(rows(pagerank(graph))).values()) == pytest.approx(40)


def test_pagerank_without_edges(spark):
    graph = PropertyGraph(spark.createDataFrame([(1,), (2,)], "id long"), frame(spark, []))
    assert dict(rows(pagerank(graph))) == {1: 1.0, 2: 1.0}


@pytest.mark.parametrize("rounds_per_cut", [1, 3])
def test_rounds_of_a_job_change_no_rank(spark, rounds_per_cut):
    edges = random_edges(30, 120, 4)
    ids = list(range(30))
    graph = PropertyGraph(spark.createDataFrame([(i,) for i in ids], "id long"), frame(spark, edges))
    options = {"normalise": False, "rounds_per_cut": rounds_per_cut}
    found = dict(rows(pagerank(graph, tol=1e-2, **options)))
    assert found == pytest.approx(brute_pagerank(ids, edges, 1e-2), abs=1e-12)
    fixed = dict(rows(pagerank(graph, tol=0.0, max_rounds=4, **options)))
    assert fixed == pytest.approx(brute_pagerank(ids, edges, 0.0, 4), abs=1e-12)


def test_loops_run_few_jobs_and_leave_the_settings(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    edges = random_edges(30, 120, 4)
    graph = PropertyGraph(spark.createDataFrame([(i,) for i in range(30)], "id long"), frame(spark, edges))
    spark.sparkContext.setJobGroup("loops", "loops")
    pagerank(graph, tol=0.0, max_rounds=20)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("loops"))
    spark.sparkContext.setJobGroup("others", "others")
    # A job for two rounds, and those that lay out links and state.
    assert jobs <= 20
    assert spark.conf.get("spark.sql.adaptive.enabled") == before


def odd_scoped_edges(seed=4):
    """Scopes with nulls and without, ends that are null, edges that come twice."""
    draw = random.Random(seed)
    ends = [None, *(f"p{i}" for i in range(25))]
    edges = [
        (draw.choice(["a", "b", "c", None]), draw.choice([1, 2, None]), draw.choice(ends), draw.choice(ends))
        for _ in range(150)
    ]
    hot = [("hot", 1, draw.choice(ends), draw.choice(ends)) for _ in range(80)]
    return edges + edges[:30] + hot


def brute_with_wins(edges):
    wins = Counter((e[0], e[1], e[2]) for e in edges if None not in e[:3])
    found = set()
    for scope in {e[:2] for e in edges}:
        met = [e[2:] for e in edges if e[:2] == scope and None not in e[2:]]
        if None in scope:
            met = [(x, x) for e in met for x in e]
        found |= {(*scope, i, top, wins[(*scope, i)]) for i, top in brute_groups(met).items()}
    return found


@pytest.mark.parametrize("chunk", [9, 10_000])
def test_wins_come_with_the_groups(spark, chunk):
    """Of whole scopes and of scopes that go through the rounds; null scopes join up nothing."""
    edges = odd_scoped_edges()
    df = spark.createDataFrame(edges, "event string, year int, src string, dst string")
    found = rows(connected_groups(df, ["event", "year"], chunk=chunk, wins="wins"))
    assert len(found) == len(set(found)) and set(found) == brute_with_wins(edges)
    plain = rows(connected_groups(df, ["event", "year"], chunk=chunk))
    assert sorted(map(str, plain)) == sorted(str(row[:4]) for row in found)


def test_scopes_are_kept_whole_across_batches():
    tables = [pa.record_batch({"deal": pa.array([k] * 4), "at": pa.array(range(4))}) for k in (1, 1, 1, 2, 2, 3)]
    cuts = [t.column(0).to_pylist() for t in components._chunks(iter(tables), 5, whole=True)]
    assert sum(cuts, []) == [1] * 12 + [2] * 8 + [3] * 4
    for before, after in zip(cuts, cuts[1:], strict=False):
        assert before[-1] != after[0]


@pytest.mark.parametrize("winless", [True, False])
def test_checkpoints_of_scoped_groups_are_small(spark, monkeypatch, winless):
    """Bytes that all cuts of a run leave in the checkpoint folder, for each edge."""
    kept = []
    settle = runtime.cut

    def folders():
        top = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
        return set(top.glob("rdd-*"))

    def cut(df, **metrics):
        runtime.ensure_checkpoint_dir(spark)
        before = folders()
        settled = settle(df, **metrics)
        kept.extend(p.stat().st_size for new in folders() - before for p in new.glob("part-*"))
        return settled

    for module in (runtime, components, season):
        monkeypatch.setattr(module, "cut", cut)
    n = 20_000
    matches = spark.range(n).selectExpr(
        "concat('Event of the week ', id % 40) as tournament", "2020 as year", "'Round Robin' as round",
        "concat('S', id % 1000) as src", "concat('C', id * 7 % 9000) as dst",
    )
    players = spark.range(9000).selectExpr(
        "explode(array(concat('S', id), concat('C', id))) as id", "'a' as full_name", "'b' as nationality"
    )
    qualified = season.group_qualifiers(PropertyGraph(players, matches), winless=winless).count()
    assert qualified > 0 and 0 < sum(kept) < 30 * n
