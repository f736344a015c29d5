"""Connected groups by alternating star contraction.

The method is that of Kiveris, Lattanzi, Mirrokni, Rastogi and Vassilvitskii,
"Connected Components in MapReduce and Beyond" (2014): links are re-hung on ever
smaller neighbours until each group is one star around its smallest id. The
number of rounds grows with the logarithm of the group size, not with the
diameter, and the number of links never grows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from matchbook.operators.graph import endpoint_ids
from matchbook.operators.hubs import HUB_FLOOR, HUB_SHARE, hub_join, hub_threshold
from matchbook.runtime import cut, cut_batches, fixed_plans, let_go

#: Links that a task contracts at a time. A scope with more goes through the rounds.
CHUNK = 1_000_000


def connected_groups(
    edges: DataFrame,
    scope: Sequence[str] = (),
    hub_share: float = HUB_SHARE,
    hub_floor: int = HUB_FLOOR,
    chunk: int = CHUNK,
    wins: str | None = None,
) -> DataFrame:
    """Group of every id that an edge touches: ``(*scope, id, group_id)``.

    ``group_id`` is the smallest id of the group. With ``scope`` columns, ids are
    joined up only by edges of the same scope, for all scopes in one run; where one of
    these is null, every id is a group of its own. ``wins`` names one more column, the
    number of edges of the scope that leave the id (none without a scope).

    The edges of a scope meet in one task, which makes each group a star around its
    smallest id. Only scopes of more than ``chunk`` edges go through the rounds; a count of
    the edges ahead tells which.
    """
    scope = list(scope)
    ends = F.array("src", "dst")  # of one type
    edges = edges.select(*scope, ends[0].alias("src"), ends[1].alias("dst")).filter(
        F.col("src").isNotNull() if wins else F.col("src").isNotNull() & F.col("dst").isNotNull()
    )
    if not scope:
        return _with_wins(_by_rounds(edges, scope, hub_share, hub_floor, chunk), edges, scope, wins)
    unscoped = F.lit(False)
    for name in scope:
        unscoped = unscoped | F.col(name).isNull()
    apart, seen = cut(
        edges.groupBy(*scope)
        .agg(F.count(F.lit(1)).alias("links"))
        .select(*scope, unscoped.alias("unscoped"), (F.col("links") > chunk).alias("large"))
        .filter("unscoped or large"),
        unscoped=F.count_if("unscoped"),
        large=F.count_if(~F.col("unscoped")),
    )
    let_go(edges.sparkSession)
    whole = edges.filter(~unscoped)
    # Each of these has more than a chunk of the edges, so there are few.
    large = F.broadcast(apart.filter(~F.col("unscoped")).select(*scope))
    if seen["large"]:
        whole = whole.join(large, scope, "left_anti")
    groups = _of_whole_scopes(whole, scope, chunk, wins)
    let_go(edges.sparkSession)
    if seen["large"]:
        hot = edges.join(large, scope, "left_semi")
        found = _by_rounds(hot, scope, hub_share, hub_floor, chunk)
        # Kept like the others, so that what reads the groups twice looks nothing up again.
        found = _with_wins(found, hot, scope, wins).select(*groups.columns)
        groups = groups.unionByName(cut_batches(found, lambda batches: batches, groups.schema))
        let_go(edges.sparkSession)
    if seen["unscoped"]:
        met = edges.filter(unscoped & F.col("dst").isNotNull())
        alone = endpoint_ids(met, scope).withColumn("group_id", F.col("id"))
        if wins:
            alone = alone.withColumn(wins, F.lit(0).cast("bigint"))
        groups = groups.unionByName(alone)
    return groups


def _with_wins(
    groups: DataFrame, edges: DataFrame, scope: list[str], wins: str | None
) -> DataFrame:
    if not wins:
        return groups
    won = edges.groupBy(*scope, F.col("src").alias("id")).agg(F.count(F.lit(1)).alias(wins))
    return groups.join(won, [*scope, "id"], "left").fillna(0, [wins])


def _of_whole_scopes(
    edges: DataFrame, scope: list[str], chunk: int, wins: str | None
) -> DataFrame:
    """Groups of scopes that each meet in one task: one shuffle, and compressed rows kept."""
    types = {field.name: field.dataType for field in edges.schema}
    types |= {"id": types["src"], "group_id": types["src"], wins or "wins": LongType()}
    names = [*scope, "id", "group_id", *([wins] if wins else [])]

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for links in _chunks(batches, chunk, whole=True):
            arrays = _members(links, scope)
            yield pa.RecordBatch.from_arrays(arrays[: len(names)], names)

    dealt = edges.select(F.xxhash64(*scope).alias("deal"), *edges.columns)
    dealt = dealt.repartition("deal").sortWithinPartitions("deal")
    schema = StructType([StructField(name, types[name]) for name in names])
    return cut_batches(dealt, members, schema)


def _members(links: pa.Table, scope: list[str]) -> list[pa.Array]:
    """The columns of ``scope``, each id with the smallest of its group, the edges that leave it.

    Rows without ``dst`` join up nothing but count for an id that others touch.
    """
    ends = pa.chunked_array([*links["src"].chunks, *links["dst"].chunks], links["src"].type)
    ids = ends.combine_chunks().dictionary_encode()
    order = pc.sort_indices(ids.dictionary)
    names, n = ids.dictionary.take(order), len(order)
    rank = np.empty(n, np.int64)
    rank[order.to_numpy()] = np.arange(n)
    event = np.zeros(links.num_rows, np.int64)
    for name in scope:
        codes = links[name].combine_chunks().dictionary_encode()
        event = event * len(codes.dictionary) + codes.indices.to_numpy()
        _, at, event = np.unique(event, return_index=True, return_inverse=True)
    # An id is another node in each scope, and keeps its order there.
    keys = event * n + rank[ids.indices.fill_null(0).to_numpy()].reshape(2, -1)
    met = links["dst"].is_valid().to_numpy()
    nodes, joined = np.unique(keys[:, met], return_inverse=True)
    joined = joined.reshape(2, -1)
    wins = np.bincount(joined[0], minlength=len(nodes))
    won = np.searchsorted(nodes, lone := keys[0, ~met])
    known = won < len(nodes)
    known[known] = nodes[won[known]] == lone[known]
    wins += np.bincount(won[known], minlength=len(nodes))
    rows = pa.array(at[nodes // max(n, 1)])
    return [
        *(links[name].combine_chunks().take(rows) for name in scope),
        names.take(pa.array(nodes % max(n, 1))),
        names.take(pa.array(nodes[_roots(joined, len(nodes))] % max(n, 1))),
        pa.array(wins, pa.int64()),
    ]


def _by_rounds(
    edges: DataFrame, scope: list[str], hub_share: float, hub_floor: int, chunk: int
) -> DataFrame:
    """Groups of links that may be more than a task can hold.

    Ids are numbered once, so that the rounds move pairs of longs only. No key that is
    shuffled there is large, so a half round is one job without adaptive execution. The
    links of a scope are contracted ahead of the rounds, a chunk of them at a time; these
    are left with what a scope has in several tasks or chunks.
    """
    met, seen = cut(
        edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
        .select(*scope, F.least("src", "dst").alias("id"), F.greatest("src", "dst").alias("id_2"))
        .distinct(),
        pairs=F.count(F.lit(1)),
    )
    threshold = _threshold(2 * seen["pairs"], hub_share, hub_floor)
    # The checkpoint fixes the numbers: a lost task cannot number its ids anew.
    members, _ = cut(
        met.select(*scope, F.explode(F.array("id", "id_2")).alias("id"))
        .groupBy(*scope, "id")
        .agg(F.count(F.lit(1)).alias("fan"))
        .withColumn("key", F.monotonically_increasing_id())
    )
    let_go(edges.sparkSession)
    half = _lookup(met.filter(F.col("id") != F.col("id_2")), members, [*scope, "id"], threshold)
    half = half.select(*scope, F.col("id_2").alias("id"), F.col("key").alias("key_1"))
    keyed = _lookup(half, members, [*scope, "id"], threshold)
    ends = F.greatest("key", "key_1").alias("node"), F.least("key", "key_1").alias("low")
    if scope:
        links, seen = cut(
            _contracted(keyed.select(F.xxhash64(*scope).alias("scope"), *ends), chunk),
            links=F.count(F.lit(1)),
            pieces=F.count_if("first"),
        )
        moving = seen["pieces"] > links.select("scope").distinct().count()
        links = links.select("node", "low")
    else:
        links, seen = cut(keyed.select(*ends), links=F.count(F.lit(1)))
        moving = seen["links"] > 0
    n_links, forest = seen["links"], False
    del met, half, keyed  # their checkpoint goes with them
    let_go(edges.sparkSession)
    with fixed_plans(edges.sparkSession):
        while moving:
            threshold = _threshold(2 * n_links, hub_share, hub_floor)
            links, seen = cut(_raise(links, threshold), moved=F.count_if("moved"))
            links, moving = links.drop("moved"), seen["moved"] > 0
            if not forest:
                links, seen = cut(
                    _merge(links, threshold), links=F.count(F.lit(1)), moved=F.count_if("moved")
                )
                links, n_links = links.drop("moved"), seen["links"]
                # Once each node has one lower neighbour, raising keeps it so.
                forest = seen["moved"] == 0
                moving = moving or not forest

        labels = links.select(F.col("node").alias("key"), F.col("low").alias("root"))
        placed, _ = cut(
            members.join(labels, "key", "left").select(
                *scope, "id", F.coalesce("root", "key").alias("root")
            )
        )
    let_go(edges.sparkSession)
    groups = placed.groupBy("root").agg(
        F.min("id").alias("group_id"), F.count(F.lit(1)).alias("fan")
    )
    threshold = _threshold(2 * n_links, hub_share, hub_floor)
    return _lookup(placed, groups, ["root"], threshold).select(*scope, "id", "group_id")


def _contracted(links: DataFrame, chunk: int) -> DataFrame:
    """``scope, node, low, first`` with the links of each scope as stars ``node, low``.

    ``first`` marks a row of each scope and chunk: a scope with one such row is done.
    Adaptive execution splits a partition that is too large; what is apart then stays
    linked through the nodes it shares, and so does what is in two chunks.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for links in _chunks(batches, chunk):
            columns = [column.to_numpy() for column in links.columns]
            arrays = [pa.array(column) for column in _stars(*columns)]
            yield pa.RecordBatch.from_arrays(arrays, ["scope", "node", "low", "first"])

    dealt = links.hint("rebalance", "scope").sortWithinPartitions("scope")
    return dealt.mapInArrow(stars, "scope long, node long, low long, first boolean")


def _chunks(
    batches: Iterator[pa.RecordBatch], chunk: int, whole: bool = False
) -> Iterator[pa.Table]:
    """Rows sorted by the first column, cut where it changes if it does in a chunk.

    With ``whole`` they are cut nowhere else.
    """
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < chunk:
            continue
        joined = pa.Table.from_batches(held)
        first = joined.column(0).to_numpy()
        # The last value may go on in the next batch.
        end = int(np.searchsorted(first, first[-1])) or (0 if whole else rows)
        if end:
            yield joined.slice(0, end)
            held, rows = joined.slice(end).to_batches(), rows - end
    if rows:
        yield pa.Table.from_batches(held)


def _stars(scope: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each node but the smallest of its group with its scope and that one; first of a scope."""
    nodes, met_at, ends = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
    root = _roots(ends.reshape(2, -1), len(nodes))
    hung = root != np.arange(len(nodes))
    scopes = scope[met_at[hung] % len(scope)]
    first = np.zeros(len(scopes), bool)
    first[np.unique(scopes, return_index=True)[1]] = True
    return scopes, nodes[hung], nodes[root[hung]], first


def _roots(ends: np.ndarray, n: int) -> np.ndarray:
    """The smallest of its group for each of ``n`` nodes, given the two ends of the links.

    Roots are hung on the smallest root they are linked to, and paths cut short, until no
    link joins two groups.
    """
    root = np.arange(n)
    while ends.shape[1]:
        np.minimum.at(root, ends.max(axis=0), ends.min(axis=0))
        while (root != (up := root[root])).any():
            root = up
        ends = root[ends]
        ends = ends[:, ends[0] != ends[1]]
    return root


def _raise(links: DataFrame, threshold: float | None) -> DataFrame:
    """Hang each node on the smallest id its lower neighbour can see."""
    ends = F.explode(
        F.array(
            F.struct(F.col("low").alias("at"), F.col("node").alias("peer")),
            F.struct(F.col("node").alias("at"), F.col("low").alias("peer")),
        )
    ).alias("end")
    nearest = (
        links.select(ends)
        .groupBy(F.col("end.at").alias("low"))
        .agg(F.least(F.col("end.at"), F.min("end.peer")).alias("root"), F.count(F.lit(1)).alias("fan"))
    )
    return _lookup(links, nearest, ["low"], threshold).select(
        "node", F.col("root").alias("low"), (F.col("root") != F.col("low")).alias("moved")
    )


def _merge(links: DataFrame, threshold: float | None) -> DataFrame:
    """Of a node's lower neighbours keep the smallest, and hang the others on it."""
    smallest = links.groupBy("node").agg(
        F.min("low").alias("root"), F.count(F.lit(1)).alias("fan")
    )
    moved = F.col("low") != F.col("root")
    return (
        _lookup(links, smallest, ["node"], threshold)
        .groupBy(
            F.when(moved, F.col("low")).otherwise(F.col("node")).alias("node"),
            F.col("root").alias("low"),
        )
        .agg(F.max(moved).alias("moved"))
    )


def _threshold(rows: int, share: float, floor: int) -> float | None:
    """Rows beyond which a key is a hub; none when no key can have that many."""
    threshold = hub_threshold(rows, share, floor)
    return threshold if rows > threshold else None


def _lookup(
    fact: DataFrame, table: DataFrame, on: list[str], threshold: float | None
) -> DataFrame:
    if threshold is None:
        return fact.join(table, on)
    return hub_join(fact, table, on, F.col("fan") > threshold)
