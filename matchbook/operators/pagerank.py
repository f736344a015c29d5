"""PageRank by deltas, to a tolerance or for a number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.operators.graph import PropertyGraph, endpoint_ids
from matchbook.operators.hubs import HUB_FLOOR, HUB_SHARE, hub_threshold
from matchbook.runtime import cut, fixed_plans, shuffle_width


def pagerank(
    graph: PropertyGraph,
    tol: float = 0.001,
    max_rounds: int | None = None,
    reset: float = 0.15,
    normalise: bool = True,
    hub_share: float = HUB_SHARE,
    hub_floor: int = HUB_FLOOR,
    rounds_per_cut: int = 2,
) -> DataFrame:
    """Rank of every vertex as ``(id, rank)``.

    Every vertex starts with rank and delta ``reset``. In a round each vertex
    whose delta exceeds ``tol`` spreads it evenly over its out-edges; a receiver
    gains ``1 - reset`` of what arrives, and that gain is its next delta. The
    loop ends when no delta exceeds ``tol``, or after ``max_rounds``. With
    ``normalise`` the ranks sum to the number of vertices. Parallel edges count
    each; ranks held by vertices without out-edges are not redistributed.

    Parallel edges become one weighted edge before anything iterates. Edges by source
    and state by id are partitioned alike and sorted once; rounds merge them as they lie
    and shuffle the gains only, summed on the map side first. Edges that leave a hub are
    never partitioned by their source. ``rounds_per_cut`` rounds make one job, which ends
    in a checkpoint and counts the vertices that are still active; rounds after the
    last active vertex change no rank.
    """
    width = shuffle_width(graph.edges.sparkSession)
    links, _ = cut(
        graph.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )
    fan = links.groupBy(F.col("src").alias("id")).agg(
        F.sum("weight").alias("out_weight"), F.count(F.lit(1)).alias("fan_out")
    )
    ids = graph.vertices.select("id").union(endpoint_ids(links)).distinct()
    start, seen = cut(
        ids.join(fan, "id", "left"),
        links=F.sum("fan_out"),
        widest=F.max("fan_out"),
    )
    threshold = hub_threshold(seen["links"] or 0, hub_share, hub_floor)
    has_hubs = (seen["widest"] or 0) > threshold
    hub = F.coalesce(F.col("fan_out") > threshold, F.lit(False))
    state = start.select(
        "id",
        "out_weight",
        hub.alias("hub"),
        F.lit(float(reset)).alias("rank"),
        F.lit(float(reset)).alias("delta"),
    )
    active = reset > tol

    with fixed_plans(graph.edges.sparkSession):
        cold, held = links, []
        if has_hubs:
            hub_ids = F.broadcast(start.filter(hub).select(F.col("id").alias("src")))
            hot = links.join(hub_ids, "src", "left_semi").persist()
            cold = links.join(hub_ids, "src", "left_anti")
            held.append(hot)
        cold = cold.repartition(width, "src").sortWithinPartitions("src").persist()
        held.append(cold)
        state = state.repartition(width, "id").sortWithinPartitions("id")

        def after_round(state: DataFrame) -> DataFrame:
            sent = state.filter((F.col("delta") > tol) & F.col("out_weight").isNotNull()).select(
                F.col("id").alias("src"), (F.col("delta") / F.col("out_weight")).alias("share"), "hub"
            )
            flow = cold.join(sent.filter(~F.col("hub")).hint("merge"), "src")
            flow = flow.select("dst", "weight", "share")
            if has_hubs:
                heavy = hot.join(F.broadcast(sent.filter("hub")), "src")
                flow = flow.union(heavy.select("dst", "weight", "share"))
            gains = flow.groupBy(F.col("dst").alias("id")).agg(
                (F.sum(F.col("weight") * F.col("share")) * (1.0 - reset)).alias("gain")
            )
            gain = F.coalesce("gain", F.lit(0.0))
            return state.join(gains.hint("merge"), "id", "left").select(
                "id", "out_weight", "hub", (F.col("rank") + gain).alias("rank"), gain.alias("delta")
            )

        done = 0
        while active and (max_rounds is None or done < max_rounds):
            rounds = rounds_per_cut if max_rounds is None else min(rounds_per_cut, max_rounds - done)
            passed = []
            for _ in range(rounds):
                passed.append(state.persist())
                state = after_round(state)
            state, seen = cut(
                state,
                active=F.count_if(F.col("delta") > tol),
                total=F.sum("rank"),
                n=F.count(F.lit(1)),
            )
            for table in passed:
                table.unpersist()
            active, done = seen["active"] > 0, done + rounds

        for table in held:
            table.unpersist()
    rank = F.col("rank")
    if normalise and done:
        rank = rank * (seen["n"] / seen["total"])
    elif normalise:
        rank = F.lit(1.0)
    return state.select("id", rank.alias("rank"))
