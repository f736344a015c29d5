"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors get one more component that makes them equally long, so the largest inner
product with a query is the smallest distance to it. A table hashes a vector to
the cells that ``K`` Gaussian projections of width ``w`` put it in. A query looks
into its own bucket and then into buckets next to it, in the order in which they
are likely to hold near vectors: by the sum of squared distances to the borders
that lie between. All candidates of a bucket are ranked by the exact measure.

A short vector is made longer mostly by the added component, which moves it away from
all queries. So vectors are split into ranges of norms, at most two to one, each with
an index of its own. Cell width and number of projections are fitted on a bounded sample
of each range, the number of probes on the true neighbours of a bounded sample of queries,
which one pass over all vectors finds; all vectors are indexed. Buckets are read as blocks
of bounded size, so a bucket with a third of all vectors is many tasks' work. Blocks
are dealt to shards, and a query goes once to each shard that holds blocks it looks into.

The ``k`` nearest of a sample that every task has are a query's first candidates. Nothing
below the last of them can be in the answer, so a task hands on few of the vectors it meets.

Three things are looked through in full, block by block: ranges of few vectors, ranges
where a bounded number of probes misses the recall asked for, and everything for
queries that have met fewer than ``k`` vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.llm.texts import map_rows
from matchbook.runtime import cut, shuffle_width

#: A probe moves at most so many cells along a projection.
_FAR = 4


@dataclass(frozen=True)
class Tables:
    """Projections ``(tables, K, dimension)``, offsets and width of the cells, and probes a table."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float
    probes: int
    longest: float

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """Place of each vector on each projection in cell widths: ``(tables, rows, K)``."""
        return np.einsum("tkd,nd->tnk", self.directions, vectors) / self.width + self.offsets[:, None, :]


def usable(vectors: Column, dimension: int | None = None) -> Column:
    """Not null, not zero, every component finite, and of the given dimension."""
    finite = F.forall(
        vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    ok = vectors.isNotNull() & finite & F.exists(vectors, lambda x: x != 0)
    return ok if dimension is None else ok & (F.size(vectors) == dimension)


def _extended(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Data vectors with the component that makes them as long as the longest."""
    rest = np.sqrt(np.maximum(0.0, longest**2 - (vectors**2).sum(1)))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def _query_side(vectors: np.ndarray, longest: float) -> np.ndarray:
    scale = longest / np.sqrt((vectors**2).sum(1))
    return np.concatenate([vectors * scale[:, None], np.zeros((len(vectors), 1))], axis=1)


def bucket_hash(cells: np.ndarray) -> np.ndarray:
    """One 64-bit number for each row of cell numbers."""
    out = np.full(cells.shape[:-1], 0x9E3779B97F4A7C15, np.uint64)
    for k in range(cells.shape[-1]):
        out = (out ^ cells[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def probe_cells(place: np.ndarray, probes: int) -> np.ndarray:
    """The first ``probes`` cells by estimated success for a query at ``place``.

    Each projection may stay or move up to ``_FAR`` cells down or up; a move costs the
    squared distance to the border it ends at. Sets of moves come in the order of their
    cost: from a set, the next ones move its last step on or add one more.
    """
    base = np.floor(place)
    inside = place - base
    size = len(place)
    costs = np.concatenate([side + n for n in range(_FAR) for side in (inside, 1 - inside)]) ** 2
    shifts = [sign * n for n in range(1, _FAR + 1) for sign in (-1, 1) for _ in range(size)]
    order = np.argsort(costs, kind="stable").tolist()
    ranked = costs[order].tolist()
    out = [base]
    heap = [(ranked[0], (0,))]
    while heap and len(out) < probes:
        cost, steps = heapq.heappop(heap)
        last = steps[-1]
        if last + 1 < len(order):
            step = ranked[last + 1]
            heapq.heappush(heap, (cost - ranked[last] + step, (*steps[:-1], last + 1)))
            if len({order[s] % size for s in steps}) == len(steps):
                heapq.heappush(heap, (cost + step, (*steps, last + 1)))
        moves = [order[s] for s in steps]
        if len({m % size for m in moves}) < len(moves):
            continue  # two moves along one projection
        cell = base.copy()
        for m in moves:
            cell[m % size] += shifts[m]
        out.append(cell)
    return np.array(out)


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products row by row in double precision, components added from left to right."""
    out = np.zeros(len(vectors))
    for d in range(vectors.shape[1]):
        out += queries[..., d] * vectors[:, d]
    return out


def _arrays(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64)


def _slack(queries: np.ndarray, longest: float) -> np.ndarray:
    """How far a product of matrices may be from the exact measure."""
    return 1e-15 * queries.shape[1] * np.sqrt((queries**2).sum(1)) * longest


def fit(
    data: np.ndarray,
    asked: np.ndarray,
    whose: np.ndarray,
    near: np.ndarray,
    n_rows: int,
    longest: float,
    tables: int = 4,
    bucket_rows: int = 256,
    recall: float = 0.94,
    spread: float = 3.0,
    most_probes: int = 4096,
    seed: int = 7,
) -> Tables | None:
    """Projections of one range, and as many probes as reach ``recall`` for the ``asked`` queries.

    ``data`` is a sample of the range; ``near`` are all true neighbours in it, row by row
    of the query ``whose`` they are. Cells are ``spread`` standard deviations wide, which
    parts the data in about two; the more rows, the more projections: about
    ``bucket_rows`` in a bucket. None if the recall takes more than ``most_probes``.
    """
    rng = np.random.default_rng(seed)
    dimension = data.shape[1] + 1
    size = max(2, min(24, round(np.log2(max(1.0, n_rows / bucket_rows)))))
    directions = rng.standard_normal((tables, size, dimension))
    points = _extended(data, longest)
    width = float(np.einsum("tkd,nd->tnk", directions, points).std(1).mean() * spread) or 1.0
    made = Tables(directions, rng.random((tables, size)), width, 1, longest)
    probes = 16
    if not len(near):
        return Tables(directions, made.offsets, width, probes, longest)
    buckets = bucket_hash(np.floor(made.cells(_extended(near, longest))))
    places = made.cells(_query_side(asked, longest))
    while probes <= most_probes:
        # The probe that first meets each neighbour in any table.
        first = np.full(len(near), probes)
        for q in np.unique(whose).tolist():
            own = np.flatnonzero(whose == q)
            for t in range(tables):
                looked = bucket_hash(probe_cells(places[t, q], probes))
                met = buckets[t][own][:, None] == looked[None, :]
                first[own] = np.minimum(first[own], np.where(met.any(1), met.argmax(1), probes))
        if (first < probes).mean() >= recall:
            needed = int(np.sort(first)[int(np.ceil(recall * len(near))) - 1]) + 1
            return Tables(directions, made.offsets, width, needed, longest)
        probes *= 2
    return None


@dataclass(frozen=True)
class Sample:
    """Vectors that every task has: a bounded number by a hash of their id."""

    ids: np.ndarray
    data: np.ndarray

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list, list, np.ndarray]:
        """Of each query its ``k`` nearest here, their scores, and what its ``k`` nearest of all reach."""
        found, scores = [], []
        least = np.full(len(queries), -np.inf)
        for i, (own, query) in enumerate(zip(ids, queries)):
            rough = self.data @ query
            rough[self.ids == own] = -np.inf
            n = min(k, int((rough > -np.inf).sum()))
            at = np.argpartition(-rough, n - 1)[:n] if n else np.zeros(0, np.int64)
            found.append(self.ids[at])
            scores.append(exact(query[None, :], self.data[at]))
            if n == k:
                least[i] = scores[-1].min()
        return found, scores, least


def _true_neighbours(own: DataFrame, sample: Sample, ids: np.ndarray, asked: np.ndarray, k: int, dimension: int) -> list:
    """``query_id, range, v`` of the ``k`` nearest of all vectors to each of a bounded number of queries."""
    _, _, least = sample.nearest(ids, asked, k)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            data, vec_ids = _matrix(batch["v"], dimension), batch["vec_id"].to_numpy()
            if not len(data):
                continue
            rough = asked @ data.T
            longest = float(np.sqrt((data**2).sum(1)).max())
            q, at = np.nonzero((rough >= (least - _slack(asked, longest))[:, None]) & (ids[:, None] != vec_ids[None, :]))
            yield {"query_id": ids[q], "vec_id": vec_ids[at], "far": -rough[q, at]}

    met = map_rows(own, run, "query_id long, vec_id long, far double")
    # The limit by rank cuts each task's rows to k of a query before they are shuffled.
    nearest_first = Window.partitionBy("query_id").orderBy("far", "vec_id")
    near = met.withColumn("rank", F.row_number().over(nearest_first)).filter(F.col("rank") <= k)
    near = near.select("query_id", "vec_id")
    return own.select("vec_id", "range", "v").join(near, "vec_id").collect()


def _ranges(
    own: DataFrame, is_query: Column, sample: Sample, k: int, small: int = 1024, **options
) -> tuple[DataFrame, dict[int, Tables], dict[int, int], int]:
    """``own`` with its ``range``, the tables by range, rows by range, and the number of queries.

    Ranges of up to ``small`` rows, and those no tables fit, have none.
    """
    by_hash = [F.xxhash64("vec_id"), "vec_id"]
    dimension = sample.data.shape[1]
    # Borders lie halfway, so that vectors of one length are in one range.
    middle = float(np.median(np.sqrt((sample.data**2).sum(1))))
    own = own.withColumn("range", F.floor(F.log2(F.col("norm") / middle) + 0.5).cast("int"))
    # At most 200 queries.
    asked_ids, asked = _arrays(own.filter(is_query).orderBy(*by_hash).limit(200).collect())
    # Numbers of single precision have fewer than 300 powers of two.
    found = own.groupBy("range").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("norm").alias("longest"),
        F.count(F.when(is_query, 1)).alias("queries"),
    ).collect()
    counts = {r["range"]: r["n"] for r in found}
    large = [r for r in found if r["n"] > small]
    tables: dict[int, Tables] = {}
    if large and len(asked):
        most = len(sample.ids)
        each = max(256, min(most, 2 * most // len(large)))
        steps = 1 << 30
        least = F.create_map(
            *(F.lit(x) for r in large for x in (r["range"], min(steps, int(1.1 * steps * each / r["n"]))))
        )
        # About ``each`` rows of a range: ids differ, so their hashes spread.
        drawn = own.filter(F.pmod(F.xxhash64("vec_id"), F.lit(steps)) < least[F.col("range")])
        rows: dict[int, list] = {}
        for r in drawn.orderBy(*by_hash).collect():
            rows.setdefault(r["range"], []).append(r)
        near: dict[int, list] = {}
        for r in _true_neighbours(own, sample, asked_ids, asked, k, dimension):
            near.setdefault(r["range"], []).append(r)
        number = {int(i): n for n, i in enumerate(asked_ids)}
        for r in large:
            _, data = _arrays(rows.get(r["range"], [])[:each])
            here = near.get(r["range"], [])
            whose = np.array([number[x["query_id"]] for x in here], np.int64)
            vectors = np.array([x["v"] for x in here], np.float64).reshape(-1, dimension)
            longest = r["longest"] * (1 + 1e-9)
            if len(data) and (t := fit(data, asked, whose, vectors, r["n"], longest, **options)):
                tables[r["range"]] = t
    return own, tables, counts, sum(r["queries"] for r in found)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dimension)


def index_rows(vectors: DataFrame, tables: dict[int, Tables], dimension: int) -> DataFrame:
    """``range, table, bucket, vec_id, v``: every vector in its bucket of every table of its range."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            data, ranges = _matrix(batch["v"], dimension), batch["range"].to_numpy()
            for r in np.unique(ranges).tolist():
                at = np.flatnonzero(ranges == r)
                buckets = bucket_hash(np.floor(tables[r].cells(_extended(data[at], tables[r].longest))))
                for t in range(len(buckets)):
                    yield {
                        "range": np.full(len(at), r),
                        "table": np.full(len(at), t),
                        "bucket": buckets[t],
                        "vec_id": batch["vec_id"].take(pa.array(at)),
                        "v": batch["v"].take(pa.array(at)),
                    }

    return map_rows(vectors, run, "range int, table int, bucket long, vec_id long, v array<float>")


def probe_rows(queries: DataFrame, tables: dict[int, Tables], dimension: int) -> DataFrame:
    """``range, table, bucket, query_id``: every bucket that a query looks into."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            data, ids = _matrix(batch["v"], dimension), batch["query_id"].to_numpy()
            if not len(data):
                continue
            for r, fitted in tables.items():
                places = fitted.cells(_query_side(data, fitted.longest))
                for t in range(len(places)):
                    looked = [bucket_hash(probe_cells(p, fitted.probes)) for p in places[t]]
                    sizes = [len(x) for x in looked]
                    yield {
                        "range": np.full(sum(sizes), r),
                        "table": np.full(sum(sizes), t),
                        "bucket": np.concatenate(looked),
                        "query_id": np.repeat(ids, sizes),
                    }

    return map_rows(queries, run, "range int, table int, bucket long, query_id long")


def first_candidates(queries: DataFrame, sample: Sample, k: int, dimension: int) -> DataFrame:
    """``query_id, v, least`` and, as lists, ``vec_ids, far``: the ``k`` nearest of the sample."""
    # Bounded by the size of the sample.
    shared = queries.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            ids = batch["vec_id"].to_numpy()
            found, scores, least = shared.value.nearest(ids, _matrix(batch["v"], dimension), k)
            far = [(-x).tolist() for x in scores]
            yield {
                "query_id": ids, "v": batch["v"], "least": least,
                "vec_ids": [x.tolist() for x in found], "far": far,
            }

    schema = "query_id long, v array<float>, least double, vec_ids array<long>, far array<double>"
    return map_rows(queries.select("vec_id", "v"), run, schema)


_SHARD = ["range", "table", "shard"]


def _in_buckets(
    data: DataFrame, probes: DataFrame, asked: DataFrame, counts: dict[int, int], block_rows: int
) -> DataFrame:
    """Vectors, and the queries that look into their buckets, by shard.

    Buckets come as blocks of bounded size, a few thousand rows of them to a shard. A vector
    goes to one shard, a query to those with blocks it wants, with the list of them.
    """
    bucket = ["range", "table", "bucket"]
    sizes = data.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"))
    blocks = sizes.select(*bucket, F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    shards = F.create_map(*(F.lit(x) for r, n in counts.items() for x in (r, max(1, n // (2 * block_rows)))))
    cell = F.xxhash64("bucket", "block")
    shard = F.pmod(F.col("cell"), shards[F.col("range")]).cast("int")
    held = data.join(blocks, bucket).withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    )
    held = held.withColumn("cell", cell).withColumn("shard", shard)
    wanted = probes.join(blocks, bucket).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    wanted = wanted.withColumn("cell", cell).withColumn("shard", shard)
    wanted = wanted.groupBy(*_SHARD, "query_id").agg(F.collect_list("cell").alias("cells"))
    return _side_by_side(held, wanted.join(asked.select("query_id", "v", "least"), "query_id"))


def _side_by_side(held: DataFrame, wanted: DataFrame) -> DataFrame:
    vectors = held.select(
        *_SHARD, F.lit(0).alias("role"), "vec_id", "v", "cell",
        F.lit(0.0).alias("least"), F.array().cast("array<long>").alias("cells"),
    )
    queries = wanted.select(
        *_SHARD, F.lit(1).alias("role"), F.col("query_id").alias("vec_id"), "v",
        F.lit(0).cast("long").alias("cell"), "least", "cells",
    )
    return vectors.unionByName(queries)


def _in_full(data: DataFrame, asked: DataFrame, n_rows: int, n_asked: int, block_rows: int) -> DataFrame:
    """Every vector beside every query: each block of vectors meets each block of queries once."""
    width = shuffle_width(data.sparkSession)
    # Large blocks repeat few rows; small tables have enough blocks for all tasks.
    blocks = max(1, -(-n_rows // (32 * block_rows)), min(width, -(-n_rows // block_rows)))
    parts = max(1, -(-n_asked // (16 * block_rows)))

    def rows(df: DataFrame, name: str, n_own: int, stride: int, n_other: int, other_stride: int) -> DataFrame:
        own = F.pmod(F.xxhash64(name), F.lit(n_own)).cast("int") * stride
        others = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        spread = df.select("*", others.alias("other"), own.alias("own"))
        # No index has this table.
        return spread.select(
            F.lit(0).alias("range"),
            F.lit(-1).alias("table"),
            (F.col("own") + F.col("other") * other_stride).alias("shard"),
            F.lit(0).cast("long").alias("cell"),
            *df.columns,
        )

    held = rows(data.select("vec_id", "v"), "vec_id", blocks, parts, parts, 1)
    wanted = rows(asked.select("query_id", "v", "least"), "query_id", parts, 1, blocks, parts)
    return _side_by_side(held, wanted.withColumn("cells", F.array("cell")))


class _Shard:
    """Vectors of one shard by cell, and the search in them."""

    def __init__(self, cells: list, ids: list, parts: list):
        self._ids, self._data = np.concatenate(ids), np.concatenate(parts)
        self._cells, self._starts, self._sizes = np.unique(
            np.concatenate(cells), return_index=True, return_counts=True
        )
        self._longest = float(np.sqrt((self._data**2).sum(1)).max())

    def answer(
        self, asked_ids: np.ndarray, asked: np.ndarray, least: np.ndarray, cells: pa.Array, k: int,
        rows: int = 2048, most: int = 500_000,
    ) -> dict:
        """The ``k`` nearest of each query in the cells it wants, nearest first, and how many it met.

        Products of blocks of queries and vectors find what reaches ``least``; that is
        measured exactly, and raises ``least`` when there is much of it.
        """
        n = len(asked)
        flat = cells.flatten().to_numpy(zero_copy_only=False)
        whose = np.repeat(np.arange(n), cells.value_lengths().to_numpy(zero_copy_only=False))
        place = np.minimum(np.searchsorted(self._cells, flat), len(self._cells) - 1)
        there = self._cells[place] == flat
        whose, place = whose[there], place[there]
        slack = _slack(asked, self._longest)
        lowest = least - slack
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> tuple:
            q, at = (np.concatenate([x[i] for x in waiting]) for i in (0, 1))
            waiting.clear()
            other = self._ids[at] != asked_ids[q]
            q, at = q[other], at[other]
            score = np.zeros(len(q))
            for low in range(0, len(q), 1 << 16):
                part = slice(low, low + (1 << 16))
                score[part] = exact(asked[q[part]], self._data[at[part]])
            q, at = np.concatenate((kept[0], q)), np.concatenate((kept[1], at))
            score = np.concatenate((kept[2], score))
            order = np.lexsort((self._ids[at], -score, q))
            q, at, score = q[order], at[order], score[order]
            begins = np.searchsorted(q, np.arange(n))
            rank = np.arange(len(q)) - begins[q]
            last = rank == k - 1
            lowest[q[last]] = np.maximum(lowest[q[last]], score[last] - slack[q[last]])
            first = rank < k
            return q[first], at[first], score[first]

        held = 0
        order = np.argsort(place, kind="stable")
        whose, place = whose[order], place[order]
        edges = np.flatnonzero(np.diff(place, prepend=-1, append=-1)) if len(place) else np.zeros(1, np.int64)
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            start = int(self._starts[place[a]])
            end = start + int(self._sizes[place[a]])
            for low in range(start, end, rows):
                block = self._data[low : min(end, low + rows)].T
                for near in range(a, b, rows):
                    queries = whose[near : min(b, near + rows)]
                    q, at = np.nonzero(asked[queries] @ block >= lowest[queries][:, None])
                    waiting.append((queries[q], at + low))
                    held += len(q)
                    if held >= most:
                        kept, held = settle(), 0
        if waiting:
            kept = settle()
        sizes = np.bincount(kept[0], minlength=n)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        return {
            "query_id": asked_ids,
            "met": np.bincount(whose, weights=self._sizes[place], minlength=n).astype(np.int64),
            "vec_ids": _list_of(offsets, pa.array(self._ids[kept[1]])),
            "far": _list_of(offsets, pa.array(-kept[2])),
        }


def _list_of(offsets: pa.Array, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(offsets, values).cast(pa.list_(pa.field("element", values.type)))


def _lists(met: DataFrame, k: int, dimension: int) -> DataFrame:
    """``query_id, table, met, vec_ids, far``: the ``k`` nearest of each query in each shard."""
    met = met.repartition(*_SHARD).sortWithinPartitions(*_SHARD, "role", "cell")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        current, shard = None, None
        waiting: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            place = np.stack([batch[n].to_numpy() for n in (*_SHARD, "role")])
            if not place.shape[1]:
                continue
            data, ids = _matrix(batch["v"], dimension), batch["vec_id"].to_numpy()
            cells, least = batch["cell"].to_numpy(), batch["least"].to_numpy()
            edge = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), place.shape[1]]):
                *at, role = place[:, a].tolist()
                if at != current:
                    current, shard = at, None
                    waiting = ([], [], [])
                if role == 0:
                    for held, values in zip(waiting, (cells, ids, data)):
                        held.append(values[a:b])
                elif waiting[0]:
                    shard = shard or _Shard(*waiting)
                    found = shard.answer(ids[a:b], data[a:b], least[a:b], batch["cells"].slice(a, b - a), k)
                    yield {"table": np.full(b - a, at[1])} | found

    schema = "query_id long, table int, met long, vec_ids array<long>, far array<double>"
    return map_rows(met, run, schema)


def _merged(lists: list[DataFrame], first: DataFrame, k: int, tables: int) -> DataFrame:
    """``query_id, met, found``: the ``k`` nearest of each query over all lists, nearest first.

    ``met`` is how many vectors a query has met in the table where it met most of them,
    and in full passes.
    """
    own = first.select(
        "query_id", F.lit(-2).alias("table"), F.lit(0).cast("long").alias("met"), "vec_ids", "far"
    )
    found = reduce(DataFrame.unionByName, [own, *lists])

    def seen(t: int) -> Column:
        return F.sum(F.when(F.col("table") == t, F.col("met")).otherwise(0))

    # At most k rows of a query from each shard it looked into.
    near = F.sort_array(F.flatten(F.collect_list(F.arrays_zip("far", "vec_ids"))))
    # A vector comes once from each table, the sample and a full pass.
    near = F.slice(F.array_distinct(F.slice(near, 1, k * (tables + 2))), 1, k)
    met = F.array_max(F.array(*(seen(t) for t in range(max(1, tables))))) + seen(-1)
    return found.groupBy("query_id").agg(near.alias("found"), met.alias("met"))


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    block_rows: int = 2048,
    sample: int = 2048,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    **options,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for each query.

    ``is_query`` (a column over ``vec_id``) marks the rows to ask for; all other rows are
    candidates, and so are other queries. Ties go to the smaller id. Vectors that are
    null, zero, of another length than most, or hold null or non-finite components
    take no part; nor do rows with a null id. Rows that repeat an id and vector are one;
    of different vectors with one id the smallest stands for it. Fewer than ``k`` other vectors are all returned.
    Further columns, whatever their names, are not looked at.
    """
    spark = vectors.sparkSession
    own = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v")
    )
    own = own.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    own = own.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("norm", norm)
    own, _ = cut(own)
    # One row per dimension that occurs; the most frequent is the one.
    sizes = own.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    dimension = common["size"]
    own = own.filter(F.size("v") == dimension)
    # At most ``sample`` vectors.
    drawn = Sample(*_arrays(own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()))
    own, tables, counts, n_asked = _ranges(own, is_query, drawn, k, **options)
    asked, _ = cut(first_candidates(own.filter(is_query), drawn, k, dimension))
    per_range = max((len(t.directions) for t in tables.values()), default=0)

    # Ranges without tables are looked through in full.
    full = sorted(counts.keys() - tables.keys())
    met = []
    if tables:
        indexed = index_rows(own.filter(F.col("range").isin(sorted(tables))), tables, dimension)
        probes = probe_rows(asked, tables, dimension)
        met.append(_in_buckets(indexed, probes, asked, {r: counts[r] for r in tables}, block_rows))
    if full:
        rest = own.filter(F.col("range").isin(full))
        met.append(_in_full(rest, asked, sum(counts[r] for r in full), n_asked, block_rows))
    found = _merged([_lists(m, k, dimension) for m in met], asked, k, per_range)
    if tables:
        # Queries that met too few vectors, themselves included, look at all of them.
        found, _ = cut(found)
        enough = found.filter(F.col("met") > min(k, common["n"] - 1))
        short, seen = cut(asked.join(enough, "query_id", "left_anti"), n=F.count(F.lit(1)))
        if seen["n"]:
            again = _in_full(own, short, common["n"], seen["n"], block_rows)
            found = enough.unionByName(_merged([_lists(again, k, dimension)], short, k, per_range))
    return found.select("query_id", F.posexplode("found").alias("at", "one")).select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("one.vec_ids").alias("vec_id"),
        (-F.col("one.far")).alias("score"),
    )
