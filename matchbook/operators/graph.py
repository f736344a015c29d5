"""A property graph held as two DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def endpoint_ids(edges: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Distinct ids at either end of the edges, in one pass over them."""
    return edges.select(*scope, F.explode(F.array("src", "dst")).alias("id")).distinct()


@dataclass(frozen=True)
class PropertyGraph:
    """Vertices ``(id, ...)`` and directed edges ``(src, dst, ...)``.

    An edge runs from the winner to the loser. Parallel edges are kept: a pair
    may meet more than once. The hot end of an edge join is left to adaptive
    execution, which splits a skewed partition of the edge side; wherever an
    aggregate follows, the edges are aggregated before they are joined.
    """

    vertices: DataFrame
    edges: DataFrame

    def size(self) -> DataFrame:
        counted = [
            df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("part"), "n")
            for what, df in (("vertices", self.vertices), ("edges", self.edges))
        ]
        return counted[0].unionByName(counted[1])

    def triplets(self, attributes: Sequence[str] | None = None) -> DataFrame:
        """Edges with the attributes of both ends as ``src_*`` and ``dst_*`` columns."""
        names = list(attributes or [c for c in self.vertices.columns if c != "id"])
        joined = self.edges
        for end in ("src", "dst"):
            side = self.vertices.select(
                F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in names]
            )
            joined = joined.join(side, end, "left")
        return joined

    def subgraph(self, edge_condition: Column) -> PropertyGraph:
        """Edges that meet the condition, and the vertices they touch."""
        return self.restricted_to(self.edges.filter(edge_condition))

    def restricted_to(self, edges: DataFrame) -> PropertyGraph:
        touched = self.vertices.join(endpoint_ids(edges), "id", "left_semi")
        return PropertyGraph(touched, edges)

    def subgraph_in(self, members: DataFrame, edge_keys: Sequence[Column]) -> PropertyGraph:
        """Edges whose keys occur in ``members`` (same number of columns), with their ends."""
        keyed = self.edges.select("*", *[k.alias(f"_key{i}") for i, k in enumerate(edge_keys)])
        wanted = members.toDF(*[f"_key{i}" for i in range(len(edge_keys))]).distinct()
        on = wanted.columns
        return self.restricted_to(keyed.join(wanted, on, "left_semi").drop(*on))

    def reverse(self) -> PropertyGraph:
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        turned = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
        return PropertyGraph(self.vertices, turned)

    def degrees(self, end: str, name: str) -> DataFrame:
        """Edges per vertex at one end: ``src`` counts wins, ``dst`` counts losses."""
        return (
            self.edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias(name))
        )

    def vertices_with(self, end: str) -> DataFrame:
        return self.vertices.join(self._ids_at(end), "id", "left_semi")

    def vertices_without(self, end: str) -> DataFrame:
        return self.vertices.join(self._ids_at(end), "id", "left_anti")

    def _ids_at(self, end: str) -> DataFrame:
        # Distinct first: the semi join then meets each id once, however hot it is.
        return self.edges.select(F.col(end).alias("id")).distinct()
