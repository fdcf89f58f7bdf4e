"""Consolidating pairwise matches into groups (connected components).

Method.  A two-dimensional grid: both ends of an edge are hashed into ``side``
row and column blocks, and each block pair is one partition of edges, placed
by its own number, so even a vertex with a third of all edges is spread over
``side`` partitions.  Each partition runs a local union-find and sends, for
every vertex it saw, its local representative.  Rows and columns then exchange
representatives: a vertex hooks onto the least one it was given, takes the
parent of that parent (pointer jumping), and what its blocks disagree on
becomes the edges of the contracted graph.  Rounds repeat until parents are
stable, i.e. no edge is left.

"Least" is the order of a hash salted by the round, not of the ids.  A vertex
keeps itself as parent only if it is the least of all its local sets, which
for a vertex with an edge happens with probability at most a half, so every
round at least halves the vertices on average whatever the ids are: a chain
of n edges in ascending order takes O(log n) rounds.  The graph is always cut
by at least a grid of 2 x 2, also where it would fit one task.

Every round writes to the shared checkpoint folder and cuts its lineage; the
parents of all rounds are composed at the end.  Only counts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.session import cut, join_small, map_arrow

EDGES_PER_BLOCK = 500_000
#: Blocks per axis of the smallest grid.
LEAST_SIDE = 2
OUT_ROWS = 100_000


class UnionFind:
    """Union-find over arbitrary int64 ids; the smallest id of a set is its root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, v: int) -> int:
        p = self.parent
        root = v
        while (up := p.setdefault(root, root)) != root:
            root = up
        while p[v] != root:
            p[v], v = root, p[v]
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def priority(ids: np.ndarray, salt: int) -> np.ndarray:
    """Order of vertices in a round: a 64-bit mix of the id and the round."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def local_sets(u: np.ndarray, v: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices of the edges, the least vertex of each one's set, and that one's priority."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    rank_of = np.empty(len(ids), np.int64)
    pri = priority(ids, salt)
    order = np.lexsort((ids, pri))
    rank_of[order] = np.arange(len(ids))
    a, b = rank_of[ends[: len(u)]], rank_of[ends[len(u) :]]
    parent = np.arange(len(ids))
    while len(a):
        a, b = parent[a], parent[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:  # path compression
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    least = order[parent[rank_of]]
    return ids, ids[least], pri[least]


def _union_find(salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            ids, roots, pri = local_sets(*(np.concatenate(c) for c in zip(*held)), salt)
            for at in range(0, len(ids), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + OUT_ROWS]) for c in (ids, roots, pri)], ["v", "root", "pri"])

    return run


def contract(edges: DataFrame, edges_per_block: int = EDGES_PER_BLOCK) -> list[DataFrame]:
    """Parents (v, up) of every round; the last round's are stable."""
    e = edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).where("u is not null and v is not null")
    e = cut(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    left = e.count()
    steps: list[DataFrame] = []
    while left:
        salt = len(steps)
        # blocks follow the size of the graph; a partition holds about edges_per_block edges
        side = max(LEAST_SIDE, math.ceil(math.sqrt(left / edges_per_block)))
        row, col = (F.pmod(F.xxhash64(F.lit(salt), F.col(c)), F.lit(side)) for c in ("u", "v"))
        # an edge has no direction, so its lower block is always the row
        grid = e.select("u", "v", (F.least(row, col) * side + F.greatest(row, col)).cast("int").alias("block"))
        grid = grid.repartitionById(side * side, "block").select("u", "v")
        star = cut(map_arrow(grid, _union_find(salt), "v bigint, root bigint, pri bigint"))
        hook = star.groupBy("v").agg(F.min(F.struct("pri", "root")).alias("m")).select("v", F.col("m.root").alias("up"))
        above = hook.select(F.col("v").alias("up"), F.col("up").alias("top"))
        jump = cut(hook.join(above, "up").select("v", F.col("top").alias("up")))  # a hub that many hook onto is a skewed key, which AQE splits
        # what a vertex was told by its blocks, seen from where it and they now are
        told = star.where("v <> root").join(jump, "v").select("root", "up").distinct()
        e = told.join(jump.select(F.col("v").alias("root"), F.col("up").alias("other")), "root").where("up <> other")
        e = cut(e.select(F.least("up", "other").alias("u"), F.greatest("up", "other").alias("v")).distinct())
        left = e.count()
        steps.append(jump)
    return steps


def component_labels(edges: DataFrame, edges_per_block: int = EDGES_PER_BLOCK) -> DataFrame:
    """v, label: one vertex of the component for every vertex that has an edge."""
    steps = contract(edges, edges_per_block)
    if not steps:
        return edges.sparkSession.createDataFrame([], "v bigint, label bigint")
    labels = steps[-1].withColumnRenamed("up", "label")
    for step in reversed(steps[:-1]):  # a vertex without an edge after a round keeps the parent it has
        labels = step.join(labels.select(F.col("v").alias("up"), "label"), "up", "left").select("v", F.coalesce("label", "up").alias("label"))
    return cut(labels)


def connected_components(edges: DataFrame, edges_per_block: int = EDGES_PER_BLOCK) -> DataFrame:
    """Smallest vertex of its component for every vertex that has an edge.

    Input columns u, v (bigint); others are ignored.  Output: v, root.  Edges
    with a null end are dropped, a loop makes its vertex a component of its
    own, repeated and turned-around edges change nothing, no edges give an
    empty result.
    """
    labels = component_labels(edges, edges_per_block)
    least = cut(labels.groupBy("label").agg(F.min("v").alias("root")))
    return join_small(labels, least, "label").select("v", "root")


def link_graph(link_edges: DataFrame, connect_labels: DataFrame) -> DataFrame:
    """Edges u, v of the identity graph: accepted pairs with two ends, and one
    edge from a tid to the hub of its player for every label >= 0.  Hubs are
    numbered above all tids and never come out, so no player's tids are ever
    paired with each other."""
    hub = F.lit(1 << 40) + F.col("player_id")
    pairs = link_edges.select(F.col("a_tid").cast("bigint").alias("u"), F.col("b_tid").cast("bigint").alias("v"))
    stars = connect_labels.where("player_id >= 0").select(F.col("tid").cast("bigint").alias("u"), hub.alias("v"))
    return pairs.unionByName(stars).where("u is not null and v is not null")


def group_tracklets(tracklets: DataFrame, link_edges: DataFrame, connect_labels: DataFrame, edges_per_block: int = EDGES_PER_BLOCK) -> DataFrame:
    """One group identifier for every tid of ``tracklets``: tid, group_tid, n_tids.

    group_tid is the smallest tid of ``tracklets`` in the group; a tid without
    links is its own group.  Tids only known to edges or labels connect others
    but don't come out; null tids don't come out; repeated rows count once.
    """
    known = tracklets.select(F.col("tid").cast("int")).where("tid is not null").distinct()
    labels = component_labels(link_graph(link_edges, connect_labels), edges_per_block).select(F.col("v").alias("id"), "label")
    placed = cut(known.join(labels, known["tid"] == labels["id"], "left").select("tid", F.coalesce("label", F.col("tid").cast("bigint")).alias("label")))
    least = cut(placed.groupBy("label").agg(F.min("tid").alias("group_tid"), F.count(F.lit(1)).alias("n_tids")))
    return join_small(placed, least, "label").select("tid", "group_tid", "n_tids")
