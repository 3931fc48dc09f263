"""Connected components by random contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import Stored

#: Nodes that a task's table of components holds before it starts anew.
FOREST = 500_000
#: Edges that are few enough for one task.
TAIL = 20_000


class Forest:
    """Components of the edges added so far, each named by its smallest node."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, x: int) -> int:
        above = self.above
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    def add(self, a: int, b: int) -> None:
        x, y = self.top(a), self.top(b)
        if x != y:
            self.above[max(x, y)] = min(x, y)

    def stars(self) -> pa.RecordBatch:
        """(a, b): each node, but for the smallest ones, with the smallest of its component."""
        nodes = list(self.above)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([self.top(x) for x in nodes], pa.int64())], names=["a", "b"])


class Labels:
    """Components of places 0, 1, ... whose edges come as arrays; most of many edges lie in one component already and cost no loop."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def grow(self, n: int) -> None:
        self.root = np.concatenate([self.root, np.arange(len(self.root), n)])

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.root[i], self.root[j]
        new = a != b
        if new.any():
            found = Forest()
            for x, y in np.unique(np.stack([a[new], b[new]], axis=1), axis=0).tolist():
                found.add(x, y)
            to = np.arange(len(self.root))
            below = list(found.above)
            to[below] = [found.top(x) for x in below]
            self.root = to[self.root]

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Places that aren't the first of their component, and the first ones."""
        at = np.flatnonzero(self.root != np.arange(len(self.root)))
        return at, self.root[at]


def thinned(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components: each task gives a star for each component of what it has read."""

    def thin(batches):
        found = Forest()
        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.add(u, v)
            if len(found.above) > FOREST:
                yield found.stars()
                found = Forest()
        yield found.stars()

    return edges.select("a", "b").where("a <> b").mapInArrow(thin, "a long, b long")


def components(edges: DataFrame, tail: int = TAIL) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b), root being the smallest node of its component.

    In each round every node has a fresh random rank, moves to the least ranked among itself and its neighbours, and
    edges are redrawn between those.  A round leaves at most three quarters of the nodes that have edges, as
    expected, whatever the graph's shape (about half of a path's), so rounds grow with the logarithm of the nodes, and tables
    shrink from round to round.  At most ``tail`` edges left are settled by one task.  Moves are then followed backwards.
    Rounds read the written tables of the round before: neither lineage nor plan statistics grow.  Edges with a null
    end and loops count as none.
    """
    kept = Stored(edges.sparkSession)
    ordered = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left = kept.write(edges.select(*(F.col(c).cast("long").alias(c) for c in "ab")).where("a <> b").select(*ordered).distinct())
    moves: list[DataFrame] = []

    def rank(c: str):
        return F.struct(F.xxhash64(F.lit(len(moves)), F.col(c)).alias("h"), F.col(c).alias("node"))

    while (n := left.count()) > tail:
        both = left.select("a", rank("b").alias("r")).union(left.select(F.col("b").alias("a"), rank("a").alias("r")))
        least = both.groupBy("a").agg(F.min("r").alias("r")).select(F.col("a").alias("node"), F.least(rank("a"), F.col("r"))["node"].alias("to"))
        moves.append(kept.write(least))
        ends = {c: moves[-1].select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab"}
        redrawn = left.join(ends["a"], "a").join(ends["b"], "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        was, left = left, kept.write(redrawn.where("a <> b").select(*ordered).distinct())
        kept.drop(was)
    roots = _settled(left) if n else None
    for move in reversed(moves):
        if roots is None:
            roots = move.select("node", F.col("to").alias("root"))
            continue
        further = roots.select(F.col("node").alias("to"), F.col("root").alias("further"))
        roots = kept.write(move.join(further, "to", "left").select("node", F.coalesce("further", "to").alias("root")))
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if not moves:
        return roots
    named = kept.write(roots.groupBy("root").agg(F.min("node").alias("least")))
    return roots.join(named, "root").select("node", F.col("least").alias("root"))


def _settled(edges: DataFrame) -> DataFrame:
    """(node, root) of a bounded number of edges, in one task."""

    def settle(batches):
        found, nodes = Forest(), set()
        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.add(u, v)
                nodes.update((u, v))
        at = list(nodes)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([found.top(x) for x in at], pa.int64())], names=["node", "root"])

    return edges.repartition(1).mapInArrow(settle, "node long, root long")
