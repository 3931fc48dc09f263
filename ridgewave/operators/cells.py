"""A tree of cells over vectors: every row in a leaf of bounded size, and searches that leave out what is too far.

The first level has up to ``pivots`` cells around rows of the smallest digests; a row belongs to the nearest pivot.  A cell that holds too
many rows is dealt again around rows of its own, one of them its farthest, level by level, so leaves stay small however large the table is;
the levels below the first are tables that are joined by cell, never sent whole to a task.  By the triangle inequality a search around a point needs a
cell only if its radius and the search's reach its pivot.  Rows at one and the same place stay one leaf; leaves are dealt into blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import Stored

#: Rows of a block, cells of a split, and levels below the first at most.
BLOCK, FAN, LEVELS = 512, 64, 5
#: A cell is split beyond so many times its wanted size, as cells around random rows differ.
SLACK = 4
#: Leaves whose sizes are broadcast, and tasks that the rows of a cell are dealt to when it is split.
FEW, SHARES = 4096, 8
_STEP = 4096


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def slices(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, BLOCK):
        yield batch.slice(at, BLOCK)


def held_runs(batches):
    """(held, coming) for each run of rows with ``side`` 1 in batches sorted by home and side; ``held`` are the rows of side 0 before it, if any are of its home."""
    held, last = [], None
    for b in batches:
        home, side = b.column("home").to_numpy(), b.column("side").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(home) != 0) | (np.diff(side) != 0)) + 1).tolist(), b.num_rows]
        for at, to in zip(cuts, cuts[1:]):
            if to == at:
                continue
            if last is None or last[0] != home[at] or (side[at] == 0 and last[1] == 1):
                held = []
            if side[at] == 0:
                held.append(b.slice(at, to - at))
            else:
                yield held, b.slice(at, to - at)
            last = home[at], side[at]


def _beside(rows: DataFrame, given: DataFrame) -> DataFrame:
    """``rows`` (home, id and others) below the row of ``given`` (home and another) of their home, in shares; so no row carries what all of its cell share."""
    held = given.withColumns({"share": F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))), "side": F.lit(0)})
    coming = rows.withColumns({"share": F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int"), "side": F.lit(1)})
    return held.unionByName(coming, allowMissingColumns=True).repartition("home", "share").sortWithinPartitions("home", "share", "side")


@dataclass
class Tree:
    """``placed``: rows with ``home`` and ``gap``, the distance to its pivot; ``leaves``: home, n, blocks, radius; ``levels``: tables of cells below the first."""

    placed: DataFrame
    leaves: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    split: frozenset[int]
    levels: list[DataFrame]
    n_leaves: int

    def small(self, df: DataFrame) -> DataFrame:
        """Marks a table of one row a leaf for broadcast if there are few."""
        return F.broadcast(df) if self.n_leaves <= FEW else df

    def around(self, points: DataFrame, kept: Stored) -> DataFrame:
        """``points`` (id, x and others) with ``cell``, the leaf that is nearest level by level."""
        names = points.columns
        at_x = names.index("x")
        pivots, radius, split = points.sparkSession.sparkContext.broadcast(self.pivots), self.radius, self.split
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields), "cell long, inner boolean"])

        def first(batches):
            for b in batches:
                for part in slices(b):
                    c = np.where(radius >= 0, distances(matrix(part.column(at_x)), pivots.value), np.inf).argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c.astype(np.int64)), pa.array([int(k) in split for k in c], pa.bool_())], names=[*names, "cell", "inner"])

        def further(batches):
            last = None
            for held, coming in held_runs(batches):
                if held is not last:
                    last, kids = held, held[0].column("kids")[0].as_py()
                    at, node, inner = np.array([k["pivot"] for k in kids]), np.array([k["node"] for k in kids]), np.array([k["inner"] for k in kids])
                for part in slices(coming):
                    c = distances(matrix(part.column("x")), at).argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*part.select(names).columns, pa.array(node[c]), pa.array(inner[c])], names=[*names, "cell", "inner"])

        front = kept.write(points.mapInArrow(first, schema))
        out = front.where("NOT inner").drop("inner")
        for level in self.levels:
            kids = level.groupBy(F.col("parent").alias("home")).agg(F.collect_list(F.struct("node", "pivot", "inner")).alias("kids"))
            front = kept.write(_beside(front.where("inner").select(*names, F.col("cell").alias("home")), kids).mapInArrow(further, schema))
            out = out.union(front.where("NOT inner").drop("inner"))
        return out


def build(rows: DataFrame, kept: Stored, pivots: int = 1024, cell: int = BLOCK, count: int | None = None) -> Tree | None:
    """The tree of rows (id, x and others); None without rows.  ``cell`` is the number of rows that a leaf should have."""
    count = rows.count() if count is None else count
    if not count:
        return None
    wanted = max(1, min(pivots, count // cell))
    chosen = np.array([r["x"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("x").collect()], float)  # at most ``pivots`` rows
    sent = rows.sparkSession.sparkContext.broadcast(chosen)
    names, at_x = rows.columns, rows.columns.index("x")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "home long, gap double"])

    def first(batches):
        for b in batches:
            for part in slices(b):
                d = distances(matrix(part.column(at_x)), sent.value)
                k = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(k.astype(np.int64)), pa.array(d[np.arange(len(d)), k])], names=[*names, "home", "gap"])

    placed = kept.write(rows.mapInArrow(first, schema))
    facts = F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")
    sizes = {r["home"]: r for r in placed.groupBy("home").agg(*facts).collect()}  # one row a pivot
    radius = np.array([sizes[k]["radius"] if k in sizes else -1.0 for k in range(wanted)])
    split = frozenset(k for k, r in sizes.items() if r["n"] > SLACK * cell and r["radius"] > 0)
    leaf = F.struct("home", "n", F.ceil(F.col("n") / BLOCK).alias("blocks"), "radius")
    if not split:
        leaves = placed.groupBy("home").agg(*facts).select(leaf.alias("l")).select("l.*")
        return Tree(placed, kept.write(leaves), chosen, radius, split, [], len(sizes))

    def deeper(batches):
        last = None
        for held, coming in held_runs(batches):
            if held is not last:
                last, at = held, np.array(held[0].column("pivots")[0].as_py(), float)
            for part in slices(coming):
                d = distances(matrix(part.column("x")), at)
                j = d.argmin(axis=1)
                home = (part.column("home").to_numpy() + 1) * _STEP + j
                yield pa.RecordBatch.from_arrays([*part.select(names).columns, pa.array(home), pa.array(d[np.arange(len(d)), j])], names=[*names, "home", "gap"])

    inner = F.col("home").isin(list(split))
    done, open_, levels = [placed.where(~inner)], placed.where(inner), []
    for depth in range(LEVELS):
        # at most FAN rows of a cell, ranked before the shuffle too, and its farthest row
        near = open_.withColumn("k", F.row_number().over(Window.partitionBy("home").orderBy(F.xxhash64("id"), "id"))).where(F.col("k") <= FAN).groupBy("home").agg(F.array_distinct(F.collect_list("x")).alias("near"))
        far = open_.groupBy("home").agg(F.max_by("x", F.struct("gap", "id")).alias("far"))
        centres = kept.write(near.join(far, "home").select("home", F.array_distinct(F.concat("near", F.array("far"))).alias("pivots")))
        moved = kept.write(_beside(open_.select(*names, "home"), centres).mapInArrow(deeper, schema))
        found = moved.groupBy(F.col("home").alias("node")).agg(*facts)
        above = F.floor(F.col("node") / _STEP) - 1
        grown = (F.col("n") > SLACK * cell) & (F.col("radius") > 0) if depth < LEVELS - 1 else F.lit(False)
        named = found.withColumns({"parent": above, "inner": grown}).join(centres.withColumnRenamed("home", "parent"), "parent")
        levels.append(kept.write(named.select("parent", "node", "n", "radius", "inner", F.col("pivots")[F.pmod("node", F.lit(_STEP)).cast("int")].alias("pivot"))))
        more = levels[-1].where("inner").select(F.col("node").alias("home"))
        done.append(moved.join(more, "home", "left_anti").select(*names, "home", "gap"))
        if more.isEmpty():
            break
        open_ = moved.join(more, "home", "left_semi").select(*names, "home", "gap")
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    whole = kept.write(whole)
    leaves = kept.write(whole.groupBy("home").agg(*facts).select(leaf.alias("l")).select("l.*"))
    return Tree(whole, leaves, chosen, radius, split, levels, leaves.count())
