"""Operator 12, hard negatives by vantage-point trees over norm-augmented vectors.

With M the largest norm, every row x gets one more place, sqrt(M^2 - |x|^2), and an anchor q a nought.  Then the squared
distance of q and x is |q|^2 + M^2 - 2 qx: the nearest row has the largest inner product, and a window of scores is an
annulus of distances around the anchor.

*Tree.*  A node of a vantage-point tree keeps a vector and the ranges of its rows' distances to it, half of the rows in each of
two children; by the triangle inequality a range and the anchor's own distance to that vector bound the distances of a child's
rows to the anchor from both sides.  The upper levels are made from a bounded sample and deal all rows into cells; the
rows of a cell are dealt into blocks of a bounded size, each with a tree of its own, written once in the shared folder.

*Search.*  From the root, nodes are visited nearest first.  One whose rows all lie inside an annulus, or beyond it or beyond the k
best rows so far, is left out for it; the search ends when all that is left is beyond.  An anchor's windows share one traversal.
Scores are exact whole numbers; bounds allow for rounding, so the result is that of a full search.

*Plan.*  Anchors are the query set.  First each visits one block of its nearest cell, which gives a bound on what else is worth
a visit; then the blocks of all cells that its bound can reach.  Blocks are dealt into groups.  A task holds a bounded number of
anchors and streams one group, so an anchor is sent once for each group and not for each block, and gives at most k rows for each window
and group; ranks cut those before their shuffle.  The driver gets the cells, their sizes and a bounded sample; joins are hinted, since the
planner takes the anchors for a small table and would broadcast what comes of them.

Defined cases: rows with a null id or label, or a vector that is null, empty, of another length than that of the smallest id, or holds a null,
non-finite or huge component, take no part; of rows that share an anchor's id the smallest label and vector is the anchor, and none
of them is its positive or negative; other repeated rows count one by one; ties go to the smaller id; a window of a positive with a
negative score is empty; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import Stored
from .common import require, table
from .vectors import integer_vectors

POSITIVES, NEGATIVES, LOW_PERCENT = 5, 5, 80
#: Rows of a block on average, of a leaf at most, and anchors of a part on average.
BLOCK, LEAF, PART = 2048, 128, 256
#: Groups of blocks, blocks of a group beyond which there are more of them, and anchors that a task holds on average.
GROUPS, GROUP, HELD = 64, 16, 8192
#: Whole numbers below this are exact in floating point.
EXACT = 2.0**52
#: Cells and rows of the sample that they are made from, at most.
CELLS, SAMPLE = 1024, 4096


@dataclass
class Tree:
    """Nodes, parents first: (vantage row, near child, far child, least and largest distance of the near rows, of the far rows); a child -k-1 is leaf k, rows starts[k] to starts[k + 1]."""

    order: np.ndarray
    nodes: np.ndarray
    starts: np.ndarray


def build(v: np.ndarray, beside: np.ndarray, leaf: int = LEAF) -> Tree:
    """A tree over rows ``v`` (float64 whole numbers) with augmented places ``beside``."""
    norm, nodes, starts, order = (v**2).sum(axis=1), [], [0], []
    todo = [(np.arange(len(v)), -1, 0)]

    def gap(rows: np.ndarray, k: int) -> np.ndarray:
        return np.sqrt(np.maximum(norm[rows] + norm[k] - 2 * (v[rows] @ v[k]) + (beside[rows] - beside[k]) ** 2, 0))

    while todo:
        rows, parent, side = todo.pop()
        if len(rows) <= leaf:
            me = -len(starts)
            order.append(rows)
            starts.append(starts[-1] + len(rows))
        else:
            me = len(nodes)
            k = rows[gap(rows, rows[0]).argmax()]  # a row at the rim tells more than one in the middle
            d = gap(rows, k)
            by = d.argsort(kind="stable")
            half = len(rows) // 2
            near, far = d[by[:half]], d[by[half:]]
            nodes.append([k, 0, 0, near[0], near[-1], far[0], far[-1]])
            todo += [(rows[by[half:]], me, 2), (rows[by[:half]], me, 1)]
        if parent >= 0:
            nodes[parent][side] = me
    return Tree(np.concatenate(order), np.array(nodes, float).reshape(-1, 7), np.array(starts))


@dataclass
class Wish:
    """What one window still takes: rows of scores ``low`` to ``high``, better than the k-th so far."""

    low: int
    high: int
    k: int
    found: list[tuple[int, int]]

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = (scores >= self.low) & (scores <= self.high)
        if ok.any():
            s, i = scores[ok], ids[ok]
            if len(s) > self.k:
                best = np.lexsort((i, -s))[: self.k]
                s, i = s[best], i[best]
            self.found = sorted([*self.found, *zip((-s).tolist(), i.tolist())])[: self.k]
            if len(self.found) == self.k:
                self.low = max(self.low, -self.found[-1][0])


def search(q: np.ndarray, wishes: list[Wish], most: float, v: np.ndarray, usable: np.ndarray, ids: np.ndarray, tree: Tree) -> int:
    """Fill ``wishes`` from a block's rows (in tree order) where ``usable``, nearest first; the number of leaves read."""
    q2 = float(q @ q)
    top = q2 + most
    slack = 1e-6 + 1e-9 * top
    away = np.sqrt(np.maximum(top - 2 * (v[tree.nodes[:, 0].astype(int)] @ q), 0)) if len(tree.nodes) else ()
    heap, read = [(0.0, 0 if len(tree.nodes) else -1, np.inf)], 0
    while heap:
        least, k, largest = heapq.heappop(heap)
        best, worst = (top - least * least) / 2 + slack, (top - largest * largest) / 2 - slack
        wishes = [w for w in wishes if best >= w.low]
        if not wishes:
            break  # all that is left is farther
        if all(worst > w.high for w in wishes):
            continue
        if k < 0:
            rows = slice(tree.starts[-k - 1], tree.starts[-k])
            keep = usable[rows]
            x, own = v[rows][keep], ids[rows][keep]
            scores = (x @ q).astype(np.int64) if top < EXACT else x.astype(np.int64) @ q.astype(np.int64)
            read += 1
            for w in wishes:
                w.take(scores, own)
            continue
        d, (_, near, far, n0, n1, f0, f1) = away[k], tree.nodes[k]
        heapq.heappush(heap, (max(least, n0 - d, d - n1), int(near), min(largest, d + n1)))
        heapq.heappush(heap, (max(least, f0 - d, d - f1), int(far), min(largest, d + f1)))
    return read


#: Below all scores, and rows of leaves that are held before they are ranked.
NONE, RANKED = -(2**63) + 1, 1 << 18


class Best:
    """The first k rows of each window of many anchors, best first; ``low`` and ``high`` (anchors, windows) are whole numbers, no score fits where low is the larger one."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.score, self.id = np.full((*low.shape, k), NONE), np.zeros((*low.shape, k), np.int64)

    def take(self, anchor: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        for w in range(self.low.shape[1]):
            ok = (scores >= self.low[anchor, w]) & (scores <= self.high[anchor, w])
            if ok.any():
                who = np.unique(anchor[ok])
                at = np.concatenate([np.repeat(who, self.k), anchor[ok]])
                s, i = np.concatenate([self.score[who, w].ravel(), scores[ok]]), np.concatenate([self.id[who, w].ravel(), ids[ok]])
                order = np.lexsort((i, -s, at))
                first = order[np.searchsorted(at[order], who)[:, None] + np.arange(self.k)]
                self.score[who, w], self.id[who, w] = s[first], i[first]
                self.low[who, w] = np.maximum(self.low[who, w], self.score[who, w, -1])


def sweep(q: np.ndarray, places: np.ndarray, best: Best, most: float, v: np.ndarray, fits, ids: np.ndarray, tree: Tree) -> int:
    """Fill ``best`` at ``places``, those of the anchors ``q``, from a block's rows where ``fits`` (places, rows); bounds as in ``search``, for all anchors at once; the number of leaves read."""
    top = (q**2).sum(axis=1) + most
    slack, exact, read = 1e-6 + 1e-9 * top, top.max() < EXACT, 0
    away = np.sqrt(np.maximum(top[:, None] - 2 * (q @ v[tree.nodes[:, 0].astype(int)].T), 0))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def rank() -> None:
        if found:
            best.take(*(np.concatenate(c) for c in zip(*found)))
            found.clear()

    todo = [(0 if len(tree.nodes) else -1, np.arange(len(q)), np.zeros(len(q)), np.full(len(q), np.inf))]
    while todo:
        k, some, least, largest = todo.pop()
        near, far = (top[some] - least**2) / 2 + slack[some], (top[some] - largest**2) / 2 - slack[some]
        low, high = best.low[places[some]], best.high[places[some]]
        open_ = ((near[:, None] >= low) & (far[:, None] <= high) & (low <= high)).any(axis=1)
        some, least, largest = some[open_], least[open_], largest[open_]
        if not len(some):
            continue
        if k >= 0:
            d, (_, inner, outer, n0, n1, f0, f1) = away[some, k], tree.nodes[k]
            todo.append((int(outer), some, np.maximum(np.maximum(least, f0 - d), d - f1), np.minimum(largest, d + f1)))
            todo.append((int(inner), some, np.maximum(np.maximum(least, n0 - d), d - n1), np.minimum(largest, d + n1)))
            continue
        rows = slice(tree.starts[-k - 1], tree.starts[-k])
        read += 1
        scores = q[some] @ v[rows].T if exact else q[some].astype(np.int64) @ v[rows].T.astype(np.int64)
        i, j = np.nonzero((scores >= low[open_].min(axis=1)[:, None]) & (scores <= high[open_].max(axis=1)[:, None]))
        if len(i):
            at = places[some[i]]
            ok = fits(at, rows.start + j)
            found.append((at[ok], scores[i[ok], j[ok]].astype(np.int64), ids[rows][j[ok]]))
            if sum(len(f[0]) for f in found) > RANKED:
                rank()
    rank()
    return read


def _ints(data) -> np.ndarray:
    return np.frombuffer(data, "<i4").astype(float)


@dataclass
class Meeting:
    """Rows of anchors that a task holds, and their types; blocks come after them."""

    held: list[dict] = field(default_factory=list)
    kinds: pa.Schema | None = None

    def blocks(self, batches):
        """(places of the anchors that want it, ids, labels, vectors, tree) of each block."""
        asking = defaultdict(list)
        for b in batches:
            meeting, number, split = b.column("meeting").to_pylist(), b.column("number").to_pylist(), b.column("side").to_pylist().count(0)
            self.kinds = pa.schema([b.schema.field(c) for c in ("anchor", "label", "v", "windows")])
            for m, x in zip(meeting, b.select([*self.kinds.names, "wanted"]).slice(0, split).to_pylist()):
                for n in x.pop("wanted"):
                    asking[m, n].append(len(self.held))
                self.held.append(x)
            for r in range(split, b.num_rows):
                if own := asking.pop((meeting[r], number[r]), None):
                    ids, labels = b.column("ids")[r].values.to_numpy(), np.array(b.column("labels")[r].as_py())
                    tree = Tree(np.arange(len(ids)), b.column("nodes")[r].values.to_numpy().reshape(-1, 7), b.column("starts")[r].values.to_numpy())
                    yield own, ids, labels, _ints(b.column("vs")[r].as_buffer()).reshape(len(ids), -1), tree


class Cells:
    """The upper levels: cells of a tree over a sample, split at the middle of the gap between near and far rows."""

    def __init__(self, sample: np.ndarray, most: float, cells: int):
        self.most, self.vantage, self.beside = most, np.zeros((0, 0)), np.zeros(0)
        self.children, self.radius, self.n = np.zeros((0, 2), int), np.zeros(0), 1
        if cells > 1 and len(sample) > 1:
            beside = np.sqrt(np.maximum(most - (sample**2).sum(axis=1), 0))
            tree = build(sample, beside, max(1, len(sample) // cells))
            at = tree.nodes[:, 0].astype(int)
            self.vantage, self.beside = sample[at], beside[at]
            self.children, self.radius = tree.nodes[:, 1:3].astype(int), (tree.nodes[:, 4] + tree.nodes[:, 5]) / 2
            self.n = len(tree.starts) - 1

    def place(self, v: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        cell = np.zeros(len(v), int)
        if not len(self.children):
            return cell
        norm = (v**2).sum(axis=1)
        beside = np.sqrt(np.maximum(self.most - norm, 0))
        todo = [(0, np.arange(len(v)))]
        while todo:
            k, rows = todo.pop()
            if k < 0:
                cell[rows] = -k - 1
            elif len(rows):
                p = self.vantage[k]
                d = np.sqrt(np.maximum(norm[rows] + p @ p - 2 * (v[rows] @ p) + (beside[rows] - self.beside[k]) ** 2, 0))
                near = d <= self.radius[k]
                todo += [(self.children[k, 0], rows[near]), (self.children[k, 1], rows[~near])]
        return cell

    def scores(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchors, cells): the least and the largest score that a cell's rows can have."""
        top = (q**2).sum(axis=1) + self.most
        least, largest = np.zeros((len(q), self.n)), np.full((len(q), self.n), np.inf)
        if len(self.children):
            away = np.sqrt(np.maximum(top[:, None] - 2 * (q @ self.vantage.T), 0))
            todo = [(0, np.zeros(len(q)), np.full(len(q), np.inf))]
            while todo:
                k, a, b = todo.pop()
                if k < 0:
                    least[:, -k - 1], largest[:, -k - 1] = a, b
                else:
                    d, r = away[:, k], self.radius[k]
                    slack = 1e-9 * (r + d)  # rows are placed by rounded distances
                    todo += [(self.children[k, 0], np.maximum(a, d - r - slack), np.minimum(b, d + r + slack)), (self.children[k, 1], np.maximum(a, r - d - slack), b)]
        slack = (1e-6 + 1e-9 * top)[:, None]
        return (top[:, None] - largest**2) / 2 - slack, (top[:, None] - least**2) / 2 + slack


def _sample(rows: DataFrame, count: int) -> DataFrame:
    """(__rw_v): at most ``SAMPLE`` of ``count`` rows, the same ones each time."""
    at = F.xxhash64("__rw_id", "__rw_v")
    share = min(1.0, 2 * SAMPLE / max(1, count))  # each partition's first rows reach the driver, so few are left in all
    few = rows if share == 1 else rows.where(at < int(share * 2**64) - 2**63)
    return few.orderBy(at, "__rw_id", "__rw_v").limit(SAMPLE).select("__rw_v")


class Index:
    """Rows (__rw_id, __rw_v, __rw_label) as blocks with trees, in the shared folder."""

    def __init__(self, rows: DataFrame, kept: Stored, block: int = BLOCK, cells: int = CELLS, leaf: int = LEAF):
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("__rw_v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)).alias("m")).first()
        self.count, self.most = facts["n"], float(facts["m"] or 0)
        wanted = min(cells, -(-self.count // block))
        sample = [r["__rw_v"] for r in _sample(rows, self.count).collect()] if wanted > 1 else []
        self.cells = Cells(np.array(sample, float), self.most, wanted)
        cells_, most = self.cells, self.most

        def placed(batches):
            for b in batches:
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                data = pa.array([r.tobytes() for r in v.astype("<i4")], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), data, pa.array(cells_.place(v.astype(float)).astype(np.int32))], names=["id", "label", "v", "cell"])

        kind = rows.schema["__rw_label"].dataType.simpleString()
        dealt = kept.write(rows.select("__rw_id", "__rw_v", "__rw_label").mapInArrow(placed, f"id long, label {kind}, v binary, cell int"))
        sizes = dealt.groupBy("cell").count().collect()  # one row a cell
        self.blocks = {r["cell"]: -(-r["count"] // block) for r in sorted(sizes)}
        self.total = sum(self.blocks.values())
        self.groups = max(1, min(GROUPS, self.total), -(-self.total // GROUP))
        first = dict(zip(self.blocks, np.cumsum([0, *self.blocks.values()]).tolist()))  # blocks are numbered cell by cell
        total, groups = self.total, self.groups
        per = F.create_map(*(F.lit(x) for k, n in self.blocks.items() for x in (k, n))) if self.blocks else F.lit(None).cast("map<int,int>")
        own = F.pmod(F.xxhash64("id"), per[F.col("cell")]).cast("int").alias("block")
        grouped = dealt.select("cell", own, F.struct("id", "label", "v").alias("row")).groupBy("cell", "block").agg(F.collect_list("row").alias("rows"))

        def trees(batches):
            for b in batches:
                for k in range(b.num_rows):
                    rows_ = b.column(2)[k].values
                    ids, labels = rows_.field("id").to_numpy(), rows_.field("label")
                    v = np.stack([_ints(x.as_buffer()) for x in rows_.field("v")])
                    tree = build(v, np.sqrt(np.maximum(most - (v**2).sum(axis=1), 0)), leaf)
                    at = np.argsort(tree.order)
                    nodes = tree.nodes.copy()
                    nodes[:, 0] = at[nodes[:, 0].astype(int)]
                    data = v[tree.order].astype("<i4").tobytes()
                    number = first[b.column(0)[k].as_py()] + b.column(1)[k].as_py()
                    cols = [pa.array([number], pa.int32()), pa.array([number * groups // total], pa.int32()), pa.array([ids[tree.order].tolist()], pa.list_(pa.int64())), pa.array([labels.take(pa.array(tree.order)).to_pylist()], pa.list_(labels.type)), pa.array([data], pa.binary()), pa.array([nodes.ravel().tolist()], pa.list_(pa.float64())), pa.array([tree.starts.tolist()], pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["number", "group", "ids", "labels", "vs", "nodes", "starts"])

        self.trees = kept.write(grouped.mapInArrow(trees, f"number int, group int, ids array<long>, labels array<{kind}>, vs binary, nodes array<double>, starts array<int>"))

    def visit(self, wishes: DataFrame, same: bool, k: int, first: bool, count: int) -> DataFrame:
        """``wishes`` with floors that one block of each anchor's nearest cell gives (``first``), or (anchor, place, other, score): up to k rows of each window from each group of blocks.

        ``wishes`` has ``count`` rows: anchor, label, v (binary) and windows, an array of (place, low, high, floor); scores from low to high
        are wanted, and only those from floor up.  Anchors that no cell can serve are left out.
        """
        cells_, most, blocks, groups = self.cells, self.most, self.blocks, self.groups
        cell_of = np.repeat(np.array(list(blocks), int), list(blocks.values()))
        group_of = np.arange(self.total) * groups // max(1, self.total)
        chunks, parts = max(1, -(-count // HELD)), max(1, -(-count // PART))

        def targets(batches):
            for b in batches:
                rows, meeting, wanted = [], [], []
                q = np.stack([_ints(x.as_buffer()) for x in b.column("v")]) if b.num_rows else np.zeros((0, 0))
                chunk = b.column("chunk").to_numpy()
                for r, (least, largest, ws) in enumerate(zip(*cells_.scores(q), b.column("windows").to_pylist())):
                    reach = np.zeros(cells_.n, bool)
                    for w in ws:
                        if w["floor"] <= w["high"]:
                            reach |= (largest >= w["floor"]) & (least <= w["high"])
                    numbers = np.flatnonzero(reach[cell_of])
                    if first and len(numbers):
                        home = cell_of[numbers[largest[cell_of[numbers]].argmax()]]
                        numbers = np.flatnonzero(cell_of == home)
                        one = (b.column("anchor")[r].as_py() * 0x9E3779B97F4A7C15 % 2**64 >> 32) % len(numbers)
                        numbers = numbers[one : one + 1]
                    for g in np.unique(group_of[numbers]).tolist():
                        rows.append(r)
                        meeting.append(int(chunk[r]) * groups + g)
                        wanted.append(numbers[group_of[numbers] == g])
                taken = b.select(["anchor", "label", "v", "windows"]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(wanted, pa.list_(pa.int32())), pa.array(meeting, pa.int32())], names=[*taken.schema.names, "wanted", "meeting"])

        label = wishes.schema["label"].dataType.simpleString()
        shape = f"anchor long, label {label}, v binary, windows array<struct<place: int, low: long, high: long, floor: long>>"
        chunk = F.pmod(F.xxhash64("anchor"), F.lit(chunks)).cast("int").alias("chunk")
        coming = wishes.select("anchor", "label", "v", "windows", chunk).repartition(parts, "anchor").mapInArrow(targets, f"{shape}, wanted array<int>, meeting int")
        there = self.trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("meeting", (F.col("chunk") * groups + F.col("group")).cast("int")).drop("chunk", "group")
        both = coming.withColumn("side", F.lit(0)).unionByName(there.withColumn("side", F.lit(1)), allowMissingColumns=True)
        met = both.repartitionById(chunks * groups, "meeting").sortWithinPartitions("side", "meeting")

        def raised(batches):
            meeting = Meeting()
            for own, ids, labels, v, tree in meeting.blocks(batches):
                for x in (meeting.held[a] for a in own):
                    ws = [Wish(w["low"], w["high"], k, []) for w in x["windows"]]
                    usable = ((labels == x["label"]) if same else (labels != x["label"])) & (ids != x["anchor"])
                    search(_ints(x["v"]), [w for w in ws if w.low <= w.high], most, v, usable, ids, tree)
                    x["windows"] = [w | {"floor": wish.low} for w, wish in zip(x["windows"], ws)]
            for at in range(0, len(meeting.held), PART):
                yield pa.RecordBatch.from_pylist(meeting.held[at : at + PART], meeting.kinds)

        def answers(batches):
            meeting, best = Meeting(), None
            for own, ids, labels, v, tree in meeting.blocks(batches):
                if best is None:  # all anchors are there
                    held = meeting.held
                    anchor, own_labels, q = np.array([x["anchor"] for x in held]), np.array([x["label"] for x in held]), np.stack([_ints(x["v"]) for x in held])
                    place, low, high = (np.full((len(held), max(len(x["windows"]) for x in held)), n) for n in (-1, 2**62, -(2**62)))
                    for a, x in enumerate(held):
                        for n, w in enumerate(x["windows"]):
                            place[a, n], low[a, n], high[a, n] = w["place"], w["floor"], w["high"]
                    best = Best(low, high, k)
                places = np.array(own)
                sweep(q[places], places, best, most, v, lambda a, j: ((labels[j] == own_labels[a]) == same) & (ids[j] != anchor[a]), ids, tree)  # noqa: B023
            if best is not None:
                a, n, at = np.nonzero(best.score > NONE)
                cols = (anchor[a], place[a, n].astype(np.int32), best.id[a, n, at], best.score[a, n, at])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "place", "other", "score"])

        return met.mapInArrow(raised, shape) if first else met.mapInArrow(answers, "anchor long, place int, other long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each window, with their rank; ranks are cut before the shuffle too."""
    place = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _best(index: Index, kept: Stored, wishes: DataFrame, same: bool, k: int, count: int) -> DataFrame:
    """The first k rows of each window of ``wishes`` over all blocks, written."""
    raised = kept.write(index.visit(wishes, same, k, True, count)) if index.total > 1 else wishes
    return kept.write(_ranked(index.visit(raised, same, k, False, count), k))


def mine(df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT, block: int = BLOCK, cells: int = CELLS, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id, as ``anchors`` sees it, is wanted.  A positive's negatives are the first rows of other labels with scores from
    ``low_percent`` of the positive's to the positive's own.
    """
    require(df, id_col, vector_col, label_col)
    spark = df.sparkSession
    rows, _ = integer_vectors(df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()), id_col, vector_col, label_col)
    rows = rows.select(F.col("__rw_id").cast("long").alias("__rw_id"), "__rw_v", F.col(f"__rw_{label_col}").alias("__rw_label"))
    kept = Stored(spark)
    index = Index(rows, kept, block, cells, leaf)
    chosen = rows.withColumnRenamed("__rw_id", id_col).where(anchors).groupBy(F.col(id_col).alias("anchor")).agg(F.min(F.struct("__rw_label", "__rw_v")).alias("r"))

    def packed(batches):
        for b in batches:
            v = b.column(2).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in v], pa.binary())], names=["anchor", "label", "v"])

    kind = rows.schema["__rw_label"].dataType.simpleString()
    asked = kept.write(chosen.select("anchor", "r.__rw_label", "r.__rw_v").mapInArrow(packed, f"anchor long, label {kind}, v binary"))
    count = asked.count()
    least, largest = F.lit(-(2**62)).cast("long"), F.lit(2**62).cast("long")
    everything = F.array(F.struct(F.lit(0).alias("place"), least.alias("low"), largest.alias("high"), least.alias("floor")))
    near = _best(index, kept, asked.withColumn("windows", everything), True, positives, count)
    low = F.ceil(F.col("score").cast("decimal(20,0)") * low_percent / 100)
    window = F.struct(F.col("rank").alias("place"), low.cast("long").alias("low"), F.col("score").alias("high"), low.cast("long").alias("floor"))
    gathered = near.select("anchor", window.alias("w")).groupBy("anchor").agg(F.sort_array(F.collect_list("w")).alias("windows"))  # a few positives for each anchor
    found = _best(index, kept, asked.join(gathered.hint("merge"), "anchor"), False, negatives, count)
    named = near.select("anchor", F.col("rank").alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(named.hint("merge"), ["anchor", "place"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", changed), F.col("vec_id") % 100 == 0)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {
    "op12_hard_negatives": """WITH k AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS MATERIALIZED (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM k a JOIN k b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INT) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score QUALIFY rank <= 5"""
}
