"""Operator 7, near-duplicates by BagMinHash signatures, bands, and verified multiset overlap.

A text is the multiset of its five-word windows (words are runs without ASCII white space; a text of one
to four words is one window).  Two texts are linked when the weighted Jaccard similarity of their multisets,
sum of minima over sum of maxima, is 0.8 or more; classes are the connected components of links.

*Signatures.*  Weights are counts, discretised at the whole numbers.  Each window owns a hierarchy of Poisson processes:
one over each of the ranges of weight [0,1), [1,2), [2,4), ..., and a range of several weights is split at its first point into
processes over its halves, down to single weights.  Points come in the order of time, each with a signature slot and a weight
level, from counters and a hash of the window alone, and a text accepts the points below its own weight and drops halves that lie
above it.  A slot keeps its earliest point.  A process is followed only while it can still lower some slot, so long texts cost
little more than one point a window.  Slots of two texts agree with a probability
equal to their weighted Jaccard similarity.

*Candidates.*  48 bands of 8 slots: a pair at 0.8 shares none with a probability of 0.00015.  Texts that are
equal word for word are one node from the start.  Texts that agree in a band are a bucket, and the member whose
buckets hold the most members, all bands taken together, is the bucket's pivot.  All nodes that share a bucket with
a pivot are the pivot's group; both members of any bucket are in its pivot's group, so only groups are compared, and
as central nodes are the pivots of many buckets, a dense group of copies is few groups instead of one a band.

*Verification.*  A group is dealt into blocks of a bounded size, each with the pivot, and a task decides every pair of
a block at once from the whole multisets; only links that join something are given, one for a member at most.  Most
groups are one block and settled by it.  In a larger group that is still more than one component by then, the members
outside its largest component meet all members of the other components, block by block.  No pair of a bucket is left out,
and no table holds more rows than members, but for the blocks of a large group: a member is sent once for each block that
it meets.  Components come from random contraction of the links (``operators.graphs``).  Every stage is a DataFrame;
lineage is cut in the shared checkpoint folder.

Defined cases: null text counts as empty; texts without words are one class; null ids pass through and are never
the class id unless the class has no other; repeated rows belong to the same class; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs
from .common import cut_lineage, require, table, text_of

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 48, 8
SLOTS = BANDS * ROWS
#: Rows and windows of a block on average, and columns of its matrices held at once.
BLOCK, BLOCK_WINDOWS, COLUMNS = 256, 1 << 19, 4096
#: Word hashes kept by a worker within a task.
TABLE_WORDS = 100_000

_P, _C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()


def windows(words: list[bytes], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct window hashes, sorted, and their counts."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * _P + h[j : j + len(out)]
    return np.unique(mix(out), return_counts=True)


def digest(words: list[bytes]) -> tuple[int, int]:
    """128 bits of the word sequence."""
    d = hashlib.md5(b" ".join(words)).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def digest_columns(text_col: str) -> list[Column]:
    """The two halves of :func:`digest` as column expressions."""
    words = F.trim(F.regexp_replace(text_of(text_col), r"[\x20\x09-\x0D]+", " "))
    hexed = F.md5(words.cast("binary"))
    return [F.conv(F.substring(hexed, at, 16), 16, -10).cast("long") for at in (1, 17)]


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """BagMinHash of several multisets at once: (texts, slots) times of the earliest accepted points."""
    best = np.full((len(bags), slots), np.inf)
    doc, seed, start, width, weight = [], [], [], [], []
    for d, (hashes, counts) in enumerate(bags):
        lo, wide = 0, 1
        while len(hashes):
            doc.append(np.full(len(hashes), d, np.int64))
            seed.append(mix(hashes + np.uint64(lo * int(_C3) % 2**64)))
            start.append(np.full(len(hashes), lo, float))
            width.append(np.full(len(hashes), wide, float))
            weight.append(counts.astype(float))
            lo, wide = lo + wide, max(1, lo + wide)
            more = counts > lo
            hashes, counts = hashes[more], counts[more]
    if not doc:
        return best
    doc, seed, start, width, weight = map(np.concatenate, (doc, seed, start, width, weight))
    time, step = np.zeros(len(doc)), np.zeros(len(doc), np.uint64)
    flat, many = best.ravel(), 1
    while len(doc):
        # the next points of each process still followed: one of a range that can be split, `many` of a single weight
        bits = mix(seed[:, None] + (step[:, None] + np.arange(1, many + 1, dtype=np.uint64)) * _P)
        gaps = -np.log(((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / (width * slots)[:, None]
        at = time[:, None] + np.cumsum(gaps, axis=1)
        more = mix(bits ^ _C3)
        slot = ((more >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        level = start[:, None] + (more & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 * width[:, None]
        wide = width > 1
        limit = best.max(axis=1)
        ok = (at < limit[doc][:, None]) & (level < weight[:, None])
        ok[wide, 1:] = False
        np.minimum.at(flat, (doc[:, None] * slots + slot)[ok], at[ok])
        time = np.where(wide, at[:, 0], at[:, -1])
        step += np.uint64(many)
        follow = time < best.max(axis=1)[doc]
        one, two = follow & ~wide, follow & wide
        kept = [x[one] for x in (doc, seed, start, width, weight, time, step)]
        half = width[two] / 2
        halves = [(doc[two], mix(seed[two] ^ salt), start[two] + far * half, half, weight[two], time[two], np.zeros(len(half), np.uint64)) for far, salt in ((0, _C1), (1, _C2))]
        doc, seed, start, width, weight, time, step = (np.concatenate(x) for x in zip(kept, *halves))
        if two.any():
            inside = start < weight
            doc, seed, start, width, weight, time, step = (x[inside] for x in (doc, seed, start, width, weight, time, step))
        many = min(64, 2 * many)
    return best


def bands(best: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(texts, bands) bucket keys."""
    bits = best.view(np.uint64).reshape(len(best), n_bands, rows)
    key = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * _P + bits[:, :, j])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (distinct hashes, counts)."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][ia], b[1][ib]).sum())
    both = int(a[1].sum()) + int(b[1].sum()) - low
    return low / both if both else 1.0


def _pack_bag(bag: tuple[np.ndarray, np.ndarray]) -> bytes:
    return np.repeat(*bag).tobytes()


def _unpack_bag(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.frombuffer(data, np.uint64), return_counts=True)


def _sign(batches):
    """id, text hash, row number, digest, weight and band keys of each row."""
    base, n = TaskContext.get().partitionId() << 36, 0
    for b in batches:
        for at in range(0, b.num_rows, 256):
            ids, hashes, texts = (b.column(k)[at : at + 256] for k in range(3))
            words = [t.as_py().encode("utf-8").split() for t in texts]
            bags = [windows(w) for w in words]
            keys = []
            # runs of about 50 000 windows bound the arrays of processes
            first, size = 0, 0
            for k, (h, _) in enumerate(bags):
                size += len(h)
                if size >= 50_000 or k == len(bags) - 1:
                    keys += bands(signatures(bags[first : k + 1])).tolist()
                    first, size = k + 1, 0
            hi, lo = zip(*map(digest, words))
            row = np.arange(base + n, base + n + len(ids), dtype=np.int64)
            n += len(ids)
            keys = [k if len(h) else None for k, (h, _) in zip(keys, bags)]
            weights = pa.array([int(c.sum()) for _, c in bags], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(row), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), weights, pa.array(keys, pa.list_(pa.int64()))], names=["id", "th", "row", "hi", "lo", "weight", "keys"])
    _HASHES.clear()


def _bags(batches):
    """node and packed multiset."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            bags = [_pack_bag(windows(t.as_py().encode("utf-8").split())) for t in b.column(1)[at : at + 256]]
            yield pa.RecordBatch.from_arrays([b.column(0)[at : at + 256], pa.array(bags, pa.binary())], names=["node", "bag"])
    _HASHES.clear()


def _elements(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of multisets, and all their elements as (key, text): the n-th occurrence of a window is an element of its own."""
    sizes = np.array([len(b) // 8 for b in bags], np.int64)
    text = np.repeat(np.arange(len(bags)), sizes)
    h = np.frombuffer(b"".join(bags), np.uint64)
    at = np.arange(len(h))
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    return sizes, np.where(first, h, mix(h + nth.astype(np.uint64) * _C3)), text


def overlaps(lefts: list[bytes], rights: list[bytes] | None = None) -> np.ndarray:
    """(lefts, rights) weighted Jaccard similarities of packed multisets; of lefts among themselves without rights."""
    n, hl, tl = _elements(lefts)
    m, hr, tr = (n, hl, tl) if rights is None else _elements(rights)
    if rights is None:
        found, counts = np.unique(hl, return_counts=True)
        shared = found[counts > 1]  # an element of one text alone is in no pair
    else:
        shared = np.intersect1d(hl, hr)

    def placed(h: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.searchsorted(shared, h)
        ok = shared[np.minimum(c, len(shared) - 1)] == h if len(shared) else np.zeros(len(h), bool)
        c, t = c[ok], t[ok]
        order = np.argsort(c, kind="stable")
        return c[order], t[order]

    left = placed(hl, tl)
    right = left if rights is None else placed(hr, tr)
    low = np.zeros((len(n), len(m)), np.int64)
    for at in range(0, len(shared), COLUMNS):
        sides = []
        for (c, t), rows in ((left, len(n)), (right, len(m))):
            run = slice(*np.searchsorted(c, (at, at + COLUMNS)))
            has = np.zeros((rows, min(COLUMNS, len(shared) - at)), np.float32)
            has[t[run], c[run] - at] = 1
            sides.append(has)
        low += (sides[0] @ sides[1].T).astype(np.int64)  # counts below 2 ** 24 are exact
    if rights is None:
        np.fill_diagonal(low, n)
    both = n[:, None] + m[None, :] - low
    return np.where(both > 0, low / np.maximum(both, 1), 1.0)


def _stars(pairs) -> list[tuple[int, int]]:
    """(node, smallest node of its component) for the nodes of pairs, but for the smallest ones."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            above[max(x, y)] = min(x, y)
    return [(x, top(x)) for x in above]


def _links(pairs) -> pa.RecordBatch:
    found = _stars(pairs)
    return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])


def _within(batches):
    """Links among the members of each block."""
    for b in batches:
        for k in range(b.num_rows):
            members = b.column(0)[k].as_py()
            nodes, bags = [x["node"] for x in members], [x["bag"] for x in members]
            if len(nodes) == 2:
                i, j = (([0], [1]) if similarity(*map(_unpack_bag, bags)) >= SIMILARITY else ([], []))
            else:
                i, j = (x.tolist() for x in np.nonzero(np.triu(overlaps(bags) >= SIMILARITY, 1)))
            yield _links((nodes[x], nodes[y]) for x, y in zip(i, j))


def _across(batches):
    """Links between the roots of a block of lefts and a block of rights; every pair across components is decided."""
    for b in batches:
        for k in range(b.num_rows):
            lefts, rights = b.column(0)[k].as_py(), b.column(1)[k].as_py()
            a, c = (np.array([x["root"] for x in side]) for side in (lefts, rights))
            i, j = np.nonzero((overlaps([x["bag"] for x in lefts], [x["bag"] for x in rights]) >= SIMILARITY) & (a[:, None] != c[None, :]))
            yield _links(zip(a[i].tolist(), c[j].tolist()))


def _blocks(side: DataFrame, name: str) -> DataFrame:
    """Number of blocks of each pivot's rows in ``side`` (pivot, weight, ...)."""
    return side.groupBy("pivot").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("weight") / BLOCK_WINDOWS)).alias(name))


def compare_within(groups: DataFrame, sizes: DataFrame, bags: DataFrame) -> DataFrame:
    """Links (u, v) inside the blocks of each group (pivot, node, weight); the pivot is in every block of its group."""
    own = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks"))))
    dealt = groups.join(sizes, "pivot").select("pivot", "node", F.explode(own).alias("block"))
    gathered = dealt.join(bags, "node").groupBy("pivot", "block").agg(F.collect_list(F.struct("node", "bag")).alias("members"))
    return cut_lineage(gathered.select("members").mapInArrow(_within, "u long, v long").distinct())


def compare_across(groups: DataFrame, sizes: DataFrame, known: DataFrame, bags: DataFrame) -> DataFrame:
    """Links (u, v) between the components ``known`` (node, root) of groups of several blocks.

    Members outside a group's largest component are the lefts, all members the rights; a left meets every block of
    rights and a right every block of lefts, so no task holds more than two blocks.
    """
    large = groups.join(sizes.where("blocks > 1").select("pivot"), "pivot", "left_semi")
    placed = large.join(known, "node", "left").select("pivot", "node", "weight", F.coalesce("root", "node").alias("root"))
    parts = placed.groupBy("pivot", "root").agg(F.count(F.lit(1)).alias("n"))
    most = parts.groupBy("pivot").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    rows = cut_lineage(placed.join(most, "pivot").select("pivot", "node", "weight", "root", "largest"))
    left, right = rows.where("root <> largest"), rows
    counts = cut_lineage(_blocks(left, "nl").join(_blocks(right, "nr"), "pivot"))  # a row for each group, so that joins with it can split a large one

    def deal(side: DataFrame, own: str, other: str, at: str, meets: str) -> DataFrame:
        dealt = side.join(counts, "pivot").withColumn(at, F.pmod(F.xxhash64("node"), F.col(own)))
        met = dealt.select("pivot", at, "node", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(meets))
        return met.join(bags, "node").groupBy("pivot", "i", "j").agg(F.collect_list(F.struct("node", "root", "bag")).alias(f"{at}_x"))

    both = deal(left, "nl", "nr", "i", "j").join(deal(right, "nr", "nl", "j", "i"), ["pivot", "i", "j"])
    return cut_lineage(both.select("i_x", "j_x").mapInArrow(_across, "u long, v long").distinct())


def components(links: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) for every node of a link (u, v) but the roots."""
    return graphs.components(links.select(F.col("u").alias("a"), F.col("v").alias("b"))).where("node <> root")


def pivot_groups(members: DataFrame) -> DataFrame:
    """Distinct (pivot, node) of the members (key, node) of all buckets of two or more; a pivot is in its own group."""
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # counted before the shuffle
    met = cut_lineage(members.join(counts, "key").select("key", "node", "n"))
    degree = met.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = met.select("key", "node").join(degree, "node")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("first")).select("key", F.col("first.node").alias("pivot"))
    return met.select("key", "node").join(pivots, "key").select("pivot", "node").distinct()


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, class_id (smallest id of its class), class_size, kept, and __rw_hi, __rw_lo of its words."""
    require(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).alias("text"))
    signed = cut_lineage(texts.mapInArrow(_sign, f"id {kind}, th long, row long, hi long, lo long, weight long, keys array<long>"))
    # texts that are equal word for word are one node, named by the first of their rows
    first = F.min(F.struct("row", "id", "th", "weight", "keys")).alias("first")
    nodes = cut_lineage(signed.groupBy("hi", "lo").agg(first, F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")).select("hi", "lo", F.col("first.row").alias("node"), "first.id", "first.th", "first.weight", "first.keys", "least", "copies"))
    met = pivot_groups(nodes.select(F.explode("keys").alias("key"), "node"))
    groups = cut_lineage(met.join(nodes.select("node", "weight", "id", "th"), "node"))
    wanted = groups.groupBy("node").agg(F.first("id").alias("id"), F.first("th").alias("th"))
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.th") == F.col("b.th"))
    held = wanted.alias("a").join(texts.alias("b"), same).select("a.node", "b.text").dropDuplicates(["node"])  # repeated rows
    bags = cut_lineage(held.mapInArrow(_bags, "node long, bag binary"))
    groups = groups.select("pivot", "node", "weight")
    sizes = cut_lineage(_blocks(groups, "blocks"))
    roots = components(compare_within(groups, sizes, bags))
    if not sizes.where("blocks > 1").isEmpty():
        further = components(compare_across(groups, sizes, roots, bags))
        # roots of the first components may have got a smaller one
        moved = roots.join(further.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = moved.union(further)
    placed = cut_lineage(nodes.select("hi", "lo", "node", "least", "copies").join(roots, "node", "left").select("hi", "lo", "least", "copies", F.coalesce("root", "node").alias("root")))
    found = cut_lineage(placed.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size")))  # apart from the join, which can split a large class
    named = placed.join(found, "root").select("hi", "lo", "class_id", "class_size")
    rows = signed.select("id", "hi", "lo").join(named, ["hi", "lo"])
    return rows.select(F.col("id").alias(id_col), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), F.col("hi").alias("__rw_hi"), F.col("lo").alias("__rw_lo"))


def survivors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of each class with the smallest id, with all columns; rows that agree in id and words stay or go together."""
    stay = classes(df, id_col, text_col).where("kept").select(F.col(id_col).alias("__rw_id"), "__rw_hi", "__rw_lo").distinct()
    hi, lo = digest_columns(text_col)
    keyed = df.withColumns({"__rw_h": hi, "__rw_l": lo})
    return keyed.join(stay, F.col(id_col).eqNullSafe(F.col("__rw_id")) & (F.col("__rw_h") == F.col("__rw_hi")) & (F.col("__rw_l") == F.col("__rw_lo")), "left_semi").select(*(F.col(f"`{c}`") for c in df.columns))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


QUERIES = {"op7_near_dedup": op7_near_dedup}
ORACLES: dict[str, str] = {}
