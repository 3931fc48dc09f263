"""Operator 10, packing: Karmarkar-Karp multiway differencing into near-equal windows.

Every task encodes its own rows and packs them; nothing is shuffled, so no key can be hot.  Whole
windows of a long document are sequences of their own.  What remains of a document is one piece, and
pieces are gathered into pools worth ``windows`` sequences.  In a pool, differencing starts with one
partial partition for each piece and always merges the two partitions of the largest spread, the
fullest window of one with the emptiest of the other, so windows of whole pieces come out near-equal.
What a window holds above the capacity is cut off its largest piece and fills the room that other
windows have left; if their room isn't enough, the window count rises and the pool is dealt again.
The last tokens of a task, less than one window, become sequences whose lengths are
powers of two, which need no padding.

Defined cases: null text counts as empty; an empty document is its end id alone; null ids pass
through; repeated rows are packed each on their own; an empty table gives an empty result; further
input columns are ignored.  Tasks are repeatable: a lost task gives the same sequences again, since
ids come from its partition's number and its rows' order in the files.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import require, table, text_of
from .encoding import by_bytes, encoder

CAPACITY = 2048
END_ID = 1
#: Windows of a pool.
WINDOWS = 128


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of ``sizes`` dealt into k windows of nearly equal sums.

    A merge only keeps its sums and their order; who lies where is read back from the root at the end.
    """
    n = len(sizes)
    if k <= 1 or not n:
        return [list(range(n))] + [[] for _ in range(k - 1)]
    heap: list = []
    sums: list = []
    merges: list = []
    for i, s in enumerate(sizes):
        alone = np.zeros(k, np.int64)
        alone[-1] = s  # ascending
        sums.append(alone)
        heap.append((-s, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums[a] + sums[b][::-1]
        order = both.argsort(kind="stable")
        both = both[order]
        sums[a] = sums[b] = None
        heapq.heappush(heap, (int(both[0] - both[-1]), len(sums)))
        sums.append(both)
        merges.append((a, b, order))
    at = {heap[0][1]: np.arange(k)}  # position in the node of each window of the root
    windows: list[list[int]] = [[] for _ in range(k)]
    for node in range(n + len(merges) - 1, n - 1, -1):
        a, b, order = merges[node - n]
        mine = order[at.pop(node)]
        for child, position in ((a, mine), (b, k - 1 - mine)):
            if child < n:
                windows[int((position == k - 1).argmax())].append(child)
            else:
                at[child] = position
    return windows


def _cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
    """The first n tokens of a piece (row, start, ids), and the rest."""
    row, start, ids = piece
    return (row, start, ids[: 4 * n]), (row, start + n, ids[4 * n :])


def level(windows: list[list], capacity: int) -> None:
    """Move what windows hold above the capacity into the room of others, which must be enough."""
    size = lambda p: len(p[2]) // 4
    spare, room = [], []
    for k, w in enumerate(windows):
        excess = sum(map(size, w)) - capacity
        while excess > 0:
            i = max(range(len(w)), key=lambda i: size(w[i]))
            n = min(excess, size(w[i]))
            head, tail = _cut(w[i], size(w[i]) - n)
            spare.append(tail)
            w[i : i + 1] = [head] if head[2] else []
            excess -= n
        if excess < 0:
            room.append((-excess, k))
    room.sort()
    for part in sorted(spare, key=size, reverse=True):
        while part[2]:
            # the smallest room that takes all of it, else the largest
            at = min(bisect.bisect_left(room, (size(part), 0)), len(room) - 1)
            free, k = room.pop(at)
            head, part = _cut(part, min(free, size(part)))
            windows[k].append(head)
            if free > size(head):
                bisect.insort(room, (free - size(head), k))


class Packer:
    """Packs pieces of (row, start, id bytes); ``out`` gets (row, start, length, crc32, sequence, offset)."""

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows = capacity, windows
        self.pool: deque = deque()
        self.held, self.sequence, self.out = 0, 0, []

    def _emit(self, members) -> None:
        offset = 0
        for row, start, ids in members:
            n = len(ids) // 4
            self.out.append((row, start, n, zlib.crc32(ids), self.sequence, offset))
            offset += n
        self.sequence += 1

    def add(self, row, ids: bytes) -> None:
        n, at = len(ids) // 4, 0
        while n - at >= self.capacity:
            self._emit([(row, at, ids[4 * at : 4 * (at + self.capacity)])])
            at += self.capacity
        if at < n:
            self.pool.append((row, at, ids[4 * at :]))
            self.held += n - at
        full = self.windows * self.capacity
        while self.held >= full:
            self._deal(self._take(full), self.windows)

    def _take(self, tokens: int) -> list:
        """The first pieces of the pool, exactly so many tokens; the last one is cut."""
        got = []
        while tokens:
            piece = self.pool.popleft()
            if (n := len(piece[2]) // 4) > tokens:
                piece, rest = _cut(piece, tokens)
                self.pool.appendleft(rest)
                n = tokens
            got.append(piece)
            tokens -= n
            self.held -= n
        return got

    def _deal(self, pieces: list, k: int) -> None:
        sizes = [len(p[2]) // 4 for p in pieces]
        while sum(sizes) > k * self.capacity:
            k += 1
        windows = [[pieces[i] for i in sorted(w)] for w in difference(sizes, k)]
        level(windows, self.capacity)
        for w in windows:
            if w:
                self._emit(w)

    def finish(self) -> None:
        if k := self.held // self.capacity:
            self._deal(self._take(k * self.capacity), k)
        while self.held:
            self._emit(self._take(min(self.capacity, 1 << (self.held.bit_length() - 1))))


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, windows: int = WINDOWS) -> DataFrame:
    """One row per piece: where it comes from, which sequence holds it, and where in there."""
    require(df, id_col, text_col)
    end = int(end_id).to_bytes(4, "little")
    kind = df.schema[id_col].dataType.simpleString()

    def packed(batches):
        enc, packer = encoder(tokenizer), Packer(capacity, windows)
        base = TaskContext.get().partitionId() << 32
        id_type = None

        def rows():
            got, packer.out = packer.out, []
            cols = list(zip(*got))
            docs, tokens = zip(*cols[0])
            data = [pa.array(docs, id_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(tokens, pa.int64()), pa.array([base + s for s in cols[4]], pa.int64()), pa.array(cols[5], pa.int64())]
            return pa.RecordBatch.from_arrays(data, [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            id_type = b.schema.field(0).type
            ids = b.column(0)
            for first, run in by_bytes(b.column(1)):
                for k, encoded in enumerate(enc.ids(run)):
                    encoded += end
                    packer.add((ids[first + k].as_py(), len(encoded) // 4), encoded)
                if len(packer.out) >= 10_000:
                    yield rows()
        packer.finish()
        if packer.out:
            yield rows()

    return df.select(id_col, text_of(text_col).alias("text")).mapInArrow(packed, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame) -> DataFrame:
    """With the production tokenizer and window."""
    import public_tokenizers

    return pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
