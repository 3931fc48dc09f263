"""Operator 11, vector code compression: product codes whose nearest entries are found by segment-mean lower bounds.

Vectors of whole numbers are cut into equal consecutive parts, each with a codebook of its own.  The codebooks start as
the parts of the vectors of the smallest ids; a round assigns every part to its nearest entry and moves each entry to the
floor of its parts' mean.

*Nearest entry.*  A part and an entry are cut into blocks, first one, then two, four and so on.  For a block of n places
the squared distance is n times the squared difference of the means plus the squared distance of what remains beside the
means, and that is at least the squared difference of the remainders' norms.  The sums of these over the blocks are lower
bounds, each finer one closer.  At each level the entry of the least bound gives an exact distance; entries whose bound is
beyond it are dropped, less an allowance for rounding, and the survivors' squared distances are computed exactly in whole
numbers.  No entry that could be nearest is dropped, so codes are those of a full search.

*Plan.*  A round is one scan: tasks add up counts and sums of their rows' parts and give one row for each entry and place,
which are added by a shuffle of that fixed size.  The codebooks (parts x entries) are all that the driver holds.  The coded rows
are written once, in the shared folder, for the sums by label; these are joined by a broadcast up to a checked number of labels,
and beyond it by a shuffle in which each label is spread over several tasks.

Defined cases: rows whose vector is null, empty, of another length than that of the smallest id, or holds a null, non-finite or
huge component (2**19 or more) take no part; a null id counts as the largest; repeated rows and ids each have a row; ties
of ids start by the smaller vector, ties of distances take the lower entry; fewer vectors than entries make smaller codebooks;
a length that the parts don't divide makes the first parts one place longer; an empty table gives an empty result; null labels
are one label; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import Stored
from .common import require, table
from .vectors import integer_vectors

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows whose bounds a task holds at once.
ROWS = 4096
#: Labels whose sums are broadcast at most, and the tasks that a label is spread over beyond that.
LABELS, SALTS = 50_000, 8


def _levels(width: int) -> list[list[slice]]:
    """Blocks of a part, coarse to fine; at the finest they hold two places or three."""
    out, n = [], 1
    while width and (n == 1 or width // n >= 2):
        out.append([slice(x[0], x[-1] + 1) for x in np.array_split(np.arange(width), n)])
        n *= 2
    return out


def _summary(v: np.ndarray, blocks: list[slice]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, remainder norms (rows, blocks) and places of each block."""
    n = np.array([b.stop - b.start for b in blocks])
    sums = np.stack([v[:, b].sum(axis=1) for b in blocks], axis=1)
    squares = np.stack([(v[:, b] ** 2).sum(axis=1) for b in blocks], axis=1)
    return sums, np.sqrt(np.maximum(n * squares - sums**2, 0) / n), n


def nearest_entries(x: np.ndarray, book: np.ndarray, met: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` its nearest entry, the lowest of ties, and their squared distance; int64 throughout.

    ``met``, if given, gets the numbers of pairs that are left for each level and at last computed exactly.
    """
    levels = _levels(x.shape[1])
    if not levels:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    slack = 1e-6 + 1e-12 * float((x**2).sum(axis=1).max(initial=0) + (book**2).sum(axis=1).max(initial=0))

    def bound(a, b):
        return (((a[0] - b[0]).astype(float)) ** 2 / a[2] + (a[1] - b[1]) ** 2).sum(axis=-1)

    def firsts(r, values):
        """Of the pairs, by rows ascending, the first place of each row's least value."""
        least = np.minimum.reduceat(values, np.flatnonzero(np.diff(r, prepend=-1)))
        at = np.flatnonzero(values == least[r])
        return at[np.diff(r[at], prepend=-1) > 0]

    mine, theirs = _summary(x, levels[0]), _summary(book, levels[0])
    low = ((mine[0] - theirs[0].T).astype(float) ** 2) / mine[2] + (mine[1] - theirs[1].T) ** 2  # one block: a matrix
    limit = ((x - book[low.argmin(axis=1)]) ** 2).sum(axis=1)  # an entry that the limit is from always stays
    r, c = np.nonzero(low - slack <= limit[:, None])
    counts = [low.size, len(r)]
    for blocks in levels[1:]:
        mine, theirs = _summary(x, blocks), _summary(book, blocks)
        low = bound((mine[0][r], mine[1][r], mine[2]), (theirs[0][c], theirs[1][c]))
        if len(r):
            limit = np.minimum(limit, ((x - book[c[firsts(r, low)]]) ** 2).sum(axis=1))
        near = low - slack <= limit[r]
        r, c = r[near], c[near]
        counts.append(len(r))
    exact = ((x[r] - book[c]) ** 2).sum(axis=1)
    first = firsts(r, exact) if len(r) else r
    least = exact[first]
    if met is not None:
        met[:] = counts if not met else [a + b for a, b in zip(met, counts)]
    return c[first], least


def _matrices(batch: pa.RecordBatch, column: int):
    """(first row, matrix) of runs of rows."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.column(column)[at : at + ROWS]
        yield at, part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(part), -1)


class Codebooks:
    """One codebook for each part of vectors of ``width`` places."""

    def __init__(self, start: np.ndarray, parts: int = PARTS):
        self.cuts = [slice(x[0], x[-1] + 1) if len(x) else slice(0, 0) for x in np.array_split(np.arange(start.shape[1]), parts)]
        self.books = [start[:, c].copy() for c in self.cuts]

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) entries and squared distances."""
        found = [nearest_entries(np.ascontiguousarray(v[:, c]), b) for c, b in zip(self.cuts, self.books)]
        return np.stack([k for k, _ in found], axis=1), np.stack([d for _, d in found], axis=1)

    def moved(self, rows: DataFrame) -> Codebooks:
        """Codebooks whose entries are the floors of the means of the parts assigned to them."""
        entries, width = len(self.books[0]), sum(b.shape[1] for b in self.books)

        def sums(batches):
            counts, totals = np.zeros((len(self.books), entries), np.int64), np.zeros((entries, width), np.int64)
            for b in batches:
                for _, v in _matrices(b, 0):
                    for p, entry in enumerate(self.assign(v)[0].T):
                        counts[p] += np.bincount(entry, minlength=entries)
                        np.add.at(totals[:, self.cuts[p]], entry, v[:, self.cuts[p]])
            flat = np.concatenate([counts.ravel(), totals.ravel()])
            used = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], names=["k", "v"])

        flat = [0] * (len(self.books) * entries + entries * width)
        for r in rows.select("__rw_v").mapInArrow(sums, "k long, v long").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():  # one row for each count and sum
            flat[r["k"]] = int(r["v"])
        out = Codebooks.__new__(Codebooks)
        out.cuts, out.books = self.cuts, [b.copy() for b in self.books]
        for p, cut in enumerate(self.cuts):
            for e in range(entries):
                if n := flat[p * entries + e]:
                    at = len(self.books) * entries + e * width
                    out.books[p][e] = [s // n for s in flat[at + cut.start : at + cut.stop]]
        return out

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of rows (__rw_id, __rw_v); None without rows."""
    start = rows.orderBy(F.col("__rw_id").asc_nulls_last(), "__rw_v").limit(entries).select("__rw_v").collect()  # at most ``entries`` rows
    if not start:
        return None
    books = Codebooks(np.array([r["__rw_v"] for r in start], np.int64), parts)
    for _ in range(rounds):
        books = books.moved(rows)
    return books


def encode(rows: DataFrame, books: Codebooks, *keep: str) -> DataFrame:
    """__rw_id, kept columns, code and error of each row."""

    def coded(batches):
        for b in batches:
            codes, errors = [], []
            for _, v in _matrices(b, b.num_columns - 1):
                entry, d = books.assign(v)
                codes += [r.tobytes().hex() for r in entry.astype(np.uint8)]
                errors.append(d.sum(axis=1))
            error = np.concatenate(errors) if errors else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(codes, pa.string()), pa.array(error)], names=[*b.schema.names[:-1], "code", "error"])

    kept = ["__rw_id", *keep]
    return rows.select(*kept, "__rw_v").mapInArrow(coded, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", code string, error long")


def with_sums(coded: DataFrame, key: str, labels: int = LABELS) -> DataFrame:
    """``coded`` and label_error, the sum of error over the rows of its key; nulls are one key."""
    sums = coded.groupBy(F.col(key).alias("__rw_key")).agg(F.sum("error").alias("label_error"))
    if sums.limit(labels + 1).count() <= labels:
        return coded.join(F.broadcast(sums), F.col(key).eqNullSafe(F.col("__rw_key"))).drop("__rw_key")  # a checked number of rows
    spread = sums.withColumn("__rw_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("__rw_at", F.pmod(F.xxhash64("__rw_id"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, F.col(key).eqNullSafe(F.col("__rw_key")) & (F.col("__rw_at") == F.col("__rw_salt"))).drop("__rw_key", "__rw_salt", "__rw_at")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, labels: int = LABELS) -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of each row that takes part; at most 256 entries, so that a code is a byte a part."""
    require(df, id_col, vector_col, label_col)
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows, _ = integer_vectors(df, id_col, vector_col, label_col)
    books = fit(rows, parts, entries, rounds)
    if books is None:
        kind = df.schema[id_col].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    coded = Stored(df.sparkSession).write(encode(rows, books, f"__rw_{label_col}"))
    out = with_sums(coded, f"__rw_{label_col}", labels)
    return out.select(F.col("__rw_id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The same in DuckDB, for vectors of 64 places."""
    xs = [f"x{k}" for k in range(4)]
    distance = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in xs)
    steps = [f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
parts AS MATERIALIZED (SELECT vec_id, label, p, {", ".join(f"v[4 * p + {k + 1}] AS {x}" for k, x in enumerate(xs))} FROM kept, range(16) t(p)),
b0 AS MATERIALIZED (SELECT p, entry, {", ".join(xs)} FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id))"""]
    for k in range(3):
        steps.append(f"a{k} AS MATERIALIZED (SELECT a.vec_id, a.p, min(struct_pack(d := {distance}, e := b.entry)) AS m FROM parts a JOIN b{k} b USING (p) GROUP BY a.vec_id, a.p)")
        if k < 2:
            means = ", ".join(f"CAST(floor(sum({x}) / count(*)) AS BIGINT) AS {x}" for x in xs)
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.entry, {', '.join(f'coalesce(n.{x}, b.{x}) AS {x}' for x in xs)} FROM b{k} b LEFT JOIN (SELECT p, a.m.e AS entry, {means} FROM parts JOIN a{k} a USING (vec_id, p) GROUP BY 1, 2) n USING (p, entry))")
    steps.append("coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(m.e AS INT)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id)")
    digest = f"(SELECT sha256(string_agg({' || chr(44) || '.join(xs)}, ',' ORDER BY p, entry)) FROM b2)"
    return "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {digest} AS codebooks_sha256 FROM coded JOIN kept USING (vec_id)"


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLES = {"op11_vector_codes": _sql()}
