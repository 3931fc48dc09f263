"""Operator 6, exact dedup by content sort.

Rows are range-partitioned by their bytes with splitters that Spark samples, and sorted inside each partition
(an external sort that spills), so equal texts are neighbours and one pass of whole-text comparisons
with the neighbour above finds the runs of equal texts.  Splitters are made of a text's first characters and
its digest, so the sample that the driver sees has short rows; inside a partition whole texts are sorted.

Hot groups are never gathered in one place.  :func:`groups`, which reports every row, puts the id into
the sort key, so splitters cut a large group like anything else; runs that touch a partition's edge are
then joined up from one report for each such run (two a partition at most).  :func:`survivors`, which
returns the rows that stay, first reduces every Arrow batch to its best row for each text, so a group
sends one row a batch through the shuffle.

Texts are equal when identical; null counts as the empty text.  Of equal texts the row with the largest
id stays (or the smallest); null ids never win over others.  Of rows that agree in text and id, all
carry the same result in :func:`groups`, and one stays in :func:`survivors`.  An empty table gives an
empty result.  :func:`groups` ignores further columns, :func:`survivors` returns them as they are.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, require, table, text_of


#: Characters of a text in a splitter.
LEADING = 48


def _best_first(keep: str):
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    return F.col("__rw_id").desc_nulls_last() if keep == "largest" else F.col("__rw_id").asc_nulls_last()


#: Ids that are held as Python numbers at most, and rows of a batch that is given out.
HELD = 10_000


def _named(df: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    text = text_of(text_col)
    return df.select(text.alias("__rw_text"), F.col(id_col).alias("__rw_id"), F.substring(text, 1, LEADING).alias("__rw_lead"), F.sha2(text.cast("binary"), 256).alias("__rw_sha"), *more)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _closed_runs(batches):
    """Over a partition sorted by (text, best id first): each row with its run's best id, size and digest.

    ``edge`` marks the rows of the partition's first and last run, ``head`` the row that opens a run.  The pass keeps one
    text at a time, and of its run the ids: plain numbers in Arrow arrays once they are more than HELD, given out in pieces.
    """
    part = TaskContext.get().partitionId()
    names = ["__rw_id", "__rw_best", "__rw_n", "text_sha256", "__rw_edge", "__rw_head", "__rw_part"]
    run, last, digest, kind = -1, None, None, None
    held: list = []
    pieces: list[pa.Array] = []
    done: list[list] = [[] for _ in names[:-1]]

    def rows(ids: pa.Array, best: pa.Array, n: pa.Array, sha: pa.Array, edge: pa.Array, head: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, best, n, sha, edge, head, pa.array([part] * len(ids), pa.int32())], names=names)

    def close(edge: bool):
        """What the run gives at once if it is long; a short one waits in ``done``."""
        n, edge = sum(map(len, pieces)) + len(held), edge or run == 0
        best = pieces[0][0].as_py() if pieces else held[0]
        for k, ids in enumerate(pieces):
            m = len(ids)
            yield rows(ids, pa.array([best] * m, kind), pa.array([n] * m, pa.int64()), pa.array([digest] * m, pa.string()), pa.array([edge] * m), pa.array([k == 0, *[False] * (m - 1)]))
        m = len(held)
        for col, values in zip(done, (held, [best] * m, [n] * m, [digest] * m, [edge] * m, [not pieces, *[False] * (m - 1)][:m])):
            col.extend(values)
        held.clear()
        pieces.clear()

    def flush() -> pa.RecordBatch:
        got = rows(*(pa.array(c, t) for c, t in zip(done, (kind, kind, pa.int64(), pa.string(), pa.bool_(), pa.bool_()))))
        for c in done:
            c.clear()
        return got

    for b in batches:
        kind = b.schema.field(1).type
        ids = b.column(1).to_pylist()
        texts = b.column(0)
        for k, i in enumerate(ids):
            t = texts[k].as_py()
            if t != last:
                if held or pieces:
                    yield from close(False)
                run, last, digest = run + 1, t, b.column(3)[k].as_py()
            held.append(i)
            if len(held) >= HELD:
                pieces.append(pa.array(held, kind))
                held.clear()
        if len(done[0]) >= HELD:
            yield flush()
    if held or pieces:
        yield from close(True)
    if done[0]:
        yield flush()


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row for each row of ``df``: id, keep_id, group_size, kept and text_sha256."""
    require(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    best_first = _best_first(keep)
    named = _named(df, id_col, text_col)
    # with the id in the splitters, a large group of copies is cut like anything else
    dealt = named.repartitionByRange(_partitions(df), "__rw_lead", "__rw_sha", best_first).sortWithinPartitions("__rw_lead", "__rw_sha", "__rw_text", best_first)
    # ids and digests only; written once, so that reports and rows come from the same splitters
    rows = cut_lineage(dealt.mapInArrow(_closed_runs, f"__rw_id {kind}, __rw_best {kind}, __rw_n long, text_sha256 string, __rw_edge boolean, __rw_head boolean, __rw_part int"))
    best = F.max if keep == "largest" else F.min
    reports = rows.where("__rw_edge AND __rw_head").groupBy("text_sha256").agg(best("__rw_best").alias("keep_id"), F.sum("__rw_n").alias("group_size"), F.count(F.lit(1)).alias("__rw_parts"))
    # two reports a partition at most, whatever the data: a bounded side
    cut = F.broadcast(reports.where("__rw_parts > 1").select("text_sha256", "keep_id", "group_size"))
    joined = rows.join(cut, "text_sha256", "left")
    keep_id = F.coalesce("keep_id", "__rw_best")
    return joined.select(F.col("__rw_id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", "__rw_n").alias("group_size"), F.col("__rw_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def survivors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows that stay, with all columns of ``df``."""
    require(df, id_col, text_col)
    names, best_first = df.columns, _best_first(keep)
    # the text is sent once; whether it was null is kept beside it
    named = _named(df, id_col, text_col, F.col(text_col).isNull().alias("__rw_null"), *(F.col(f"`{c}`").alias(f"__rw_{k}") for k, c in enumerate(names) if c != text_col))
    schema = named.schema
    way = "descending" if keep == "largest" else "ascending"

    def best_of_batch(batches):
        for b in batches:
            at = pc.sort_indices(pa.table([b.column(1)], names=["id"]), sort_keys=[("id", way)], null_placement="at_end")
            seen, stay = set(), []
            for k in at.to_pylist():
                t = b.column(0)[k].as_py()
                if t not in seen:
                    seen.add(t)
                    stay.append(k)
            yield b.take(pa.array(sorted(stay), pa.int64()))

    def openers(batches):
        last = None
        for b in batches:
            texts, stay = b.column(0), []
            for k in range(len(texts)):
                t = texts[k].as_py()
                if t != last:
                    stay.append(k)
                    last = t
            if stay:
                yield b.take(pa.array(stay, pa.int64()))

    dealt = named.mapInArrow(best_of_batch, schema).repartitionByRange(_partitions(df), "__rw_lead", "__rw_sha").sortWithinPartitions("__rw_lead", "__rw_sha", "__rw_text", best_first)
    text = F.when(~F.col("__rw_null"), F.col("__rw_text")).cast(df.schema[text_col].dataType)
    return dealt.mapInArrow(openers, schema).select(*((text if c == text_col else F.col(f"__rw_{k}")).alias(c) for k, c in enumerate(names)))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


SURVIVORS_SQL = "SELECT max(doc_id) AS doc_id FROM documents GROUP BY coalesce(text, '')"

QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {
    "op6_exact_dedup": """
WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM documents JOIN g ON coalesce(text, '') = t"""
}
