"""Operator 5, mixing sources to target weights by Poisson replication (DataFrame functions only).

Each source has a target share of the output.  Its mean repetition rate is target rows divided by the
rows it has.  A document's uniform number comes from a digest of the seed and its id; the Poisson
distribution with the source's rate, inverted at that number, is how often the document is written.
A rate above ``PART`` is cut into equal parts of at most ``PART``, each with a number of its own, and
the parts' counts are added: a sum of independent Poisson numbers is one with the sum of their rates.
Every copy gets its own random place, and the rows are sorted by it across all partitions.

Counting sources is a partial aggregation (a hot source sends one row a task), done once and written.  The rates
are a table of one row a source; it is broadcast if it has at most ``max_broadcast_sources`` rows, else documents
and rates are joined with salted keys, so a hot source is spread in any case.

``weights`` maps sources to shares (made to sum to 1; a source that isn't named gets none).  Without
it, shares are in proportion to (rows of the source) ** ``temperature``; 1 keeps the given mix, 0 makes
sources equal.  Defined cases: a null source is a source of its own (named by None); a null id counts
as the empty text; rows that agree in id get the same count; texts may be null; an empty table gives
an empty result; all columns are returned, and two more, ``copy`` and ``place``, which replace input columns of
these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, require, table

SEED = "mix-1"
TEMPERATURE = 0.5
MAX_BROADCAST_SOURCES = 10_000
SALTS = 64
#: 2 ** -52: the uniform numbers are 13 hexadecimal digits.
_UNIT = 2.0**-52
#: The largest rate inverted at once: exp(-rate) has a double up to about 700.
PART = 700.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a digest of the parts."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") * F.lit(_UNIT)


def poisson_steps(rate: Column) -> Column:
    """Values of the Poisson distribution function at 0, 1, 2, ... up to where it is 1 but for rounding."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("steps"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["steps"], F.array(acc["c"] + p)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["steps"])


def rates(df: DataFrame, source_col: str, weights: dict | None, temperature: float, total: int | None) -> DataFrame:
    """One row a source: __rw_source, n, rate, the number of parts of the rate, and the steps of a part's distribution."""
    counts = cut_lineage(df.groupBy(F.col(source_col).alias("__rw_source")).agg(F.count(F.lit(1)).alias("n")))  # documents are read once for it
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        share = F.lit(0.0)
        for source, w in weights.items():
            share = F.when(F.col("__rw_source").eqNullSafe(F.lit(source)), F.lit(float(w))).otherwise(share)
    shared = counts.withColumn("share", share)
    sums = shared.agg(F.sum("share"), F.sum("n")).first()  # one row
    shares, rows = sums[0] or 1.0, sums[1] or 0
    wanted = float(rows if total is None else total)
    rate = F.when(F.col("share") > 0, F.col("share") / F.lit(float(shares)) * F.lit(wanted) / F.col("n")).otherwise(F.lit(0.0))
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    rated = shared.withColumn("rate", rate).withColumn("__rw_parts", parts)
    return rated.select("__rw_source", "n", "rate", "__rw_parts", poisson_steps(F.col("rate") / F.col("__rw_parts")).alias("__rw_steps"))


def mix(df: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: dict | None = None, temperature: float = TEMPERATURE, total: int | None = None, seed: str = SEED, max_broadcast_sources: int = MAX_BROADCAST_SOURCES) -> DataFrame:
    """Rows of ``df`` repeated to the target mix, in random order; ``copy`` counts from 1."""
    require(df, source_col, id_col)
    by_source = rates(df, source_col, weights, temperature, total).select("__rw_source", "__rw_parts", "__rw_steps")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    few = by_source.limit(max_broadcast_sources + 1).count() <= max_broadcast_sources
    if few:
        joined = df.join(F.broadcast(by_source), F.col(source_col).eqNullSafe(F.col("__rw_source")))
    else:
        salt = F.pmod(F.xxhash64(key), F.lit(SALTS))
        spread = by_source.withColumn("__rw_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = df.withColumn("__rw_own", salt).join(spread, F.col(source_col).eqNullSafe(F.col("__rw_source")) & (F.col("__rw_own") == F.col("__rw_salt")))
    at = uniform(F.lit(seed), key)
    # the first k whose distribution function is above the number
    times = F.size(F.filter("__rw_steps", lambda c: c <= F.col("__rw_at")))

    def part(k: Column) -> Column:
        return F.size(F.filter("__rw_steps", lambda c: c <= uniform(F.lit(seed), F.lit("part"), k.cast("string"), key)))

    further = F.aggregate(F.sequence(F.lit(1), F.col("__rw_parts") - 1), F.lit(0), lambda n, k: n + part(k))
    times = F.when(F.col("__rw_parts") > 1, times + further).otherwise(times)
    counted = joined.withColumn("__rw_at", at).withColumn("__rw_times", times).where("__rw_times > 0")
    copies = counted.withColumn("__rw_copy", F.explode(F.sequence(F.lit(1), F.col("__rw_times"))))
    place = uniform(F.lit(seed), F.lit("place"), key, F.col("__rw_copy").cast("string"))
    out = copies.select(*(F.col(f"`{c}`") for c in df.columns if c not in ("copy", "place")), F.col("__rw_copy").cast("long").alias("copy"), place.alias("place"))
    return out.orderBy("place")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def copies_sql(docs: str, columns: str, seed: str = SEED, temperature: float = TEMPERATURE) -> str:
    """DuckDB SQL for :func:`mix` with default shares over the relation ``docs``."""

    def unit(*parts: str) -> str:
        return f"CAST(CAST('0x' || substr(md5({" || ':' || ".join(parts)}), 1, 13) AS BIGINT) AS DOUBLE) * {_UNIT!r}"

    return f"""
counts AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
rates AS (SELECT source, pow(n, {temperature}) / sum(pow(n, {temperature})) OVER () * sum(n) OVER () / n AS rate FROM counts),
drawn AS (SELECT d.*, rate, {unit(f"'{seed}'", "coalesce(CAST(doc_id AS VARCHAR), '')")} AS drawn_at FROM {docs} d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
timed AS (SELECT *, len(list_filter(list_transform(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS INT)),
  lambda k: list_sum(list_transform(generate_series(0, k), lambda j: exp(-rate + j * ln(rate) - lgamma(j + 1))))), lambda c: c <= drawn_at)) AS times FROM drawn)
SELECT {columns}, CAST(copy AS BIGINT) AS copy, {unit(f"'{seed}'", "'place'", "coalesce(CAST(doc_id AS VARCHAR), '')", "CAST(copy AS VARCHAR)")} AS place
FROM timed, unnest(generate_series(1, times)) u(copy)"""


QUERIES = {"op5_source_mixing": op5_source_mixing}
ORACLES = {"op5_source_mixing": f"WITH {copies_sql('documents', 'doc_id, text, lang, source, n_chars')}"}
