"""Operator 2, quality rules: a ledger with one bit for each failed rule.

:func:`ledger` evaluates every rule once for every whole text and stores the measurements and the
failure bits.  Policies are named, versioned masks over these bits; :func:`apply_policy` and
:func:`ablation` only use bitwise arithmetic on a ledger and never read a text again.

Measuring is an Arrow function (one text at a time, integer ranks of five-word windows in numpy), the
rest are DataFrame expressions; nothing is shuffled but the few rows of an ablation.

Defined cases: a null text has no words, so it fails ``few_words``; null ids pass through; repeated
rows give repeated results; an empty table gives an empty ledger; further columns are ignored; measurements replace
kept columns of their names.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import require, table, text_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_mark_words", "n_stutters")

SYMBOLS = b"#*$%&|<>"
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
LETTERS = bytes(c for c in range(128) if chr(c).isalpha())
_NOT_CAPITALS = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_LETTERS = bytes(c for c in range(256) if c not in LETTERS)

#: Rules in bit order: name and the SQL condition of failure over the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbol_rate": "10 * n_symbols > n_words",
    "capitals": "10 * n_capitals > 3 * n_letters",
    "mark_words": "10 * n_mark_words > 2 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 5 * n_lines",
    "stutters": "10 * n_stutters > 3 * n_words",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": tuple(RULES),
}
PRODUCTION_POLICY = "web-1"


def mask(policy: str) -> int:
    """The policy's rules as one integer."""
    return sum(BIT[r] for r in POLICIES[policy])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window found twice or more (numpy ranks, exact)."""
    if len(words) < 6:
        return 0
    rank: dict[bytes, int] = {}
    ids = np.fromiter((rank.setdefault(w, len(rank)) for w in words), np.int64, len(words))
    two = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] << 32 | two[2:], return_inverse=True)[1]
    _, five, counts = np.unique(four[:-1] << 32 | ids[4:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[five] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + 5, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def measure(text: str) -> tuple[int, ...]:
    """MEASURES of one text."""
    raw = text.encode("utf-8")
    words = raw.split()  # ASCII white space only
    seen, dup = set(), 0
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    for x in lines:
        if x in seen:
            dup += 1
        seen.add(x)
    return (
        len(words),
        sum(len(w) if w.isascii() else len(w.decode("utf-8")) for w in words),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        dup,
        repeated_words(words),
        len(lines),
        len(raw.translate(None, _NOT_LETTERS)),
        len(raw.translate(None, _NOT_CAPITALS)),
        sum(not w.strip(MARKS) for w in words),
        sum(map(eq, words, words[1:])),
    )


def failure_bits() -> Column:
    """One bit for each rule that the measurements fail."""
    return sum((F.when(F.expr(cond), F.lit(BIT[name])).otherwise(F.lit(0)) for name, cond in RULES.items()), F.lit(0)).cast("long")


def _measured(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` and the measurements of its text column, whose rows go to Python once."""
    at = df.columns.index(text_col)

    def measured(batches):
        for b in batches:
            got = [measure(x.as_py() or "") for x in b.column(at)]
            cols = list(zip(*got)) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in cols)], names=[*b.schema.names, *MEASURES])

    schema = StructType([*df.schema.fields, *(StructField(m, LongType()) for m in MEASURES)])
    return df.mapInArrow(measured, schema)


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, measurements and ``fail_bits`` of every row; columns named in ``keep`` are carried along."""
    require(df, id_col, text_col, *keep)
    carried = [id_col, *(c for c in keep if c != id_col)]
    inner = df.select(*(F.col(c).alias(f"__rw_{k}") for k, c in enumerate(carried)), text_of(text_col).alias("__rw_text"))
    out = _measured(inner, "__rw_text").withColumn("fail_bits", failure_bits())
    return out.select(*(F.col(f"__rw_{k}").alias(c) for k, c in enumerate(carried) if c not in (*MEASURES, "fail_bits")), *MEASURES, "fail_bits")


def apply_policy(led: DataFrame, policy: str = PRODUCTION_POLICY) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def passing(df: DataFrame, policy: str = PRODUCTION_POLICY, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the policy keeps, with all their columns."""
    require(df, text_col)
    at = df.columns.index(text_col)
    own = [F.col(f"`{c}`").cast("string") if k == at else F.col(f"`{c}`") for k, c in enumerate(df.columns)]
    named = df.select(*(c.alias(f"__rw_c{k}") for k, c in enumerate(own)))
    led = apply_policy(_measured(named, f"__rw_c{at}").withColumn("fail_bits", failure_bits()), policy)
    return led.where("kept").select(*(F.col(f"__rw_c{k}").cast(df.schema[c].dataType).alias(c) for k, c in enumerate(df.columns)))


def ablation(led: DataFrame, policy: str = PRODUCTION_POLICY) -> DataFrame:
    """For each rule of the policy: documents that fail it, documents that only it rejects, and documents kept without it."""
    m = mask(policy)
    hit = F.col("fail_bits").bitwiseAND(F.lit(m).cast("long"))
    combos = led.groupBy(hit.alias("hit")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]))
    each = combos.select("hit", "n", F.explode(rules).alias("r")).select("hit", "n", "r.rule", "r.bit")
    rest = F.col("hit").bitwiseAND(F.lit(m).cast("long") - F.col("bit"))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("hit").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("hit") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policy(ledger(table(spark, sf_dir, "documents")))
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask("base-1")).cast("long")) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the production policy does to the corpus."""
    return ablation(ledger(table(spark, sf_dir, "documents")))


_WORD = r"[^\x20\x09-\x0D]+"
_MEASURED_SQL = rf"""
docs AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i:i + 4] AS g FROM docs, unnest(generate_series(1, len(w) - 4)) u(i)),
found AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM found, unnest(generate_series(0, 4)) v(k) GROUP BY doc_id),
lines AS (SELECT doc_id, x FROM docs, unnest(string_split(t, chr(10))) s(x) WHERE regexp_matches(x, '{_WORD}')),
line_counts AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM lines GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(w) AS n_words,
    length(t) - length(regexp_replace(t, '{_WORD}', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
    len(list_filter(w, lambda x: regexp_full_match(x, '[!-/:-@\[-`{{-~]+'))) AS n_mark_words,
    len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i - 1])) AS n_stutters
  FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN line_counts USING (doc_id)),
ledger AS (SELECT *, {" + ".join(f"CASE WHEN {c} THEN {BIT[n]} ELSE 0 END" for n, c in RULES.items())} AS fail_bits FROM measured)"""

KEPT_SQL = f"WITH {_MEASURED_SQL} SELECT doc_id FROM ledger WHERE fail_bits & {mask(PRODUCTION_POLICY)} = 0"

QUERIES = {"op2_quality_rules": op2_quality_rules, "llm_quality_ablation": quality_ablation}
ORACLES = {
    "op2_quality_rules": f"""WITH {_MEASURED_SQL}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  fail_bits & {mask("base-1")} <> 0 AS base_failed, fail_bits & {mask(PRODUCTION_POLICY)} = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits
FROM ledger""",
    "llm_quality_ablation": f"""WITH {_MEASURED_SQL}, rules(rule, bit) AS (VALUES {", ".join(f"('{r}', {BIT[r]})" for r in POLICIES[PRODUCTION_POLICY])})
SELECT rule, CAST(count(*) FILTER (fail_bits & bit <> 0) AS BIGINT) AS n_failed,
  CAST(count(*) FILTER (fail_bits & {mask(PRODUCTION_POLICY)} = bit) AS BIGINT) AS n_only,
  CAST(count(*) FILTER (fail_bits & ({mask(PRODUCTION_POLICY)} - bit) = 0) AS BIGINT) AS n_kept_without
FROM ledger, rules GROUP BY rule""",
}
