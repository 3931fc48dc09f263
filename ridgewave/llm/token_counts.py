"""Operator 4, token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes (not rows), and every text, however long, is cut at boundaries that no
token crosses (see :mod:`ridgewave.llm.encoding`), so a task's memory holds one batch and a bounded
table of known words, which it empties at its end.  There is no shuffle: the scan's partitions are the tasks.

Defined cases: null text counts as empty (0 bytes, 0 tokens); null ids pass through; repeated rows
give repeated results; an empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require, table, text_of
from .encoding import by_bytes, encoder

#: Longest document of a training window, in tokens.
MAX_TOKENS = 2048


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8) and n_tokens of every row; ``tokenizer`` is a file every worker can read."""
    require(df, id_col, text_col)

    def lengths(batches):
        enc = encoder(tokenizer)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            n_bytes, n_tokens = [], []
            for _, run in by_bytes(texts):
                n_bytes += [len(t.encode("utf-8")) for t in run]
                n_tokens += enc.lengths(run)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], [id_col, "n_bytes", "n_tokens"])
        enc.end_task()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_of(text_col).alias("text")).mapInArrow(lengths, f"`{id_col}` {kind}, n_bytes long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
    return out.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
