"""The pipeline's rows against a brute-force version of every stage."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import corpus_pipeline
from ridgewave.llm import mixing, quality_rules
from ridgewave.llm.quality_rules import BIT, MEASURES, PRODUCTION_POLICY, RULES, mask

from ..conftest import SF
from .test_operators import brute_classes


def fails(text: str) -> bool:
    values = dict(zip(MEASURES, quality_rules.measure(text)))
    bits = sum(BIT[n] for n, c in RULES.items() if eval(c.replace(" AND ", " and ").replace(" OR ", " or "), {}, values))  # noqa: S307
    return bool(bits & mask(PRODUCTION_POLICY))


def copies(rows) -> Counter:
    """How often each document is written, by plain arithmetic."""
    n = Counter(r["source"] for r in rows)
    shares = {s: c**mixing.TEMPERATURE for s, c in n.items()}
    out = Counter()
    for r in rows:
        rate = shares[r["source"]] / sum(shares.values()) * len(rows) / n[r["source"]]
        u = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) * 2.0**-52
        p = c = math.exp(-rate)
        k = 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out[r["doc_id"]] = k
    return out


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r for r in docs.collect() if not fails(r["text"] or "")]
    largest: dict = {}
    for r in rows:
        largest[r["text"]] = max(largest.get(r["text"], -1), r["doc_id"])
    rows = [r for r in rows if largest[r["text"]] == r["doc_id"]]
    classes = brute_classes({r["doc_id"]: r["text"] for r in rows})
    rows = [r for r in rows if classes[r["doc_id"]] == r["doc_id"]]
    want = copies(rows)
    got = corpus_pipeline.run(spark, SF)
    held = defaultdict(int)
    tokens = {}
    for r in got.collect():
        held[r["doc_id"]] += r["length"]
        tokens[r["doc_id"]] = r["doc_tokens"]
    assert {i: held[i] // tokens[i] for i in held} == {i: k for i, k in want.items() if k}


def test_columns_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
