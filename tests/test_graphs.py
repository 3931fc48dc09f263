"""Components of graphs of several shapes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ridgewave.operators.graphs import components, thinned
from ridgewave.operators.order import Stored


def expected(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        if start not in out:
            todo = [start]
            out[start] = start
            while todo:
                for y in near[todo.pop()]:
                    if y not in out:
                        out[y] = start
                        todo.append(y)
    return out


@pytest.mark.parametrize("tail", [0, 20_000])
def test_shapes(spark, tail):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(160)] + [(1000, 1000 + k) for k in range(1, 90)] + [(5000 - k, 5001 - k) for k in range(60)] + [(7, 7), (9000, 9001), (9001, 9000), (9000, 9001)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    want = expected([(a, b) for a, b in edges if a != b])
    for given in (df, thinned(df)):
        rows = components(given, tail).collect()
        assert len(rows) == len(want) and {r["node"]: r["root"] for r in rows} == want
    assert components(df.limit(0), tail).count() == 0


def test_long_path(spark):
    """100,000 nodes in one path, no two neighbours in id order, settled in far fewer rounds than its length."""
    n = 100_000
    place = lambda c: (F.col(c) * 48_271) % F.lit(n)  # noqa: E731  a permutation, as the factor has no divisor in common with n
    path = spark.range(n - 1).select(place("id").alias("a"), ((F.col("id") + 1) * 48_271 % n).alias("b"))
    written = []
    keep = Stored.write
    Stored.write = lambda self, df: (written.append(1), keep(self, df))[1]
    try:
        got = components(path, tail=1000).groupBy("root").count().collect()
    finally:
        Stored.write = keep
    assert [(r["root"], r["count"]) for r in got] == [(0, n)]
    assert len(written) < 2 * 17 * 2
