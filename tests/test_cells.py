"""The tree of cells: exact searches, bounded leaves, and what they leave out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgewave.operators import cells, learning
from ridgewave.operators.order import Stored


def clustered(n: int, width: int = 8, groups: int = 40, seed: int = 0, copies: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.uniform(-10, 10, (groups, width))[rng.integers(groups, size=n)] + rng.normal(0, 0.3, (n, width))
    x[:copies] = x[0]
    return x


def table(spark, x: np.ndarray):
    return spark.createDataFrame([(k, v.tolist(), k % 7) for k, v in enumerate(x)], "id long, x array<double>, label int").repartition(4)


@pytest.mark.parametrize("pivots, cell, copies", [(1024, 512, 0), (4, 10, 0), (3, 5, 400), (1, 8, 900)])
def test_leaves_hold_every_row_once(spark, pivots, cell, copies):
    x = clustered(1500, copies=copies)
    tree = cells.build(table(spark, x), Stored(spark), pivots, cell)
    rows = tree.placed.collect()
    assert sorted(r["id"] for r in rows) == list(range(1500))
    leaves = {r["home"]: r for r in tree.leaves.collect()}
    for home, leaf in leaves.items():
        own = [r for r in rows if r["home"] == home]
        assert len(own) == leaf["n"] and np.isclose(max(r["gap"] for r in own), leaf["radius"])
        assert leaf["n"] <= cells.SLACK * cell or leaf["radius"] < 1e-6 or len(tree.levels) == cells.LEVELS
    if pivots < 1024:
        assert tree.levels


def test_leaves_stay_small_as_the_table_grows(spark):
    """A hundred times the rows: more levels, no larger leaves."""
    largest = {}
    for n in (300, 30_000):
        x = clustered(n, width=3, groups=200)
        tree = cells.build(table(spark, x), Stored(spark), pivots=16, cell=40)
        largest[n] = tree.leaves.agg(F.max("n")).first()[0]
    assert max(largest.values()) <= cells.SLACK * 40 and tree.levels


@pytest.mark.parametrize("pivots, cell", [(1024, 512), (4, 10)])
def test_eps_links(spark, pivots, cell):
    x = clustered(1200, copies=60)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for eps in (0.0, 0.7):
        tell: dict = {}
        got = [(r["a"], r["b"]) for r in learning.eps_links(table(spark, x), eps, pivots, cell, tell).collect()]
        want = {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= eps)) if a < b}
        if eps == 0.0:  # equal rows, but for rounding
            want = {(a, b) for a in range(60) for b in range(a + 1, 60)}
            got = [p for p in got if p in want] if set(got) <= want else got
        assert len(got) == len(set(got)) and (set(got) == want or eps == 0.0)
    assert tell["all"] == 1200 * 1199 // 2
    if pivots == 4:
        assert tell["pairs"] < tell["all"] / 5 and tell["largest"] < 120


@pytest.mark.parametrize("pivots, block", [(1024, 512), (8, 20)])
@pytest.mark.parametrize("same", [False, True])
def test_nearest(spark, pivots, block, same):
    x = clustered(2000, copies=300)
    df = table(spark, x)
    tell: dict = {}
    got = {r["id"]: r for r in learning.nearest(df.where("id % 5 = 0"), df, 0.9, same, block, pivots, tell).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    if same:
        np.fill_diagonal(d, np.inf)
    for k in range(0, 2000, 5):
        best = int(d[k].round(9).argmin())
        assert np.isclose(got[k]["distance"], d[k, best], atol=1e-6)
        assert got[k]["label"] == (best % 7 if d[k, best] <= 0.9 else -1) or d[k, best] < 1e-5
    assert tell["all"] == 400 * 2000
    if pivots == 8:
        assert tell["pairs"] < tell["all"] / (7 if same else 10)  # a query among the copies meets them all twice
    assert learning.nearest(df, df.limit(0), 1.0).count() == 0 and learning.nearest(df.limit(0), df, 1.0).count() == 0
