"""Rows reach the autoencoder whole batches at a time: neither lambdas in the plan nor a loop over rows picks the usable ones."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ridgewave.operators import autoencoder as ae


def test_plan_of_a_step_has_no_lambda(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    plain, plans = DataFrame.mapInArrow, []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, *rest: (plans.append(self._jdf.queryExecution().toString()), plain(self, *rest))[1])
    df = spark.range(100).select("id", F.array(*[(F.col("id") % (k + 2)).cast("double") for k in range(12)]).alias("x"))
    g, loss, n = ae.mean_gradient(df, ae.Learner.fresh())
    assert n == 100 and plans and not any("lambda" in p or "forall" in p for p in plans)


def test_calls_do_not_grow_with_the_rows(spark, monkeypatch):
    """Calls that scoring a batch makes, for a hundred and for 10,000 rows within so many slices."""
    from pyspark.sql.classic.dataframe import DataFrame

    run: list = []
    plain = DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *rest: (run.append(f), plain(self, f, *rest))[1])
    ae.scored(spark.createDataFrame([(1, [0.0] * 12)], "id long, x array<double>"), ae.Learner.fresh())

    def calls(n: int) -> int:
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([[float(k % 7)] * 12 for k in range(n)], pa.list_(pa.float64()))], names=["id", "x"])
        seen = [0]
        sys.setprofile(lambda *_: seen.__setitem__(0, seen[0] + 1))
        try:
            list(run[0](iter([batch])))
        finally:
            sys.setprofile(None)
        return seen[0]

    assert calls(10_000) < 40 * calls(100)


def test_usable_rows_of_a_sliced_batch():
    rows = [None, [1.0, 2.0], [3.0], [4.0, None], [float("nan"), 5.0], [6.0, 7.0], None, [8.0, 9.0]]
    for at in range(len(rows)):
        places, x = ae._rows(pa.array(rows, pa.list_(pa.float64())).slice(at), 2)
        want = [k for k, v in enumerate(rows[at:]) if v and len(v) == 2 and None not in v and not np.isnan(v).any()]
        assert places.tolist() == want and x.tolist() == [rows[at + k] for k in want]
