"""Every query against its DuckDB SQL, and the entry points."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from ridgewave.registry import ORACLES, QUERIES

from .conftest import SF
from .oracle import connect, same


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same(df, con, ORACLES[name])
    else:
        df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "snr_db" in df.columns


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
