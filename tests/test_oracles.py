"""Each telemetry query against its SQL, run by another engine."""

import math

import duckdb
import pytest

import alarmlens.plans.evidence  # noqa: F401
import alarmlens.plans.detection  # noqa: F401  registers its queries
import alarmlens.plans.ensembles  # noqa: F401
import alarmlens.plans.models  # noqa: F401
import alarmlens.plans.onsets  # noqa: F401
import alarmlens.plans.resampling  # noqa: F401
import alarmlens.plans.sequences  # noqa: F401
import alarmlens.plans.studies  # noqa: F401
from alarmlens.operators.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for name in ("events", "documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, other, name):
    got = QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    want = other.sql(ORACLES[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
