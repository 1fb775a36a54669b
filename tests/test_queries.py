import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from deltaloom.plans import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(v):
    if v is None or str(v) in ("nan", "NaT", "<NA>", "None"):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, db, name):
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), db.sql(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False, name=None)), key=str)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
