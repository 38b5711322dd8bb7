"""Each registered query of the motif engine against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from ribolens import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    at = duckdb.connect()
    for t in TABLES:
        at.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return at


def plain(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda x: None if pd.isna(x) else round(float(x), 5) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(map(cell, r)) for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql(spark, con, name):
    ours, theirs = catalog.QUERIES[name](spark, DATA).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
