"""Each catalog query against its SQL, on the smallest tables."""

import duckdb
import pytest

from quillgrid.plans import catalog, oracles

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    cell = lambda v: "~" if str(v) in ("None", "nan", "<NA>") else repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype != bool else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_matches_sql(spark, duck, name):
    want, got = duck.sql(oracles.oracle_sql()[name]).df(), catalog.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(want) == rows(got)
