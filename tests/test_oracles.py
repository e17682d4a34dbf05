"""Every query that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from pitchlake.plans import catalog, library  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame: pd.DataFrame) -> list:
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "~"
        return repr(float(x) + 0.0) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    mine = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        theirs = duck.sql(catalog.ORACLES[name]).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert rows(mine) == rows(theirs)
    else:
        assert len(mine)
