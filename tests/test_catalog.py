"""Every query against its DuckDB SQL, on the small tables."""

import math

import duckdb
import pytest

from verdica import session
from verdica.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
        return None
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def table(pdf):
    return sorted(tuple(cell(x) or "" for x in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    session.ship(spark)
    mine, sql = catalog.queries()[name](spark, SF).toPandas(), catalog.oracle_sql()[name]
    other = duck.execute(sql).df()
    assert sorted(mine.columns) == sorted(other.columns) and table(mine) == table(other)


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.queries()) <= set(entry.queries())
    assert set(catalog.oracle_sql()) == set(catalog.queries())
