"""Every query with SQL gives the rows DuckDB gives."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from photonlake.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")


def rows(frame):
    def text(x):
        if x is None or x != x:
            return None
        x = x.item() if hasattr(x, "item") else x
        return repr(float(x)) if isinstance(x, (float, Decimal)) else str(x)

    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(text, r)) for r in frame[columns].astype(object).values.tolist()), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {file.stem} as select * from '{file}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.SQL:
        assert rows(got) == rows(duck.sql(registry.SQL[name]).df())
    else:
        assert len(got)


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() >= 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
