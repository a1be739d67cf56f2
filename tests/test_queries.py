"""Every core query runs on the smallest data, and the ones with SQL give its result."""

import math
import os

import duckdb
import pytest

from partwright.plans import catalog

NAMES = sorted(catalog.queries())
SQL = catalog.oracle_sql()


def rows(df):
    df = df[sorted(df.columns)]
    def show(x):
        return None if x is None or str(x) in ("NaT", "<NA>", "nan") else f"{x:.6g}" if isinstance(x, float) and not math.isnan(x) else str(x)
    return sorted((tuple(show(x) for x in r) for r in df.astype(object).values.tolist()), key=str)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, duck, name):
    got = catalog.queries()[name](spark, data).toPandas()
    if name in SQL:
        assert rows(got) == rows(duck.execute(SQL[name]).df())
