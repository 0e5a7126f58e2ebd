"""Every query with SQL against DuckDB on the smallest driver tables."""

import decimal
import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as contract

SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return [plain(v) for v in value]
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="driver tables absent")
@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SMALL)
    cursor = duck.execute(contract.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(names, cursor.fetchall())


@pytest.mark.skipif(not Path(SMALL).exists(), reason="driver tables absent")
def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["deck", "elements", "preserved", "excluded", "cached", "generated", "reused"]
    assert df.count() > 0


def test_names_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())
