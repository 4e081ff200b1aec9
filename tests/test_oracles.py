"""Every query with SQL gives the rows that DuckDB gives; every other one runs."""

import duckdb
import pytest

from docloom.plans import registry

TABLES = "customer orders lineitem documents pages conversations nation".split()
ORACLES = registry.oracle_sql()


def _plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool) or isinstance(value, str):
        return value
    return round(float(value), 9)


def _rows(frame, columns):
    return sorted((tuple(_plain(v) for v in row) for row in frame[columns].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, name):
    got = registry.queries()[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert len(got.columns) > 1
        return
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = duck.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert _rows(got, columns) == _rows(want, columns)
