"""Queries against their SQL on rows where the two once told different rules."""

import datetime

import duckdb
import pytest

from docloom.plans import registry
from tests.test_oracles import _rows


def _same(spark, folder, name, **made):
    for table, frame in made.items():
        frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    got = registry.queries()[name](spark, str(folder)).toPandas()
    duck = duckdb.connect()
    for table in made:
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert _rows(got, columns) == _rows(want, columns)
    return got


def test_amount_whose_digits_stand_in_the_student_id(spark, tmp_path):
    orders = spark.createDataFrame([(40000, 7, 40000.5, datetime.datetime(1995, 1, 2)), (5, 7, 2001.0, datetime.datetime(1994, 3, 4))], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp")
    customer = spark.createDataFrame([(7, 3)], "c_custkey long, c_nationkey long")
    got = _same(spark, tmp_path, "e1_extract_entities", orders=orders, customer=customer)
    amounts = got[got["type"] == "SCHOLARSHIP_AMOUNT"]
    assert sorted(amounts["text"]) == ["2001", "40000"] and (amounts["start"] > 60).all()


@pytest.mark.parametrize("name", ["a11_error_envelope", "a11_write_rejects"])
def test_rejected_texts_over_the_cap(spark, tmp_path, name):
    pages = spark.createDataFrame([(0, "x" * 50_001), (3, "字" * 50_000), (6, None), (9, "y" * 60_000), (1, "z"), (2, "z" * 70_000)], "page_id long, html string")
    got = _same(spark, tmp_path, name, pages=pages)
    assert sorted(v for v in got["value"] if "too long" in v) == ['{"code":400,"message":"text too long","detail":"0"}', '{"code":400,"message":"text too long"}']
