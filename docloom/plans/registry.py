"""The library's queries and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import oracles
from docloom.plans import queries as q


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.flagship(spark, sf_dir)


def queries() -> dict:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.ORACLES.items() if k in q.QUERIES}
