import duckdb
import pytest

from docloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = registry.queries()[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    plain = lambda t: tuple(round(v, 9) if isinstance(v, float) else v for v in t)
    assert sorted(map(plain, rows), key=str) == sorted(map(plain, want), key=str)


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
