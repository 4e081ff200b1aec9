import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from docloom.llm import line_dedup

SCHEMA = "doc_id long, text string, n_lines string, __doc int"


def brute(rows, min_docs):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    seen: dict = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line):
                seen.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(seen[key(x)]) < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = ["Alpha", " alpha\t", "ALPHA ", "béta", "BÉTA", "", "  ", "γ\x0b", "x" * 5000]
    rows = [(i, "\n".join(rng.choice([*pool, f"own {i} {k}"]) for k in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "alpha\nown"), (None, "alpha"), rows[0], rows[0], (7, "béta\nalpha"), (102, "lonely")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    for least in (3, 10):
        got = line_dedup.dedup_lines(docs, min_docs=least)
        assert sorted([tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()], key=str) == brute(rows, least)


def test_hot_line_is_spread(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LAYOUT_SAMPLE", 1.0)
    rows = [(i, f"Hot\nown {i}\nhot ") for i in range(200)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_dropped", "kept_text").collect()) == [(i, 2, f"own {i}") for i in range(200)]


@pytest.mark.parametrize("sample", [0.02, 1.0])
def test_first_occurrence_may_stay(spark, monkeypatch, sample):
    monkeypatch.setattr(line_dedup, "LAYOUT_SAMPLE", sample)
    docs = spark.createDataFrame([(i, f"a\nb{i}\na") for i in range(40)], "doc_id long, text string")
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(docs, min_docs=2, keep_first=True).collect()}
    assert got == {i: f"a\nb{i}" if i == 0 else f"b{i}" for i in range(40)}


def test_empty_and_runs(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    row = spark.range(1).select(line_dedup.run_lengths(F.array(*map(F.lit, (0, 1, 4, 5, 6, 9)))).alias("r")).head()
    assert row["r"] == [0, 2, 2, 3, 2, 1]


def test_query_digest(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows, 10))
    assert sorted(tuple(r) for r in line_dedup.op1_line_dedup(spark, sf).collect()) == want


def test_long_text_of_alternating_lines(spark):
    """Runs are built in one pass: a hundred thousand of them in one text are a matter of seconds."""
    n = 100_000
    rows = [(i, "common") for i in range(10)] + [(50, "\n".join(f"own {k}" if k % 2 else "Common" for k in range(2 * n)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.perf_counter()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()}
    assert got[50]["n_lines"] == 2 * n and got[50]["n_dropped"] == n
    assert got[50]["kept_text"] == "\n".join(f"own {k}" for k in range(1, 2 * n, 2))
    assert time.perf_counter() - start < 60
