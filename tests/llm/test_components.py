import random

import pytest

from docloom.llm import common


def brute(edges):
    up = {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        p, q = root(up.setdefault(a, a)), root(up.setdefault(b, b))
        up[max(p, q)] = min(p, q)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("narrow, a_partition, held", [(False, 50_000, 200_000), (True, 50_000, 200_000), (True, 60, 240), (True, 7, 10)])
def test_components_against_brute_force(spark, monkeypatch, narrow, a_partition, held):
    monkeypatch.setattr(common, "EDGES_A_PARTITION", a_partition)
    monkeypatch.setattr(common, "HELD_NODES", held)
    rng = random.Random(7)
    edges = [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(70)]
    edges += [(1000 + k + 1, 1000 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(40)]
    edges += [(3, 3), (8000, 8000), (1001, 1000), (1000, 1001), (None, 5), (5, None)]
    rng.shuffle(edges)
    table = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = [tuple(r) for r in common.connected_components(table, narrow=narrow).collect()]
    assert dict(got) == brute(edges) and len(got) == len(dict(got))


@pytest.mark.parametrize("narrow", [False, True])
def test_no_edges(spark, narrow):
    assert common.connected_components(spark.createDataFrame([], "a long, b long"), narrow=narrow).count() == 0
