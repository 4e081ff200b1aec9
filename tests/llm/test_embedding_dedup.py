import random

import numpy as np

from docloom.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, rep int"


def brute(rows):
    sound = [k for k, (i, v, l, _) in enumerate(rows) if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for n, a in enumerate(sound):
        for b in sound[:n]:
            x, y = (np.array(rows[k][1], dtype=float) for k in (a, b))
            if len(x) == len(y):
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
            if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    least: dict = {}
    for k in sound:
        ids = [i for i in (least.get(root(k)), rows[k][0]) if i is not None]
        least[root(k)] = min(ids, default=None)
    out = []
    for k, r in enumerate(rows):
        c = least[root(k)] if k in sound else r[0]
        out.append((r[0], links[k], c, r[0] is not None and r[0] == c))
    return sorted(out, key=str)


def rows_of(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    rows = []
    for i in range(n):
        v = centres[i % 6] + rng.standard_normal(dim) * rng.choice([0.0, 0.02, 0.08, 1.0])
        rows.append((1000 - i, [float(np.float32(x)) for x in v], int(i % 2), 1))
    return rows


def test_against_brute_force(spark, monkeypatch):
    for dim, n in ((64, 160), (3, 40), (1, 12)):
        rows = rows_of(n, dim, dim)
        rows += [(2000, None, 0, 1), (2001, [0.0] * dim, 0, 1), (2002, [float("nan")] * dim, 0, 1), (2003, [None] * dim, 0, 1), (2004, rows[0][1], None, 1), (None, rows[0][1], 0, 1), (2005, [], 0, 1), rows[1], rows[1], (2006, rows[0][1] + [1.0], 0, 1)]
        got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA))
        assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows)


def test_clashing_ids_and_rows_without_id(spark):
    """Classes are told apart by what they hold: one id with two vectors or labels, and bridges without an id."""
    turn = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d))), 0.0]
    rows = [(7, turn(0), 0, 1), (7, turn(90), 1, 1), (8, turn(2), 0, 1), (3, turn(91), 1, 1), (7, turn(180), 0, 1)]
    # 20 and 40 degrees are linked only through a row without an id; two such rows alone have no component.
    rows += [(21, turn(50), 0, 1), (None, turn(60), 0, 1), (20, turn(70), 0, 1), (None, turn(250), 0, 1), (None, turn(251), 0, 1)]
    for kind in ("float", "double"):
        schema = f"vec_id long, embedding array<{kind}>, label int, rep int"
        got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, schema))
        assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows)


def test_double_precision(spark):
    """Cosines beside the threshold by less than a float can tell, and components over a float's range."""
    rows, k = [], 0
    for gap in (1e-9, -1e-9, 1e-12, -1e-12):
        angle = np.arccos(0.98 + gap)
        for scale in (1.0, 1e300, 1e-290):
            rows += [(k, [scale, 0.0, 0.0], k, 1), (k + 1, [scale * float(np.cos(angle)), scale * float(np.sin(angle)), 0.0], k, 1)]
            k += 2
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep int"))
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == {i: int(i // 6 % 2 == 0) for i in range(k)}


def test_large_buckets_are_dealt_over_cells(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SLICE", 5)
    monkeypatch.setattr(embedding_dedup, "LAYOUT_SAMPLE", 1)
    rows = rows_of(120, 16, 9)
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA))
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    bands, bits = embedding_dedup.band_plan(5000)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.9801 * a + np.sqrt(1 - 0.9801**2) * side
    met = (embedding_dedup.encode(a, bands, bits)[0] == embedding_dedup.encode(b, bands, bits)[0]).any(1)
    assert met.mean() > 0.985
    both = embedding_dedup.unit_rows(np.concatenate((a[:300], b[:300])))
    i, j = embedding_dedup.linked_pairs(both, embedding_dedup.encode(both, bands, bits)[1], 0, 300, 0.98)
    assert {(k, k + 300) for k in range(300)} <= set(zip(i.tolist(), j.tolist()))


def test_estimate_is_unbiased():
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((2, 64))
    x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
    found = []
    for seed in range(400):
        q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((64, 64)))
        code = np.sign(x @ q) / 8
        found.append(code @ (y @ q) / (code @ (x @ q)))
    assert abs(np.mean(found) - x @ y) < 0.02


def test_empty(spark):
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_random_seed_is_fixed():
    random.seed(0)
    assert np.array_equal(embedding_dedup.rotations(8, 2), embedding_dedup.rotations(8, 2))
