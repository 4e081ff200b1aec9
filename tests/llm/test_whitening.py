import numpy as np
import pytest

from docloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n int, component int, v int"


def run(spark, rows):
    got = whitening.whiten(spark.createDataFrame([(*r, 1, 1, 1) for r in rows], SCHEMA)).collect()
    return sorted([tuple(r) for r in got], key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def expected(vectors):
    """Numbers of one table of equally long vectors by the library's own eigensolver, exact deviations in Python."""
    x = np.floor(64 * np.array(vectors, dtype=float)) + 1_000_000
    n, sums = len(x), [int(s) for s in x.sum(0)]
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, (centred @ vectors[:, ::-1])[:, :32] / np.sqrt(values[::-1][:32]), (values[::-1] / values.sum())[:32]


@pytest.mark.parametrize("dim,n", [(40, 200), (5, 60), (2, 7), (1, 9)])
def test_against_a_library_solver(spark, dim, n):
    rng = np.random.default_rng(dim)
    vectors = (rng.standard_normal((n, dim)) * rng.uniform(0.5, 3, dim)).tolist()
    got = run(spark, list(enumerate(vectors)))
    size, deviation, white, share = expected(vectors)
    width = min(dim, 32)
    assert len(got) == n * width
    table = np.array([r[4] for r in got]).reshape(n, width)
    signs = np.sign((table * white).sum(0))
    assert np.abs(table * signs - white).max() < 1e-9
    assert [r[3] for r in got[::width]] == deviation and {r[2] for r in got} == {size}
    assert np.allclose([r[5] for r in got[:width]], share, rtol=1e-10, atol=0)
    assert len({r[6] for r in got}) == 1 and got[0][6] < 1e-10
    cov = table.T @ table / n
    assert abs(np.abs(cov - np.eye(width)).max() - got[0][6]) < 1e-12


def test_solver_on_clusters_and_splits():
    """Equal and nearly equal eigenvalues, diagonal and low-rank matrices."""
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((48, 48)))
    for values in ([5.0] * 20 + [1.0] * 28, [7.0, 7.0 - 1e-13, 7.0 - 2e-9] + [2.0] * 45, np.linspace(1, 1.0001, 48), [3.0] * 4 + [0.0] * 44, 10.0 ** -np.arange(48)):
        values = np.sort(values)[::-1]
        for basis in (q, np.eye(48)):
            a = basis @ np.diag(values) @ basis.T
            e, v = whitening.leading_components((a + a.T) / 2, 32)
            assert len(e) == min(32, (values > 1e-13 * values[0]).sum()) or values[-1] == 10.0**-47
            assert np.abs(e - values[: len(e)]).max() < 1e-13 * values[0] * 48
            assert np.abs(v @ v.T - np.eye(len(v))).max() < 1e-12
            assert np.abs(a @ v.T - v.T * e).max() < 1e-12 * values[0]
    assert whitening.leading_components(np.zeros((3, 3)), 32)[1].shape == (0, 3)


def test_odd_rows(spark):
    """Dropped: null vectors, null and non-finite entries. Counted: zero vectors, repeated rows and ids, missing ids. Each length by itself."""
    vectors = [[0.0, 0.0], [1.0, 2.0], [1.0, 2.0], [-3.0, 0.5], [2.0, 2.0], [0.25, -1.0]]
    ids = [1, 2, 2, None, 5, 6]
    rows = [*zip(ids, vectors), (7, None), (8, [None, 1.0]), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0]), (11, []), (12, [4.0]), (13, [6.0]), (14, [1.0, 1.0, 1.0])]
    got = run(spark, rows)
    n, deviation, _, _ = expected(vectors)
    two = [r for r in got if r[0] not in (12, 13)]
    assert n == 6 and len(two) == 12 and {r[2] for r in two} == {6} and not {7, 8, 9, 10, 11, 14} & {r[0] for r in two}
    assert sorted({(r[0] or 0, r[3]) for r in two}) == sorted(set(zip([i or 0 for i in ids], deviation)))
    assert sorted((r[0], r[1], abs(round(r[4], 9))) for r in got if r[0] in (12, 13)) == [(12, 1, 1.0), (13, 1, 1.0)]
    assert run(spark, []) == [] and run(spark, [(1, [1.0, 2.0])]) == [] and run(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_large_entries(spark):
    """Sums and deviations are exact beyond doubles; beyond 64 bits a deviation is null."""
    vectors = [[1e7 + 0.25, 1.0], [-1e7, 2.0], [3e6, 5.0]]
    got = run(spark, list(enumerate(vectors)))
    assert [r[3] for r in got[::2]] == expected(vectors)[1]
    huge = run(spark, [(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [0.0, 3.0])])
    assert huge and all(r[3] is None for r in huge if r[0] < 2)


def test_lengths_in_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(100 * d + k, rng.standard_normal(d).tolist()) for d in (2, 3, 4) for k in range(8)]
    whole = run(spark, rows)
    monkeypatch.setattr(whitening, "MODEL_BYTES", 1)
    assert [r[:4] for r in run(spark, rows)] == [r[:4] for r in whole] and len(whole) == 8 * 9
