"""Operator 12: embedding whitening by a distributed covariance and a tridiagonal eigensolver.

1. Entries become whole numbers; the number of rows and the sums per dimension are exact.
2. Each partition sums the products of its centred rows; a sum by matrix row adds the partitions up.
3. The covariance is reduced to tridiagonal form by Householder reflections. Sturm counts bisect the leading
   eigenvalues; inverse iteration, orthogonal within clusters, finds their vectors, and the reflections turn these
   back. The matrix has dims x dims numbers, whatever the number of rows.
4. Components are broadcast. One pass measures the covariance of the whitened rows, one projects every row.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpointed, read

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Beyond this, entries are set to it: they stay within a 64-bit number.
REACH = 1 << 61
#: Bytes of components that one pass over the rows takes along.
MODEL_BYTES = 32_000_000
SEED = 12


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``(diagonal, off-diagonal, unit reflectors)`` of a symmetric matrix by Householder reflections."""
    a, n = a.copy(), len(a)
    reflectors = []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        rest = np.abs(x[1:]).max()
        if rest == 0:
            reflectors.append(np.zeros(n - k - 1))
            continue
        top = max(rest, abs(x[0]))
        v = x / top
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        reflectors.append(v)
        block = a[k + 1 :, k + 1 :]
        p = 2 * (block @ v)
        w = p - (p @ v) * v
        block -= np.outer(v, w) + np.outer(w, v)
        reflected = x - 2 * (v @ x) * v
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = reflected[0]
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def counts_below(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of ``at``: negative pivots of the Sturm sequence."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, np.abs(e).max(initial=0.0) ** 2)
    below, q = np.zeros(len(at), np.int64), np.ones(len(at))
    for k in range(len(d)):
        q = d[k] - at - (e[k - 1] * e[k - 1] / q if k else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading_values(d: np.ndarray, e: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, largest first, bisected to the last bit."""
    n = len(d)
    span = np.concatenate(([0.0], np.abs(e))) + np.concatenate((np.abs(e), [0.0]))
    wide = np.finfo(float).eps * n * max(np.abs(d).max() + span.max(), np.finfo(float).tiny)
    low, high = np.full(count, (d - span).min() - wide), np.full(count, (d + span).max() + wide)
    order = n - 1 - np.arange(count)
    for _ in range(128):
        mid = low + (high - low) / 2
        under = counts_below(d, e, mid) <= order
        low, high = np.where(under, mid, low), np.where(under, high, mid)
        if (np.nextafter(low, high) >= high).all():
            break
    return low + (high - low) / 2


def _solve_shifted(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """The tridiagonal matrix less ``shift``, solved by elimination with row exchanges; zero pivots become ``tiny``."""
    n = len(d)
    main, up, up2, x = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    for k in range(n - 1):
        under, next_main, next_up = e[k], main[k + 1], up[k + 1]
        if abs(under) > abs(main[k]):
            main[k], under = under, main[k]
            up[k], next_main = next_main, up[k]
            up2[k], next_up = next_up, 0.0
            x[k], x[k + 1] = x[k + 1], x[k]
        if abs(main[k]) < tiny:
            main[k] = tiny
        f = under / main[k]
        main[k + 1], up[k + 1] = next_main - f * up[k], next_up - f * up2[k]
        x[k + 1] -= f * x[k]
    if abs(main[-1]) < tiny:
        main[-1] = tiny
    for k in range(n - 1, -1, -1):
        if k + 1 < n:
            x[k] -= up[k] * x[k + 1]
        if k + 2 < n:
            x[k] -= up2[k] * x[k + 2]
        x[k] /= main[k]
    return x


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix as rows; within a cluster each is made orthogonal to those before."""
    n, rng = len(d), np.random.default_rng(SEED)
    norm = max(np.abs(d).max(), np.abs(e).max(initial=0.0), np.finfo(float).tiny)
    eps, found, start = np.finfo(float).eps, np.zeros((len(values), n)), 0
    shift = np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            start = k
        # Equal values get shifts a few bits apart, so that their solutions differ.
        shift = min(value, shift - 4 * eps * norm) if k > start else value
        x = rng.standard_normal(n)
        for _ in range(5):
            for _ in range(2):
                x -= found[start:k].T @ (found[start:k] @ x)
            x = _solve_shifted(d, e, shift, x / np.linalg.norm(x), eps * norm)
            x /= np.abs(x).max()
        for _ in range(2):
            x -= found[start:k].T @ (found[start:k] @ x)
            x /= np.linalg.norm(x)
        found[k] = x
    return found


def leading_components(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``(eigenvalues, unit eigenvectors as rows)`` of a symmetric matrix, largest first.

    Components of no variance, up to rounding, are left out.
    """
    largest = np.abs(a).max(initial=0.0)
    if largest == 0:
        return np.zeros(0), np.zeros((0, len(a)))
    d, e, reflectors = tridiagonal(a / largest)
    values = leading_values(d, e, min(count, len(a)))
    values = values[values > 4 * len(a) * np.finfo(float).eps * max(np.trace(a) / largest, values[0])]
    vectors = leading_vectors(d, e, values)
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        vectors[:, k + 1 :] -= 2 * np.outer(vectors[:, k + 1 :] @ v, v)
    return values * largest, vectors


def whole_numbers(flat: np.ndarray, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """``floor(scale * c) + shift`` of doubles as 64-bit integers."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * flat), -REACH, REACH).astype(np.int64) + shift


def _rows(batch: pa.RecordBatch, dim: int, first: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows of a length and their whole numbers; column ``first`` holds the length, the next the vector."""
    part = batch.filter(pa.array(batch.column(first).to_numpy(zero_copy_only=False) == dim))
    flat = part.column(first + 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return part, whole_numbers(flat).reshape(-1, dim)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``(n * x - S exactly, x - S / n)``; in Python's integers where 64 bits could overflow."""
    reach = n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, sums))
    if reach < 1 << 62:
        exact = n * x - np.array(sums, np.int64)
        return exact, exact / n
    exact = n * x.astype(object) - np.array(sums, dtype=object)
    return exact, (exact / n).astype(np.float64)


def _deviations(exact: np.ndarray) -> list:
    """Sums of squares of whole numbers, null where they leave the 64-bit range."""
    largest = int(np.abs(exact).max(initial=0))
    if largest * largest * max(exact.shape[1], 1) < 1 << 63:
        return (exact * exact).sum(axis=1).tolist()
    found = [sum(int(v) * int(v) for v in row) for row in exact]
    return [v if v < 1 << 63 else None for v in found]


def _fits(rows: DataFrame) -> list[dict]:
    """``dim``, ``n`` and exact sums ``S`` of every length."""

    def sums(batches):
        total: dict = {}
        for batch in batches:
            for dim in np.unique(batch.column(0).to_numpy(zero_copy_only=False)).tolist():
                part, x = _rows(batch, dim, 0)
                n, s = total.get(dim, (0, np.zeros(dim, dtype=object)))
                high, low = x >> 24, x & 0xFFFFFF
                total[dim] = (n + len(x), s + high.sum(axis=0).astype(object) * (1 << 24) + low.sum(axis=0).astype(object))
        for dim, (n, s) in total.items():
            columns = [pa.array([dim] * dim, pa.int64()), pa.array(range(dim), pa.int64()), pa.array([n] * dim, pa.int64()), pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "i", "n", "s"])

    partial = rows.select("dim", "v").mapInArrow(sums, "dim long, i long, n long, s decimal(38,0)")
    found: dict = {}
    for r in partial.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        fit = found.setdefault(r["dim"], {"dim": r["dim"], "n": r["n"], "sums": [0] * r["dim"]})
        fit["sums"][r["i"]] = int(r["s"])
    return [found[dim] for dim in sorted(found)]


def _products(rows: DataFrame, fits: list[dict], model: bool) -> DataFrame:
    """``(dim, i, row)``: rows of the sums of products of centred vectors, or of whitened ones with ``model``."""
    sent = rows.sparkSession.sparkContext.broadcast({f["dim"]: f for f in fits})

    def run(batches):
        total: dict = {}
        for batch in batches:
            for dim in np.unique(batch.column(0).to_numpy(zero_copy_only=False)).tolist():
                if (fit := sent.value.get(dim)) is None:
                    continue
                _, centred = _centred(_rows(batch, dim, 0)[1], fit["n"], fit["sums"])
                if model:
                    centred = centred @ fit["project"]
                total[dim] = total.get(dim, 0) + centred.T @ centred
        for dim, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(part), pa.int64()), pa.array(range(len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float64()))], names=["dim", "i", "row"])

    partial = rows.select("dim", "v").mapInArrow(run, "dim long, i long, row array<double>")
    cells = partial.select("dim", "i", F.posexplode("row").alias("j", "x")).groupBy("dim", "i", "j").agg(F.sum("x").alias("x"))
    return cells.groupBy("dim", "i").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("row")).select("dim", "i", F.col("row.x").alias("row"))


def _solved(rows: DataFrame, fits: list[dict], components: int) -> list[dict]:
    """The fits with eigenvalues, projection and shares of variance; solved in a task for each length."""
    size = {f["dim"]: f["n"] for f in fits}

    def solve(table: pd.DataFrame) -> pd.DataFrame:
        dim = int(table["dim"].iloc[0])
        a = np.array(table.sort_values("i")["row"].tolist(), dtype=np.float64) / size[dim]
        a = (a + a.T) / 2
        values, vectors = leading_components(a, components)
        return pd.DataFrame({"dim": dim, "k": range(len(values)), "value": values, "share": values / np.trace(a) if len(values) else values, "vector": pd.Series(vectors.tolist(), dtype=object)})

    solved = _products(rows, fits, False).groupBy("dim").applyInPandas(solve, "dim long, k long, value double, share double, vector array<double>")
    by_dim: dict = {}
    for r in solved.orderBy("dim", "k").collect():
        by_dim.setdefault(r["dim"], []).append(r)
    out = []
    for fit in fits:
        own = by_dim.get(fit["dim"], [])
        values = np.array([r["value"] for r in own])
        vectors = np.array([r["vector"] for r in own]).reshape(len(own), fit["dim"])
        out.append(fit | {"share": [r["share"] for r in own], "project": (vectors / np.sqrt(values)[:, None]).T})
    return out


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row for each vector and component.

    Rows whose vector is null or holds null or non-finite entries are dropped; zero vectors, repeated rows and rows
    without an id or with one that repeats count as any other. Vectors of another length are fitted among
    themselves. Components without variance (fewer distinct vectors than dimensions, one row) give no rows, as nothing can
    be whitened along them. Entries beyond 2**61 are taken as that; a deviation beyond 64 bits is null. Other
    columns play no part, whatever their names. Empty table: empty result.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    kept = kept.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0))
    rows = kept.select("vec_id", F.size("v").cast("long").alias("dim"), "v")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fits, out, group = _fits(rows), None, []
    for k, fit in enumerate(fits):
        group.append(fit)
        # As many lengths at once as their components may be sent along for.
        if k + 1 < len(fits) and sum(8 * f["dim"] * (components + f["dim"]) for f in [*group, fits[k + 1]]) < MODEL_BYTES:
            continue
        own = rows.where(F.col("dim").isin([f["dim"] for f in group]))
        solved = _solved(own, group, components)
        errors = {f["dim"]: np.zeros((f["project"].shape[1], f["project"].shape[1])) for f in solved}
        for r in _products(own, solved, True).collect():
            errors[r["dim"]][r["i"]] = r["row"]
        models = {f["dim"]: f | {"error": float(np.abs(errors[f["dim"]] / f["n"] - np.eye(len(errors[f["dim"]]))).max(initial=0.0))} for f in solved}
        part = own.mapInArrow(_projector(spark.sparkContext.broadcast(models)), schema)
        out, group = part if out is None else out.unionAll(part), []
    return spark.createDataFrame([], schema) if out is None else out


def _projector(sent):
    def run(batches):
        for batch in batches:
            for dim in np.unique(batch.column(1).to_numpy(zero_copy_only=False)).tolist():
                if (fit := sent.value.get(dim)) is None or not (width := fit["project"].shape[1]):
                    continue
                part, x = _rows(batch, dim, 1)
                exact, centred = _centred(x, fit["n"], fit["sums"])
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(x)), width)))
                many = lambda values: np.tile(np.asarray(values), len(x))
                deviation = pa.array(_deviations(exact), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), width)))
                columns = [ids, pa.array(many(np.arange(1, width + 1)), pa.int32()), pa.array(many([fit["n"]] * width), pa.int64()), deviation]
                columns += [pa.array((centred @ fit["project"]).ravel()), pa.array(many(fit["share"])), pa.array(many([fit["error"]] * width))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
