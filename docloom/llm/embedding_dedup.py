"""Operator 10: embedding near-duplicates by randomised-rotation binary codes.

1. Exact copies (by label) are one class with a number of its own; only classes go on, with their number of copies.
2. A class's unit vector is turned by seeded random rotations; the signs are its binary code. The first
   rotation also stores its correction factor, the inner product of the turned vector with its own code.
3. Slices of the code ("bands") key buckets within a label. The band width follows the size of
   the largest label, so that chance meetings stay few, and the number of bands the width, so that a pair
   at the threshold misses every band with probability under ``MISS``.
4. Buckets are sorted runs read as a stream. For each pair, code and factor give an unbiased estimate of
   the cosine and a confidence bound; pairs that the bound cannot rule out are recomputed from the vectors
   in double precision. A pair counts in the first band it meets in. What leaves a bucket is a sum of
   links by class and a spanning forest, not the pairs. Large buckets are dealt over cells of slice pairs.
5. Components of the forest are the groups; each is named by the smallest id of its classes.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpointed, connected_components, read, shuffle_width

THRESHOLD = 0.98
#: Chance that a pair at the threshold meets in no band.
MISS = 0.002
#: Width of the confidence bound in standard errors; a bound fails with probability about 2 exp(-EPSILON**2 / 2).
EPSILON = 4.0
SLICE = 2048
LAYOUT_SAMPLE = 16
SEED = 20


def band_plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """``(bands, bits a band)`` for labels of up to ``n`` classes."""
    bits = min(max(math.ceil(math.log2(max(n, 2))), 8), 24)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(MISS) / math.log(1 - agree)), bits


@lru_cache(maxsize=8)
def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random orthogonal matrices, stacked side by side: dim x (dim * count)."""
    rng = np.random.default_rng([SEED, dim])
    found = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        found.append(q * np.sign(np.diag(r)))
    return np.hstack(found)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, as squares of large doubles overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def encode(vectors: np.ndarray, bands: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n x bands) and correction factors (n) of row vectors."""
    n, dim = vectors.shape
    turned = unit_rows(vectors) @ rotations(dim, -(-bands * bits // dim))
    signs = turned[:, : bands * bits] > 0
    keys = signs.reshape(n, bands, bits) @ (1 << np.arange(bits, dtype=np.int64))
    return keys, np.abs(turned[:, :dim]).sum(1) / math.sqrt(dim)


def linked_pairs(unit: np.ndarray, factors: np.ndarray, at: int, to: int, threshold: float, turned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of unit rows ``at..to`` with any row whose exact cosine reaches the threshold.

    ``turned``: the rows after the first rotation, for callers that ask for several ranges of the same rows.
    """
    dim = unit.shape[1]
    turned = unit @ rotations(dim, 1) if turned is None else turned
    code = np.where(turned[at:to] > 0, 1.0, -1.0) / math.sqrt(dim)
    f = np.clip(factors[at:to, None], 1e-9, 1.0)
    estimate = code @ turned.T / f
    bound = EPSILON * np.sqrt((1 - f * f) / (f * f)) / math.sqrt(max(dim - 1, 1))
    i, j = np.nonzero(estimate + bound >= threshold)
    keep = np.zeros(len(i), bool)
    for s in range(0, len(i), 65_536):
        a, b = i[s : s + 65_536] + at, j[s : s + 65_536]
        keep[s : s + 65_536] = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
    return i[keep] + at, j[keep]


def _bucket(rows: dict, threshold: float):
    """Links of one run: (representatives, partner copies) and forest edges."""
    n, band = len(rows["rep"]), int(rows["band"][0])
    unit, keys, own = unit_rows(rows["vector"]), rows["keys"], rows["own"]
    turned = unit @ rotations(unit.shape[1], 1)
    crossing = rows["cell_i"][0] != rows["cell_j"][0]
    degree, up, edges = np.zeros(n, np.int64), list(range(n)), []

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for at in range(0, n, 256):
        i, j = linked_pairs(unit, rows["factor"], at, min(at + 256, n), threshold, turned)
        ok = i < j
        if crossing:
            ok &= own[i] != own[j]
        i, j = i[ok], j[ok]
        if band and len(i):
            first = ~(keys[i, :band] == keys[j, :band]).any(1)
            i, j = i[first], j[first]
        np.add.at(degree, i, rows["copies"][j])
        np.add.at(degree, j, rows["copies"][i])
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
                edges.append((a, b))
    return degree, edges


_ROW = ["label", "dim", "band", "key", "cell_i", "cell_j"]


def bucket_links(batches, threshold: float):
    """For sorted rows of runs (``_ROW``): ``(a, null, links)`` for classes and ``(a, b, 0)`` for forest edges."""
    names = [*_ROW, "own", "rep", "copies", "factor"]
    held = None

    def emit(part: dict):
        if len(part["rep"]) < 2:
            return
        degree, edges = _bucket(part, threshold)
        has = np.nonzero(degree)[0]
        if len(has):
            a = [*part["rep"][has].tolist(), *(int(part["rep"][x]) for x, _ in edges)]
            b = [*[None] * len(has), *(int(part["rep"][y]) for _, y in edges)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*degree[has].tolist(), *[0] * len(edges)], pa.int64())], names=["a", "b", "n"])

    def runs(block: dict, final: bool):
        total = len(block["rep"])
        new = np.zeros(total, bool)
        for c in _ROW:
            new[1:] |= block[c][1:] != block[c][:-1]
        starts = np.nonzero(new)[0].tolist()
        bounds = [0, *starts, total] if total else [0]
        for s, e in zip(bounds[: -1 if final else -2], bounds[1:]):
            if e - s > 1:
                part = {c: v[s:e] for c, v in block.items() if c not in ("vector", "keys")}
                wide = np.float32 if len(block["vector"][s]) == 4 * block["dim"][s] else np.float64
                part["vector"] = np.array([np.frombuffer(v, wide) for v in block["vector"][s:e]], dtype=np.float64)
                part["keys"] = np.array([np.frombuffer(v, np.int32) for v in block["keys"][s:e]])
                yield from emit(part)
        return

    for batch in batches:
        if not batch.num_rows:
            continue
        block = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names}
        for c in ("vector", "keys"):
            block[c] = np.array(batch.column(batch.schema.get_field_index(c)).to_pylist(), dtype=object)
        if held is not None:
            block = {c: np.concatenate((held[c], v)) for c, v in block.items()}
        yield from runs(block, False)
        same = np.ones(len(block["rep"]), bool)
        for c in _ROW:
            same &= block[c] == block[c][-1]
        last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        held = {c: v[last:] for c, v in block.items()}
    if held is not None:
        yield from runs(held, True)


def near_duplicate_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: one row for each row of ``vectors``.

    Vectors of equal, non-null label and equal length are linked when their cosine in double precision is
    ``threshold`` or more. Null or zero vectors, vectors with null or non-finite components, and
    rows without label link with nothing: 0 links, their own component. Repeated rows, and rows that share an
    id but not their vector or label, are vectors of their own and link by what they hold. Rows
    without an id link like others; they name no component and are never kept. Empty table: empty result.
    """
    spark = vectors.sparkSession
    single = vectors.schema[embedding].dataType.simpleString() in ("array<float>", "array<tinyint>", "array<smallint>")
    kind, wide = ("array<float>", np.float32) if single else ("array<double>", np.float64)
    raw = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("embedding"), F.col(label).cast("long").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull()
    hashed = raw.withColumn("ok", sound).withColumn("h", F.when(F.col("ok"), F.xxhash64("embedding"))).withColumn("g", F.when(F.col("ok"), F.xxhash64(F.lit(1), "embedding")))
    rows = checkpointed(hashed.select("vec_id", "label", "h", "g", "ok"))
    grouped = hashed.where("ok").groupBy("label", "h", "g").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    # The number of a class, fixed by the checkpoint.
    classes = checkpointed(grouped.withColumn("rep", F.monotonically_increasing_id()))
    alone = F.lit(0).cast("long")
    largest = classes.groupBy("label").count().agg(F.max("count")).head()[0]
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    if not largest:
        return rows.select("vec_id", alone.alias("n_links"), F.col("vec_id").alias("component_id")).select("*", kept)
    bands, bits = band_plan(largest, threshold)

    def codes(batches):
        for batch in batches:
            found = [np.array(v, dtype=wide) for v in batch.column(3).to_pylist()]
            dims = np.array([len(v) for v in found], dtype=np.int64)
            keys, factors = np.zeros((len(found), bands), np.int64), np.zeros(len(found))
            for dim in np.unique(dims).tolist():
                own = np.nonzero(dims == dim)[0]
                keys[own], factors[own] = encode(np.array([found[k] for k in own], dtype=np.float64), bands, bits)
            packed = pa.array([k.tobytes() for k in keys.astype(np.int32)], pa.binary())
            columns = [batch.column(0), pa.array(dims, pa.int64()), batch.column(1), batch.column(2), pa.array(factors), pa.array(list(keys), pa.list_(pa.int64())), packed, pa.array([v.tobytes() for v in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "dim", "rep", "copies", "factor", "codes", "keys", "vector"])

    coded = classes.select("label", "rep", "copies", "embedding").mapInArrow(
        codes, "label long, dim long, rep long, copies long, factor double, codes array<long>, keys binary, vector binary"
    )
    keyed = coded.select("label", "dim", "rep", "copies", "factor", "keys", "vector", F.posexplode("codes").alias("band", "key"))
    bucket = ["label", "dim", "band", "key"]
    sample = keyed.where(F.pmod(F.xxhash64("rep"), F.lit(LAYOUT_SAMPLE)) == 0)
    large = sample.groupBy(*bucket).agg((F.count("*") * LAYOUT_SAMPLE).alias("size")).where(F.col("size") > SLICE)
    large = large.select(*bucket, F.ceil(F.col("size") / SLICE).cast("int").alias("slices"))
    placed = keyed.join(large, bucket, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cells = placed.select(
        *bucket, F.least("own", "other").alias("cell_i"), F.greatest("own", "other").alias("cell_j"), "own", "rep", "copies", "factor", "keys", "vector"
    )
    dealt = cells.repartition(shuffle_width(spark), *_ROW).sortWithinPartitions(*_ROW)
    links = checkpointed(dealt.mapInArrow(lambda batches: bucket_links(batches, threshold), "a long, b long, n long"))
    degrees = links.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("near"))
    parts = checkpointed(connected_components(links.where("b IS NOT NULL").select("a", "b"))).withColumnRenamed("node", "rep")
    heads = classes.select("rep", "least").join(parts, "rep").groupBy("component").agg(F.min("least").alias("head"))
    named = classes.select("label", "h", "g", "rep", "copies", "least").join(degrees, "rep", "left").join(parts.join(heads, "component"), "rep", "left")
    component = F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("head"))
    named = named.select("label", "h", "g", (F.col("copies") - 1 + F.coalesce("near", alone)).alias("n_links"), component.alias("component_id"))
    sound_rows = rows.where("ok").join(named, ["label", "h", "g"]).select("vec_id", "n_links", "component_id")
    others = rows.where("NOT ok").select("vec_id", alone.alias("n_links"), F.col("vec_id").alias("component_id"))
    return sound_rows.unionAll(others).select("*", kept)


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


OP10_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, least(vec_id, coalesce(c, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY a) USING (vec_id)
"""
