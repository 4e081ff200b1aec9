"""Operator 11: approximate nearest neighbours by cross-polytope hashing.

1. Equal vectors are one class that keeps its ``k + 1`` smallest ids: no answer can name another of its rows.
2. A class's vector is lifted to the unit sphere (inverse stereographic projection at the table's geometric mean
   norm; unit vectors stay as they are), so that small Euclidean distances are small angles. Three rounds of
   seeded signs and a fast Hadamard transform turn it pseudo-randomly; the nearest signed axis is its hash.
   ``K`` hashes key a table, and there are ``TABLES`` tables; every class is in each of them.
3. A query probes the ``P`` cheapest buckets of each table: cost is the sum of squared gaps to the best axis.
   ``K`` follows the number of classes. ``P`` is fitted: at most ``SAMPLE`` query classes are compared with
   all classes, and ``P`` is the least number of probes that finds ``RECALL`` of their neighbours. Every
   class is indexed whatever the sample; if all axes must be probed, the search is the exact one.
4. Rows and probes meet in buckets, sorted runs read as a stream: all distances in a bucket are screened by
   inner products with an error bound, and what may be among the nearest is recomputed from the original
   vectors in double precision. Large buckets are dealt over cells of a slice of rows and a slice of queries.
5. Each cell returns the nearest of each query; a rank over cells picks the answer. Queries whose buckets
   held too few classes are compared with every class, in the same cells.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import checkpointed, read, shuffle_width

NEIGHBOURS = 10
TABLES = 6
#: Share of the sample's neighbours that the probes must find.
RECALL = 0.95
#: Query classes, at most, that the number of probes is fitted on.
SAMPLE = 200
#: Classes that a bucket should hold; it sets the number of hashes a table.
BUCKET = 100
#: Probes a table, at most, where a table has several hashes; fewer hashes are taken beyond.
MAX_PROBES = 2048
#: Rows and queries, at most, that one cell should hold; layout only.
SLICE = 4096
LAYOUT_SAMPLE = 16
SEED = 11


def padded(dim: int) -> int:
    """The Hadamard transform's size: a power of two that holds the vector and its lifted coordinate."""
    return 1 << dim.bit_length()


def lifted(vectors: np.ndarray, scale: float) -> np.ndarray:
    """Rows on the unit sphere of one more dimension; rows of norm ``scale`` keep their direction."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    shape = vectors / largest
    norm = np.sqrt((shape * shape).sum(axis=1, keepdims=True))
    with np.errstate(over="ignore", divide="ignore"):
        r = np.clip(norm * (largest / scale), 1e-150, 1e150)
    up, down = r, 1 / r
    return np.hstack((shape / norm * (2 / (up + down)), (up - down) / (up + down)))


@lru_cache(maxsize=64)
def _signs(size: int, table: int, number: int) -> np.ndarray:
    return np.random.default_rng([SEED, size, table, number]).choice([-1.0, 1.0], (3, size))


def turned(unit: np.ndarray, table: int, number: int) -> np.ndarray:
    """Rows after the pseudo-rotation of one hash, padded with zeros to a power of two."""
    n, dim = unit.shape
    size = padded(dim - 1)
    rows = np.zeros((n, size))
    rows[:, :dim] = unit
    for flips in _signs(size, table, number):
        rows = rows * flips
        half = 1
        while half < size:
            pairs = rows.reshape(n, size // (2 * half), 2, half)
            rows = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, size)
            half *= 2
        rows = rows / math.sqrt(size)
    return rows


def axis_costs(unit: np.ndarray, table: int, number: int) -> np.ndarray:
    """Squared gap of every signed axis to the nearest one, which costs 0 (n x 2 * size)."""
    rows = turned(unit, table, number)
    both = np.hstack((rows, -rows))
    return (both.max(axis=1, keepdims=True) - both) ** 2


def bucket_keys(unit: np.ndarray, hashes: int, table: int) -> np.ndarray:
    """The bucket of each row in a table."""
    base = 2 * padded(unit.shape[1] - 1)
    return sum(axis_costs(unit, table, k).argmin(axis=1).astype(np.int64) * base**k for k in range(hashes))


def probes(unit: np.ndarray, hashes: int, table: int, count: int) -> np.ndarray:
    """The ``count`` cheapest buckets of each row in a table, cheapest first (all, if fewer)."""
    base = 2 * padded(unit.shape[1] - 1)
    keys, costs = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
    for k in range(hashes):
        own = axis_costs(unit, table, k)
        axes = np.argsort(own, axis=1, kind="stable")[:, :count]
        more = costs[:, :, None] + np.take_along_axis(own, axes, 1)[:, None, :]
        made = keys[:, :, None] + axes[:, None, :] * base**k
        more, made = more.reshape(len(unit), -1), made.reshape(len(unit), -1)
        best = np.argsort(more, axis=1, kind="stable")[:, :count]
        costs, keys = np.take_along_axis(more, best, 1), np.take_along_axis(made, best, 1)
    return keys


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of rows in double precision; differences that over- or underflow when squared are scaled first."""
    with np.errstate(over="ignore", under="ignore"):
        diff = a - b
        found = np.sqrt((diff * diff).sum(axis=1))
    odd = ~np.isfinite(found) | ((found < 1e-140) & diff.any(axis=1))
    if odd.any():
        halves = a[odd] / 2 - b[odd] / 2
        largest = np.abs(halves).max(axis=1, keepdims=True)
        largest[largest == 0] = 1.0
        with np.errstate(over="ignore"):
            found[odd] = 2 * largest[:, 0] * np.sqrt(((halves / largest) ** 2).sum(axis=1))
    return found


def may_be_nearest(queries: np.ndarray, rows: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) among which are the ``count`` nearest rows of each query, ties included."""
    with np.errstate(over="ignore", invalid="ignore"):
        nq, nr = (queries * queries).sum(axis=1)[:, None], (rows * rows).sum(axis=1)[None, :]
        square = nq + nr - 2 * (queries @ rows.T)
        error = 4 * (queries.shape[1] + 8) * np.finfo(float).eps * (nq + nr.max())
        if rows.shape[0] <= count:
            cut = np.full((len(queries), 1), np.inf)
        else:
            cut = np.partition(np.where(np.isfinite(square), square, np.inf), count - 1, axis=1)[:, count - 1 : count]
        return np.nonzero(~np.isfinite(square) | ~np.isfinite(error) | (square <= cut + 2 * error))


class Best:
    """The nearest classes so far of a block of queries, by distance, then smallest id, then class."""

    def __init__(self, numbers: np.ndarray, vectors: np.ndarray, count: int):
        self.numbers, self.vectors, self.count = numbers, vectors, count
        self.of, self.far = np.zeros(0, np.int64), np.zeros(0)
        self.reps, self.ids = np.zeros(0, np.int64), np.zeros(0, dtype=object)

    def see(self, reps: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(self.vectors), 512):
            block = self.vectors[at : at + 512]
            i, j = may_be_nearest(block, vectors, self.count)
            self._merge(i + at, np.concatenate([distances(block[i[s : s + 65_536]], vectors[j[s : s + 65_536]]) for s in range(0, len(i), 65_536)] or [np.zeros(0)]), reps[j], ids[j])

    def _merge(self, of, far, reps, ids) -> None:
        of, far = np.concatenate((self.of, of)), np.concatenate((self.far, far))
        reps, ids = np.concatenate((self.reps, reps)), np.concatenate((self.ids, ids))
        least = [x[0] for x in ids.tolist()]
        missing = np.array([x is None for x in least], bool)
        order = np.lexsort((reps, np.array([x or 0 for x in least], np.int64), missing, far, of))
        of = of[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        keep = order[place < self.count]
        self.of, self.far, self.reps, self.ids = of[place < self.count], far[keep], reps[keep], ids[keep]

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array(self.numbers[self.of], pa.int64()), pa.array(self.reps, pa.int64()), pa.array(self.ids.tolist(), pa.list_(pa.int64())), pa.array(self.far, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["query", "rep", "ids", "score"])


_FOUND = "query long, rep long, ids array<long>, score double"


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def objects(column: pa.Array) -> np.ndarray:
    found = np.empty(len(column), dtype=object)
    found[:] = column.to_pylist()
    return found


def against_all(batches, blocks: dict[int, tuple[np.ndarray, np.ndarray]], count: int):
    """For rows ``(dim, rep, ids, v)`` of all classes: the nearest of each of a few queries in this partition."""
    best = {dim: Best(numbers, vectors, count) for dim, (numbers, vectors) in blocks.items()}
    for batch in batches:
        dims = batch.column(0).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            if dim in best:
                part = batch.filter(pa.array(dims == dim))
                best[dim].see(part.column(1).to_numpy(), objects(part.column(2)), matrix(part.column(3)))
    for found in best.values():
        yield found.batch()


_CELL = ["dim", "t", "bucket", "row_slice", "query_slice"]


def search_cells(batches, count: int):
    """For sorted rows of runs (``_CELL``), a run's queries first: the nearest rows of each query in its run."""
    at, numbers, vectors, best = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(_CELL) + 1)], axis=1)
        starts = [0, *(np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1).tolist(), len(key)]
        for a, b in zip(starts, starts[1:]):
            cell, is_row = tuple(key[a, :-1].tolist()), key[a, -1]
            if cell != at:
                if best is not None:
                    yield best.batch()
                at, numbers, vectors, best = cell, [], [], None
            part = batch.slice(a, b - a)
            reps, own = part.column(len(_CELL) + 1).to_numpy(), matrix(part.column(len(_CELL) + 3))
            if not is_row:
                numbers.append(reps)
                vectors.append(own)
            elif numbers:
                if best is None:
                    best = Best(np.concatenate(numbers), np.concatenate(vectors), count)
                best.see(reps, objects(part.column(len(_CELL) + 2)), own)
    if best is not None:
        yield best.batch()


def _cells(rows: DataFrame, queries: DataFrame, count: int) -> DataFrame:
    """The nearest rows of each query within buckets ``(dim, t, bucket)``; both sides have ``rep, ids, v`` besides."""
    spark, bucket = rows.sparkSession, ["dim", "t", "bucket"]

    def sizes(side: DataFrame, name: str) -> DataFrame:
        seen = side.where(F.pmod(F.xxhash64("rep", "t"), F.lit(LAYOUT_SAMPLE)) == 0)
        large = seen.groupBy(*bucket).agg((F.count("*") * LAYOUT_SAMPLE).alias("size")).where(F.col("size") > SLICE)
        return large.select(*bucket, F.ceil(F.col("size") / SLICE).cast("int").alias(name))

    def placed(side: DataFrame, own: str, other: str, is_row: int) -> DataFrame:
        """Each row to one slice of its own side and every slice of the other."""
        for name, part in (("row", rows), ("query", queries)):
            side = side.join(sizes(part, f"{name}_slices"), bucket, "left").withColumn(f"{name}_slices", F.coalesce(f"{name}_slices", F.lit(1)))
        side = side.withColumn(f"{own}_slice", F.pmod(F.xxhash64("rep", F.lit(1)), F.col(f"{own}_slices")).cast("int"))
        side = side.withColumn(f"{other}_slice", F.explode(F.sequence(F.lit(0), F.col(f"{other}_slices") - 1)))
        return side.select(*_CELL, F.lit(is_row).alias("is_row"), "rep", "ids", "v")

    cells = placed(rows, "row", "query", 1).unionAll(placed(queries, "query", "row", 0))
    dealt = cells.repartition(shuffle_width(spark), *_CELL).sortWithinPartitions(*_CELL, "is_row")
    return dealt.mapInArrow(lambda batches: search_cells(batches, count), _FOUND)


def _nearest(found: DataFrame, count: int) -> DataFrame:
    """The ``count`` nearest classes of each query, however often each was found."""
    order = [F.col("score"), F.col("ids")[0].asc_nulls_last(), F.col("rep")]
    return found.withColumn("place", F.dense_rank().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= count).distinct()


def _fitted(classes: DataFrame, sample: list, n: int, scale: float, count: int, tables: int, recall: float) -> tuple[int, int]:
    """``(hashes a table, probes a table)``, from the exact neighbours of the sample's query classes."""
    blocks: dict = {}
    for row in sample:
        blocks.setdefault(row["dim"], []).append(row)
    blocks = {dim: (np.array([r["rep"] for r in part]), np.array([r["v"] for r in part], dtype=np.float64)) for dim, part in blocks.items()}
    sent = classes.sparkSession.sparkContext.broadcast(blocks)
    exact = _nearest(classes.select("dim", "rep", "ids", "v").mapInArrow(lambda batches: against_all(batches, sent.value, count), _FOUND), count)
    near = exact.where("query <> rep").join(F.broadcast(classes.sparkSession.createDataFrame([(r["rep"], r["dim"]) for r in sample], "query long, dim long")), "query")
    near = near.select("query", "rep", "dim").join(classes.select("rep", "v"), "rep").collect()
    most = max(blocks)
    hashes = min(max(int(math.log(max(n / BUCKET, 1)) / math.log(2 * padded(most))), 1), 4)
    while True:
        limit = 2 * padded(most) if hashes == 1 else MAX_PROBES
        places = []
        for dim, (numbers, vectors) in blocks.items():
            own = [r for r in near if r["dim"] == dim]
            if not own:
                continue
            at = np.searchsorted(numbers[(order := np.argsort(numbers))], [r["query"] for r in own])
            unit, theirs = lifted(vectors[order], scale), lifted(np.array([r["v"] for r in own], dtype=np.float64), scale)
            least = np.full(len(own), limit, np.int64)
            for t in range(tables):
                probed, key = probes(unit, hashes, t, limit), bucket_keys(theirs, hashes, t)
                for s in range(0, len(own), 256):
                    hit = probed[at[s : s + 256]] == key[s : s + 256, None]
                    least[s : s + 256] = np.minimum(least[s : s + 256], np.where(hit.any(axis=1), hit.argmax(axis=1), limit))
            places.append(least)
        found = np.sort(np.concatenate(places or [np.zeros(1, np.int64)]))
        need = int(found[max(math.ceil(recall * len(found)) - 1, 0)]) + 1
        if hashes == 1 or need <= limit:
            return hashes, min(need, limit)
        hashes -= 1


def nearest_neighbours(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEIGHBOURS, tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each row where ``queries`` holds.

    Nearness is Euclidean distance of the original vectors in double precision, ties to the smaller id; fewer
    than ``k`` rows come only where the table holds no more. A query's own row is no candidate of it. Vectors
    that are null, empty or zero, or hold null or non-finite components, take no part. Vectors of
    different length are not compared. Repeated rows are candidates of their own; rows that share an id each
    ask and answer for themselves. Rows without an id are no queries, but candidates (last among ties). Other
    columns play no part, whatever their names. Empty table: empty result.
    """
    spark, count = vectors.sparkSession, k + 1
    single = vectors.schema[embedding].dataType.simpleString() in ("array<float>", "array<tinyint>", "array<smallint>")
    raw = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = raw.where(finite & F.exists("v", lambda x: x != 0)).select("*", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))
    same = Window.partitionBy("h", "g").orderBy(F.col("vec_id").asc_nulls_last())
    heads = sound.select("h", "g", "vec_id", "v").withColumn("place", F.row_number().over(same)).where(F.col("place") <= count)
    grouped = heads.groupBy("h", "g").agg(F.first("v").alias("v"), F.sort_array(F.collect_list(F.struct("place", "vec_id"))).alias("ids"))
    asking = sound.where((F.col("asks")) & F.col("vec_id").isNotNull()).select("vec_id", "h", "g")
    grouped = grouped.join(asking.select("h", "g", F.lit(True).alias("asks")).distinct(), ["h", "g"], "left")
    numbered = grouped.select("h", "g", F.monotonically_increasing_id().alias("rep"), F.size("v").cast("long").alias("dim"), F.col("ids.vec_id").alias("ids"), "v", F.coalesce("asks", F.lit(False)).alias("asks"))
    classes = checkpointed(numbered)
    asked = classes.where("asks")
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    log_norm = F.log(largest) + F.log(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / largest) * (x / largest))) / 2
    seen = classes.agg(F.count("*").alias("n"), F.avg(log_norm).alias("norm"), F.max("dim").alias("dim")).head()
    schema = "query_id long, rank int, vec_id long, score double"
    if not seen["n"]:
        return spark.createDataFrame([], schema)
    # Three digits, so that the order of summation does not show.
    scale = float(f"{math.exp(seen['norm']):.3g}")
    sample = asked.orderBy("h", "g").limit(max(8, min(SAMPLE, 64_000_000 // (8 * seen["dim"] * count)))).select("rep", "dim", "v").collect()
    if not sample:
        return spark.createDataFrame([], schema)
    hashes, width = _fitted(classes, sample, seen["n"], scale, count, tables, recall)

    def keys(batches, wide: int):
        for batch in batches:
            dims = batch.column(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for s in range(0, part.num_rows, 1024):
                    block = part.slice(s, 1024)
                    unit = lifted(matrix(block.column(3)), scale)
                    made = [probes(unit, hashes, t, wide) if wide else bucket_keys(unit, hashes, t)[:, None] for t in range(tables)]
                    each = pa.array([[x.tolist() for x in row] for row in zip(*made)], pa.list_(pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays([*block.columns, each], names=["dim", "rep", "ids", "v", "keys"])

    def keyed(side: DataFrame, wide: int) -> DataFrame:
        kind = side.schema["v"].dataType.simpleString()
        made = side.select("dim", "rep", "ids", "v").mapInArrow(lambda batches: keys(batches, wide), f"dim long, rep long, ids array<long>, v {kind}, keys array<array<long>>")
        return made.select("dim", "rep", "ids", "v", F.posexplode("keys").alias("t", "own")).select("dim", "t", F.explode("own").alias("bucket"), "rep", "ids", "v")

    found = checkpointed(_nearest(_cells(keyed(classes, 0), keyed(asked, width), count), count))
    # Queries that met fewer classes than there are to meet see every class, in slices.
    of_dim = classes.groupBy("dim").agg(F.count("*").alias("there"))
    met = found.groupBy("query").agg(F.count("*").alias("met"))
    short = asked.join(met, F.col("rep") == F.col("query"), "left").join(F.broadcast(of_dim) if of_dim.count() < 10_000 else of_dim, "dim")
    short = checkpointed(short.where(F.coalesce("met", F.lit(0)) < F.least(F.lit(count), "there")).select("dim", "rep", "ids", "v"))
    if short.head(1):
        one = [F.lit(-1).alias("t"), F.lit(0).cast("long").alias("bucket")]
        rest = _cells(classes.join(short.select("dim").distinct(), "dim", "left_semi").select("dim", *one, "rep", "ids", "v"), short.select("dim", *one, "rep", "ids", "v"), count)
        found = _nearest(found.drop("place").unionAll(rest), count)
    entry = F.struct(F.col("score").alias("score"), F.isnull("id").alias("last"), F.col("id").alias("id"))
    named = found.select("query", "score", F.explode("ids").alias("id")).groupBy("query").agg(F.sort_array(F.collect_list(entry)).alias("near"))
    rows = asking.join(asked.select("h", "g", "rep"), ["h", "g"]).join(named, F.col("rep") == F.col("query"))
    own = F.array_position("near", F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("last"), F.col("vec_id").alias("id")))
    rows = rows.select(F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda x, i: i + 1 != own), 1, k).alias("near"))
    rows = rows.select("query_id", F.posexplode("near").alias("place", "x"))
    return rows.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def op11_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score")
