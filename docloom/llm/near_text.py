"""Near copies of whole texts for the pipeline: SimHash pigeonhole blocks, exact five-word shingle similarity.

At similarity 0.8 two 64-bit fingerprints differ in about 10 bits and in 22 at times, which leaves pigeonhole blocks of
two or three bits: too short to be keys. So blocks find the close pairs, and short keys of the sets the rest:

1. Every distinct text is a class with a number of its own; ids play no part in linking.
2. Fingerprints of the shingle sets within ``simhash.MAX_BITS`` bits meet in pigeonhole blocks (operator 5).
3. A set of ``n`` shingles is put in one fixed order by hash, those that a sample shows to be frequent last. Two sets with
   similarity ``SIMILAR`` or more share one of their first ``n - ceil(SIMILAR n) + 1``. If ``r`` of a set's shingles are not
   frequent, at least ``1 - n / 5r`` of those that two such sets have are common to both, so that already their first
   ``log(MISS) / log(n / 5r)`` hold a common one but for a chance under ``MISS``. The fewer of both numbers are a text's keys.
4. In a key's bucket each row is first compared with the bucket's first row, which joins a large group at the cost
   of its rows. Only rows of buckets that hold several groups after that are compared with each other, in cells of bounded size.
5. What is compared are 256-bit fingerprints of the sets and their sizes; pairs within ``WIDE_BITS`` bits are verified on
   the texts themselves. A set with a frequent key has all its rare shingles as keys, so a pair that shares a rare one meets there: in the
   bucket of a frequent key only pairs count whose frequent shingles alone can make the similarity. The shingles that count in a bucket
   are cut into ``CUTS`` parts by hash, of which each row has a checksum: sets that differ in ``d`` shingles differ in ``d`` parts at most.
6. A cell first hands on a spanning forest of its candidates, nearest ones first: no more pairs than rows, which join most
   of what belongs together. Only what these leave in different groups is then compared pair by pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import simhash
from docloom.llm.common import bounded, checkpointed, connected_components, shuffle_width

SHINGLE = 5
#: Least similarity, in fifths: 4 of 5.
FIFTHS = 4
#: Chance that the keys of a pair at the threshold have none in common.
MISS = 1e-9
#: Fingerprints of sets with similarity 0.8 differ in 38.8 bits of 256 on average, deviation 5.7: 67 is five deviations away. Sets
#: of fewer than ``WIDE_FROM`` shingles differ in more bits, and are not judged by them.
WIDE_BITS, WIDE_FROM = 67, 10
PARTS = 4
CUTS = 64
SEED = 42
#: Rows of a bucket that one cell compares, at most twice.
SLICE = 4096
#: One text in so many tells which shingles are frequent; links do not depend on it.
SAMPLE = 16
FREQUENT_FROM, MOST_FREQUENT = 8, 200_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_FP = [f"f{k}" for k in range(PARTS)]
#: Checksums of a set's frequent shingles, of all of them, and of those that count in a bucket.
_LATE, _WHOLE, _SUMS = ([f"{name}{k}" for k in range(CUTS // 8)] for name in ("l", "w", "c"))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of ASCII-lower-cased word shingles; texts without words share one mark."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - shingle])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], dtype=np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= FIFTHS * (len(a) + len(b) - both)


def _set_fingerprint(found: np.ndarray, part: int) -> int:
    """64 bits of the set's SimHash; parts after the first read each hash mixed anew."""
    if part:
        found = found * np.uint64(0x9E3779B97F4A7C15 + 2 * part)
        found = (found ^ found >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        found = found ^ found >> np.uint64(32)
    octets = found.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(found), bitorder="little").view("<i8")[0])


def checksums(found: np.ndarray) -> np.ndarray:
    """A byte for each of ``CUTS`` parts of a set, eight to a number."""
    sums = np.bincount((found & np.uint64(CUTS - 1)).astype(np.int64), weights=(found >> np.uint64(6) & np.uint64(255)).astype(float), minlength=CUTS)
    return (sums.astype(np.int64) & 255).astype(np.uint8).view("<i8")


def keys_of(found: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """The first shingles of a set that stand for it (see the module's third point), how many of the set are rare, and the
    checksums of its frequent shingles and of the whole set."""
    n = rare = len(found)
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)] == found
        rare = n - int(late.sum())
        found = np.concatenate((found[~late], found[late]))
    certain = n - -(-FIFTHS * n // 5) + 1
    few = math.ceil(math.log(MISS) / math.log(n / (5 * rare))) if 5 * rare > n else n
    return found[: min(certain, few)], rare, np.concatenate((checksums(found[rare:]), checksums(found)))


def _frequent_shingles(texts: DataFrame) -> np.ndarray:
    def run(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text).view(np.int64))], names=["s"])

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "s long")
    counted = sample.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    rows = counted.orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r["s"] for r in rows], dtype=np.int64).view(np.uint64))


def _signatures(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``(h, g, id, n, r, f0.., l0.., w0.., keys)``, one row for each row of ``texts(h, g, id, text)``; of ``n`` shingles ``r`` are rare."""
    marks = [*_LATE, *_WHOLE]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py()) for t in part.column(3)]
                chosen = [keys_of(s, frequent) for s in sets]
                keys = pa.array([c[0].view(np.int64) for c in chosen], pa.list_(pa.int64()))
                sizes = [pa.array(map(len, sets), pa.int64()), pa.array([c[1] for c in chosen], pa.int64())]
                sums = [pa.array(column) for column in (np.array([c[2] for c in chosen]).T if chosen else [[]] * len(marks))]
                prints = [pa.array([_set_fingerprint(s, k) for s in sets], pa.int64()) for k in range(PARTS)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *sizes, *prints, *sums, keys], names=["h", "g", "id", "n", "r", *_FP, *marks, "keys"])

    return texts.select("h", "g", "id", "text").mapInArrow(run, f"h long, g long, id long, n long, r long, {', '.join(f'{f} long' for f in (*_FP, *marks))}, keys array<long>")


def _within(a: str, b: str) -> Column:
    """Whether fingerprints and sizes of two structs allow the similarity; column ``often``: they meet by a frequent key."""
    bits = sum((F.bit_count(F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}"))) for f in _FP), F.lit(0))
    sizes = (5 * F.col(f"{a}.n") >= FIFTHS * F.col(f"{b}.n")) & (5 * F.col(f"{b}.n") >= FIFTHS * F.col(f"{a}.n"))
    common = F.least(F.col(f"{a}.n") - F.col(f"{a}.r"), F.col(f"{b}.n") - F.col(f"{b}.r"))
    enough = 5 * common >= FIFTHS * (F.col(f"{a}.n") + F.col(f"{b}.n") - common)
    return ((bits <= WIDE_BITS) | (F.col(f"{a}.n") < WIDE_FROM)) & sizes & (~F.col("often") | enough)


def _block_pairs(classes: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of classes that span what operator 5 links, by pigeonhole blocks of the first fingerprint."""
    prints = checkpointed(classes.groupBy("f0").agg(F.min("cid").alias("first")))
    equal = classes.join(prints, "f0").where("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b"))
    edges = simhash.simhash_edges(prints.select(F.col("f0").alias("fp")), prints.count()).distinct()
    left, right = (prints.select(F.col("f0").alias(side), F.col("first").alias(f"first_{side}")) for side in ("a", "b"))
    close = edges.join(left, "a").join(right, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return equal.unionAll(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


_ROW = ["key", "cell_i", "cell_j", *_FP, "cid", "n", "comp", "f", "often", *_SUMS]


def _runs(batches):
    """Runs of equal ``(key, cell_i, cell_j)`` of at least two rows, whole, as arrays of rows."""
    held = np.zeros((0, len(_ROW)), np.int64)
    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]) if batch.num_rows else held[:0]
        block = np.concatenate((held, rows))
        cuts = np.nonzero(np.any(block[1:, :3] != block[:-1, :3], axis=1))[0] + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(block)]))
        for a, b in zip(starts[:-1].tolist(), ends[:-1].tolist()):
            if b - a > 1:
                yield block[a:b]
        held = block[starts[-1] :]
    if len(held) > 1:
        yield held


def _candidates(run: np.ndarray, forest: bool):
    """Candidate pairs of one run, of different groups; with ``forest`` only such as join two that no pair before has joined, nearest ones first."""
    fps, cids, n, comp = np.ascontiguousarray(run[:, 3 : 3 + PARTS]).view(np.uint64), run[:, 3 + PARTS], run[:, 4 + PARTS], run[:, 5 + PARTS]
    frequent, often = run[:, 6 + PARTS], bool(run[0, 7 + PARTS])
    sums = np.ascontiguousarray(run[:, 8 + PARTS :]).view(np.uint8)
    counted = frequent if often else n
    groups, comp, sizes = np.unique(comp, return_inverse=True, return_counts=True)
    if len(groups) < 2:
        return
    # Rows of the largest group meet the others from the others' side.
    at = np.nonzero(comp != np.argmax(sizes))[0]
    for k in range(0, len(at), 256):
        rows = at[k : k + 256]
        bits = sum(np.bitwise_count(fps[rows, None, p] ^ fps[None, :, p]).astype(np.int64) for p in range(PARTS))
        near = ((bits <= WIDE_BITS) | (n[rows, None] < WIDE_FROM)) & (comp[rows, None] != comp[None, :])
        near &= (5 * n[rows, None] >= FIFTHS * n[None, :]) & (5 * n[None, :] >= FIFTHS * n[rows, None])
        if often:
            common = np.minimum(frequent[rows, None], frequent[None, :])
            near &= 5 * common >= FIFTHS * (n[rows, None] + n[None, :] - common)
        i, j = np.nonzero(near)
        for at_pair in range(0, len(i), 50_000):
            x, y = rows[i[at_pair : at_pair + 50_000]], j[at_pair : at_pair + 50_000]
            differ = counted[x] + counted[y] - 2 * -(-4 * (n[x] + n[y]) // 9)
            near[i[at_pair : at_pair + 50_000], y] = (sums[x] != sums[y]).sum(1) <= differ
        i, j = np.nonzero(near)
        if forest and len(i):
            # Of a row's candidates in a group, the nearest alone.
            order = np.lexsort((bits[i, j], comp[j], i))
            i, j = i[order], j[order]
            new = np.concatenate(([True], (i[1:] != i[:-1]) | (comp[j[1:]] != comp[j[:-1]])))
            i, j = i[new], j[new]
            order = np.argsort(bits[i, j], kind="stable")
            i, j, kept = i[order], j[order], np.zeros(len(i), bool)
            for place, (p, q) in enumerate(zip(rows[i].tolist(), j.tolist())):
                if comp[p] != comp[q]:
                    comp[comp == comp[p]] = comp[q]
                    kept[place] = True
            i, j = i[kept], j[kept]
        a, b = cids[rows[i]], cids[j]
        yield np.minimum(a, b), np.maximum(a, b)


def _bucket_pairs(buckets: DataFrame, groups: DataFrame | None, forest: bool) -> DataFrame:
    """``(a, b)``: candidates (with ``forest`` a spanning forest of a cell's) of different groups in ``buckets(key, often, cid, n, r, f0.., c0..)`` that hold several groups."""
    now = buckets.withColumn("comp", F.col("cid"))
    if groups is not None:
        now = buckets.join(groups.withColumnsRenamed({"node": "cid", "component": "comp"}), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    size = F.ceil(F.count("*") / SLICE).alias("slices")
    open_ = checkpointed(now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), size).where("lo <> hi").select("key", "slices"))
    rows = now.join(bounded(open_), "key")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("slices"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    # A cell (i, i) holds slice i alone; (i, j) holds both, so every pair meets somewhere.
    cells = rows.select("key", F.least("own", "other").alias("cell_i"), F.greatest("own", "other").alias("cell_j"), *_FP, "cid", "n", "comp", (F.col("n") - F.col("r")).alias("f"), F.col("often").cast("long").alias("often"), *_SUMS)

    def run(batches):
        for one in _runs(batches):
            for a, b in _candidates(one, forest):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    order = ["key", "cell_i", "cell_j"]
    dealt = cells.select(*_ROW).repartition(shuffle_width(buckets.sparkSession), *order).sortWithinPartitions(*order, "cid")
    return dealt.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose texts have the similarity; a text that stands in neighbouring rows is read once."""

    def run(batches):
        known: dict = {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for row, sides in enumerate(zip(a, b)):
                found = []
                for side, cid in enumerate(sides):
                    if cid not in known:
                        if len(known) > 500:
                            known.clear()
                        known[cid] = shingle_set(batch.column(2 + side)[row].as_py())
                    found.append(known[cid])
                good.append(similar(*found))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    left, right = (texts.select(F.col("cid").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def similar_groups(classes: DataFrame, texts: DataFrame) -> DataFrame | None:
    """``(node, component)`` for the classes that have a near copy; none: None.

    ``classes(cid, h, g, n, r, f0.., l0.., w0.., keys)`` has a row for each distinct text, ``texts(h, g, text)`` at least one.
    """
    keyed = classes.select(F.posexplode("keys").alias("place", "key"), "cid", "r").select("key", "cid", (F.col("place") >= F.col("r")).alias("often"))
    shared = keyed.groupBy("key").agg(F.min("cid").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("key", "first")
    # Most keys are one text's alone; only what shares one takes its fingerprints along.
    hits = checkpointed(keyed.join(shared, "key"))
    marks = classes.select("cid", "n", "r", *_FP, *_LATE, *_WHOLE)
    counting = [F.when(F.col("often"), F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in zip(_LATE, _WHOLE, _SUMS)]
    buckets = checkpointed(hits.join(marks, "cid").select("key", "often", "cid", "n", "r", *_FP, *counting))
    side = lambda name: F.struct("n", "r", *_FP).alias(name)
    others = hits.where("cid <> first").join(classes.select("cid", side("own")), "cid").join(classes.select(F.col("cid").alias("first"), side("other")), "first")
    with_first = others.where(_within("own", "other")).select(F.col("first").alias("a"), F.col("cid").alias("b"))
    pairs = checkpointed(with_first.unionAll(_block_pairs(classes)).distinct())
    needed = buckets.select("cid").unionAll(pairs.select("a")).unionAll(pairs.select("b")).distinct()
    needed = checkpointed(classes.select("cid", "h", "g").join(needed, "cid", "left_semi"))
    found = texts.join(bounded(needed), ["h", "g"]).select("cid", "text")
    texts = checkpointed(found.groupBy("cid").agg(F.first("text").alias("text")))
    edges = groups = None
    if not pairs.isEmpty():
        edges = checkpointed(_verified(pairs, texts))
        groups = checkpointed(connected_components(edges, narrow=True))
    # What is in one group by now need not be compared; what was compared in vain is left out.
    for forest in (True, False):
        rest = checkpointed(_bucket_pairs(buckets, groups, forest).distinct().join(pairs, ["a", "b"], "left_anti"))
        if rest.isEmpty():
            continue
        more = checkpointed(_verified(rest, texts))
        edges, pairs = more if edges is None else edges.unionAll(more), pairs.unionAll(rest)
        groups = checkpointed(connected_components(edges, narrow=True))
    return groups


def one_of_each_similar_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of texts that five-word shingles link at similarity 0.8: that of the smallest id.

    Rows without an id are linked like others, and stay only where no row of the group has an id. Rows that
    share an id but not their text are texts of their own. Null, empty and blank texts are one group.
    Repeated rows: one stays. Empty table: empty result. Other columns stay as they are.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumns({"__h": F.xxhash64(whole), "__g": F.xxhash64(F.lit(1), whole)})
    texts = keyed.select(F.col("__h").alias("h"), F.col("__g").alias("g"), F.col(doc_id).cast("long").alias("id"), whole.alias("text"))
    signed = checkpointed(_signatures(texts, _frequent_shingles(texts)))
    named = signed.groupBy("h", "g", "id").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "r", *_FP, *_LATE, *_WHOLE, "keys")])
    head = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "copies")).alias("head")
    classes = named.groupBy("h", "g").agg(head, *[F.first(c).alias(c) for c in ("n", "r", *_FP, *_LATE, *_WHOLE, "keys")])
    # The number of a class, fixed by the checkpoint.
    classes = checkpointed(classes.withColumn("cid", F.monotonically_increasing_id()))
    groups = similar_groups(classes, texts)
    heads = classes.select("cid", "h", "g", "head")
    if groups is not None:
        heads = heads.join(groups, F.col("cid") == F.col("node"), "left").withColumn("group", F.coalesce("component", "cid"))
        first = F.min(F.struct("head.nameless", "head.id", "cid", "h", "g", "head.copies")).alias("first")
        heads = heads.groupBy("group").agg(first).select("first.h", "first.g", "first.id", "first.copies")
    else:
        heads = heads.select("h", "g", "head.id", "head.copies")
    heads = checkpointed(heads.withColumnsRenamed({"h": "__head_h", "g": "__head_g", "id": "__head_id"}))
    own = (F.col("__h") == F.col("__head_h")) & (F.col("__g") == F.col("__head_g")) & F.col(doc_id).cast("long").eqNullSafe(F.col("__head_id"))
    single = keyed.join(heads.where("copies = 1"), own, "left_semi")
    repeated = checkpointed(heads.where("copies > 1"))
    if not repeated.isEmpty():
        single = single.unionAll(keyed.join(bounded(repeated), own, "left_semi").dropDuplicates(["__h", "__g"]))
    return single.select(*docs.columns)
