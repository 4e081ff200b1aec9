"""Operator 5: SimHash near-duplicates by pigeonhole blocks.

1. Fingerprints: one narrow pass over whole texts, Arrow batches in, 8 bytes a document out.
2. Equal fingerprints are one class; only classes go on. Links are between fingerprints: ids play no part in them.
3. A fingerprint's 64 bits are split into ``b`` blocks; two within ``MAX_BITS`` bits agree on at least
   ``b - MAX_BITS`` whole blocks, so each class is keyed once for every choice of that many blocks. ``b``
   grows with the number of classes, which keeps chance meetings in a bucket few; the result is
   exact for any ``b``.
4. Buckets are sorted runs in hash partitions, read as a stream of Arrow batches. Every pair of a
   bucket is compared, but only a spanning forest of its links leaves it. A sample finds large buckets;
   these are dealt over cells, one for each pair of slices of at most ``SLICE`` classes, so no task holds a
   whole bucket.
5. Components of the forest edges give every class, and so every document, the smallest id of its group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpointed, connected_components, read, shuffle_width

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Classes that one cell compares with each other, at most twice.
SLICE = 4096
#: One class in so many is looked at to find large buckets; only the layout depends on it.
LAYOUT_SAMPLE = 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of ASCII-lower-cased word shingles, repeats included; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: len(words) - shingle])).tolist()
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, max_bits: int = MAX_BITS) -> list[int]:
    """A 64-bit mask for every choice of ``blocks - max_bits`` of ``blocks`` near-equal blocks."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(pick) for pick in combinations(single, blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class _Forest:
    """Union-find over positions of one run."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest_edges(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``fps``: every pair is compared, row by block of rows."""
    forest, edges, n = _Forest(len(fps)), [], len(fps)
    for at in range(0, n, 256):
        near = _popcount(fps[at : at + 256, None] ^ fps[None, at:]) <= max_bits
        i, j = np.nonzero(near)
        keep = i < j
        for a, b in zip((i[keep] + at).tolist(), (j[keep] + at).tolist()):
            if forest.join(a, b):
                edges.append((a, b))
    return edges


def bucket_edges(batches, max_bits: int):
    """Forest edges of each run of equal ``(mask_no, bucket, cell)`` in a sorted stream of ``(.., fp)``."""
    held: list[np.ndarray] = []

    def runs(block: np.ndarray):
        if not len(block):
            return
        new = np.any(block[1:, :4] != block[:-1, :4], axis=1)
        starts = np.concatenate(([0], np.nonzero(new)[0] + 1))
        sizes = np.diff(np.concatenate((starts, [len(block)])))
        out_a, out_b = [], []
        names = np.ascontiguousarray(block[:, 4])
        fps = names.view(np.uint64)
        small = sizes <= 32
        group = np.repeat(np.arange(len(sizes)), sizes)
        for lag in range(1, int(sizes[small].max(initial=1))):
            near = (group[lag:] == group[:-lag]) & small[group[lag:]]
            near &= _popcount(fps[lag:] ^ fps[:-lag]) <= max_bits
            at = np.nonzero(near)[0]
            out_a.append(names[at + lag])
            out_b.append(names[at])
        for s, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
            edges = _forest_edges(fps[s : s + n], max_bits)
            if edges:
                a, b = np.array(edges).T
                out_a.append(names[s + a])
                out_b.append(names[s + b])
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    for batch in batches:
        rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]) if batch.num_rows else np.zeros((0, 5), np.int64)
        held.append(rows)
        block = np.concatenate(held)
        if not len(block):
            continue
        # The last run may go on in the next batch: cells are bounded, so it can be held.
        same = np.all(block[:, :4] == block[-1, :4], axis=1)
        last = len(block) - int(np.argmin(same[::-1])) if not same.all() else 0
        held = [block[last:]]
        yield from runs(block[:last])
    if held:
        yield from runs(np.concatenate(held))


def simhash_edges(classes: DataFrame, n: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``(a, b)`` between fingerprints that span every group of linked ones.

    ``classes(fp)`` has one row for each of its ``n`` distinct fingerprints.
    """
    blocks = max_bits + (2 if n < 4_000_000 else 3 if n < 400_000_000 else 4)
    masks = [_signed(m) for m in block_masks(blocks, max_bits)]
    choice = F.array(*[F.struct(F.lit(k).alias("mask_no"), F.lit(m).cast("long").alias("mask")) for k, m in enumerate(masks)])

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.select("fp", F.inline(choice)).select("mask_no", F.expr("fp & mask").alias("bucket"), "fp")

    sample = classes.where(F.pmod(F.xxhash64("fp"), F.lit(LAYOUT_SAMPLE)) == 0)
    large = (
        keyed(sample)
        .groupBy("mask_no", "bucket")
        .agg((F.count("*") * LAYOUT_SAMPLE).alias("size"))
        .where(F.col("size") > SLICE)
        .select("mask_no", "bucket", F.ceil(F.col("size") / SLICE).cast("int").alias("slices"))
    )
    rows = keyed(classes).join(large, ["mask_no", "bucket"], "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("slices", F.lit(1))).cast("int")
    others = F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(others))
    cells = rows.select("mask_no", "bucket", F.least("own", "other").alias("cell_i"), F.greatest("own", "other").alias("cell_j"), "fp")
    order = ["mask_no", "bucket", "cell_i", "cell_j"]
    # A cell (i, i) holds slice i alone; (i, j) holds both, so every pair meets somewhere.
    dealt = cells.repartition(shuffle_width(classes.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(lambda batches: bucket_edges(batches, max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row for each row of ``docs``.

    Documents whose fingerprints differ in ``max_bits`` bits or fewer are linked; ``component_id`` is the
    smallest id reachable. Null, empty and blank texts have fingerprint 0 and are linked like any other.
    Repeated rows get equal results; rows that share an id but not their text are linked each by its own text. Rows
    without an id link, and join others, like the rest but never name a component: one of such rows only is null.
    Empty table: empty result.
    """
    marked = checkpointed(fingerprints(docs, doc_id, text, shingle))
    classes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    n = classes.count()
    if n == 0:
        return marked.select("doc_id", "fp", F.col("doc_id").alias("component_id"))
    parts = checkpointed(connected_components(simhash_edges(classes.select("fp"), n, max_bits)))
    heads = classes.join(parts, F.col("fp") == F.col("node")).groupBy("component").agg(F.min("least").alias("head"))
    linked = parts.join(heads, "component").select("node", "head", F.lit(True).alias("linked"))
    named = classes.join(linked, F.col("fp") == F.col("node"), "left")
    component = F.when(F.col("linked"), F.col("head")).otherwise(F.col("least"))
    return marked.join(named.select("fp", component.alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
