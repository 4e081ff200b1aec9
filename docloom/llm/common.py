"""Pieces that several training-data operators share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.store import cut as checkpointed
from docloom.sources.store import shared_base

#: A word is a run of anything but ASCII white space (fixed by the result contracts).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: The six ASCII white-space characters themselves.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder URI below the cluster's shared folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def is_small(df: DataFrame, max_rows: int = 50_000, max_bytes: int = 8_000_000) -> bool:
    """Whether a (checkpointed) table is small enough to broadcast, by count and bytes."""
    weight = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(8) for c, t in df.dtypes), F.lit(0))
    seen = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(weight), F.lit(0)).alias("b")).head()
    return seen["n"] <= max_rows and seen["b"] <= max_bytes


def bounded(df: DataFrame) -> DataFrame:
    """A checkpointed table marked for broadcast if it is small, else for a sort-merge join."""
    return F.broadcast(df) if is_small(df) else df.hint("merge")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that labels may not be learned from: crc32 of the id as text, modulo 4, is 2 (null id: not)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Edges that one partition should hold.
EDGES_A_PARTITION = 50_000
#: Nodes that a task holds before it hands their stars on: more than so many edges have.
HELD_NODES = 4 * EDGES_A_PARTITION


def _stars(edges: DataFrame) -> DataFrame:
    """``(a, b)``: what the edges of a partition link, each node to the smallest node it reaches there."""

    def run(batches):
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def out():
            rows = [(x, r) for x in up if (r := root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], []))], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                up.setdefault(a, a)
                up.setdefault(b, b)
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
                if len(up) > HELD_NODES:
                    yield out()
                    up.clear()
        if up:
            yield out()

    return edges.mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame, max_rounds: int = 60, narrow: bool = False) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component = smallest node reachable.

    Alternates large-star and small-star steps until the edge set stands still. Both are a
    minimum by node (combined map-side) and an equi-join back, so a hub's neighbours are never
    gathered in one task and AQE may split its partition. Each round is checkpointed: a lost
    executor costs at most one round. With ``narrow``, few edges are kept in few partitions, whatever the shuffle's width,
    and each task first joins what it reads: edges of one partition need no round.
    Self-loops and repeated edges are ignored; empty in, empty out.
    """
    typed = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    alone = False
    if narrow:
        parts = 1 + typed.count() // EDGES_A_PARTITION
        alone = parts == 1
        typed = _stars(typed.coalesce(parts) if parts < shuffle_width(edges.sparkSession) else typed)
    turned = typed.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = checkpointed(turned if alone else turned.distinct())
    state = (0,) if alone else _edge_state(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = large.where(F.col("u") != F.col("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Edges never grow in number.
        merged, parts = small.unionAll(down.select("u", F.col("m").alias("v"))).distinct(), 1 + state[0] // EDGES_A_PARTITION
        after = checkpointed(merged.coalesce(parts) if narrow and parts < shuffle_width(edges.sparkSession) else merged)
        then = _edge_state(after)
        now, unchanged, state = after, then == state, then
        if unchanged:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Stars by now.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _edge_state(edges: DataFrame) -> tuple:
    """Size and an order-free checksum of an edge set."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).head()
    return row["n"], row["s"]
