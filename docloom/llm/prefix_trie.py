"""Operator 13: the prefix trie of conversations, by splitter skeleton.

1. A conversation becomes a path, 16 bytes of hash a turn, and word counts a turn; its texts go no further. Paths in
   byte order, then ids, are the trie in pre-order.
2. A bounded sample gives splitters, weighted by turns, that deal the ordered paths over shards; ids are part
   of a splitter, so that copies of one conversation spread too. Splitters only lay out the work.
3. The trie of splitter paths, the skeleton, is broadcast: a node whose paths lie on both sides of a splitter is a
   prefix of it. Sorted shards are read as a stream with a stack of open nodes; all nodes outside the skeleton
   are finished there. Nodes of the skeleton leave partial sums, and the ids that end at them in order.
4. Partial sums are reduced by skeleton node, and once more up the skeleton, whose size the splitters bound.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD, bounded, checkpointed, read, shuffle_width

#: Sampled conversations for each shard, and turns of a path that a splitter keeps; layout only.
SAMPLE_A_SHARD = 20
SPLITTER_TURNS = 32
#: Ids in one piece of the list of conversations that end at a skeleton node.
CHUNK = 50_000
KEY = 16
#: Conversations of one block share the first turns of the block's first.
BLOCK, HEAD = 20, 4

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turns)``: each conversation's turns as ``(key, words)``, by turn (null first), then role, then text.

    Texts are moved only for conversations in which a turn number repeats with different content.
    """
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.select("*", F.substring(digest, 1, 2 * KEY).alias("key"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    turns = lambda *order: F.sort_array(F.collect_list(F.struct(*order, "key", "words"))).alias("turns")
    quick = checkpointed(rows.groupBy("conv_id").agg(turns("turn")))
    pairs = F.arrays_zip(F.slice("turns", F.lit(1), F.size("turns") - 1).alias("a"), F.slice("turns", F.lit(2), F.size("turns") - 1).alias("b"))
    quick = quick.withColumn("tied", F.exists(pairs, lambda p: p["a"]["turn"].eqNullSafe(p["b"]["turn"]) & (p["a"]["key"] != p["b"]["key"])))
    plain = F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns")
    tied = quick.where("tied").select("conv_id")
    if not tied.head(1):
        return quick.select("conv_id", plain)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    slow = rows.join(bounded(checkpointed(tied)), "conv_id", "left_semi").withColumn("place", place).groupBy("conv_id").agg(turns("place"))
    return quick.where("NOT tied").select("conv_id", plain).unionAll(slow.select("conv_id", plain))


def with_block_heads(turns: DataFrame, block: int = BLOCK, head: int = HEAD) -> DataFrame:
    """Each conversation begins with the first ``crc32(id) % head`` turns of its block's first one, instead of its own."""
    own = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).cast("int"))
    heads = turns.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, head - 1).alias("first"))
    joined = own.join(heads, "base", "left")
    first = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return joined.select("conv_id", F.concat(first, rest).alias("turns"))


class Skeleton:
    """Splitters and the trie of their paths; nodes are numbered in pre-order, the root is 0."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path, _ in splitters:
            at = 0
            for k in range(0, len(path), KEY):
                step = (at, path[k : k + KEY])
                if step not in self.child:
                    self.child[step] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(k // KEY + 1)
                at = self.child[step]


def chosen_splitters(sample: list[tuple[bytes, int, int]], shards: int) -> list[tuple[bytes, int]]:
    """``shards - 1`` splitters, at most, of ``(path, conv_id, turns)`` with as many turns between two of them."""
    sample = sorted(sample)
    total, seen, out = sum(1 + n for *_, n in sample), 0, []
    for path, conv, n in sample:
        if seen * shards >= total * (len(out) + 1):
            out.append((path, conv))
        seen += 1 + n
    return out


class Node:
    __slots__ = ("children", "convs", "depth", "ends", "leaves", "least", "saved", "skeleton", "under", "words")

    def __init__(self, depth: int, words: int, skeleton: int | None):
        self.depth, self.words, self.skeleton = depth, words, skeleton
        self.least, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends = hashlib.sha256() if skeleton is None else []
        self.under: list[tuple] = []


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: A finished node, under a skeleton node or (null) a finished one; with ``part`` a partial sum; with ``seq`` a piece of the ends.
_OUT = f"{_NODE}, skeleton long, part boolean, words long, seq long, ends string, shard long"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in _OUT.split(", ")]


def shard_nodes(batches, skeleton: Skeleton):
    """For one shard's ``(conv_id, path, words, shard)`` in order of path and id: its rows of ``_OUT``."""
    made: list[tuple] = []
    root = Node(0, 0, 0)
    stack, before, shard, pieces = [root], b"", None, 0

    def piece(node: Node) -> None:
        nonlocal pieces
        if node.ends:
            made.append((None, None, None, None, None, None, None, None, node.skeleton, False, None, pieces, ",".join(map(str, node.ends)), shard))
            pieces += 1
            node.ends = []

    def close() -> None:
        node = stack.pop()
        parent = stack[-1] if stack else None
        if node.skeleton is None:
            node.leaves = node.leaves or 1
            node.saved += (node.convs - 1) * node.words
            made.extend((r[0], r[1], node.least, *r[3:]) for r in node.under)
            row = (node.least, node.depth, None, node.convs, node.children, node.leaves, node.saved, node.ends.hexdigest(), parent.skeleton, None, None, None, None, None)
            (made if parent.skeleton is not None else parent.under).append(row)
        else:
            piece(node)
            made.append((node.least, node.depth, None, node.convs, node.children, node.leaves, node.saved, None, node.skeleton, True, node.words, None, None, None))
        if parent is not None:
            parent.least = node.least if parent.least is None else min(parent.least, node.least)
            parent.convs += node.convs
            parent.leaves += node.leaves
            parent.saved += node.saved

    def flush():
        rows, made[:] = list(made), []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    for batch in batches:
        columns = [batch.column(k) for k in range(4)]
        for conv, path, words, shard in zip(*(c.to_pylist() for c in columns)):  # noqa: B007
            same, most = 0, min(len(before), len(path))
            while same < most and before[same : same + KEY] == path[same : same + KEY]:
                same += KEY
            while len(stack) > 1 + same // KEY:
                close()
            for k in range(same, len(path), KEY):
                top = stack[-1]
                known = skeleton.child.get((top.skeleton, path[k : k + KEY])) if top.skeleton is not None else None
                top.children += known is None
                stack.append(Node(k // KEY + 1, words[k // KEY], known))
            top, before = stack[-1], path
            top.convs += 1
            top.least = conv if top.least is None else min(top.least, conv)
            if top.skeleton is None:
                # A node's own ends come first in its range, by rising id.
                top.ends.update(f"{',' if top.convs > 1 else ''}{conv}".encode())
            else:
                top.ends.append(conv)
                if len(top.ends) >= CHUNK:
                    piece(top)
        if len(made) >= 10_000:
            yield flush()
    if shard is not None:
        while stack:
            close()
        yield flush()


def hashed_ends(batches):
    """For sorted pieces ``(skeleton, ends)``: the hash of each skeleton node's pieces, joined by commas."""
    at, digest = None, None
    found: list[tuple] = []
    for batch in batches:
        for node, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node != at:
                if digest is not None:
                    found.append((at, digest.hexdigest()))
                at, digest = node, hashlib.sha256(ends.encode())
            else:
                digest.update(f",{ends}".encode())
    if digest is not None:
        found.append((at, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([v for _, v in found])], names=["skeleton", "sha"])


def _skeleton_rows(skeleton: Skeleton, partial: dict, ends: dict) -> list[tuple]:
    """The skeleton's nodes: sums of what lies outside, then what lies in the skeleton, carried up from the last node."""
    size = len(skeleton.parent)
    children = [partial[k]["n_children"] for k in range(size)]
    for k in range(1, size):
        children[skeleton.parent[k]] += 1
    leaves = [int(c == 0) for c in children]
    saved = [(partial[k]["n_convs"] - 1) * (partial[k]["words"] or 0) for k in range(size)]
    for k in range(size - 1, 0, -1):
        leaves[skeleton.parent[k]] += leaves[k]
        saved[skeleton.parent[k]] += saved[k]
    least = [partial[k]["conv_id"] for k in range(size)]
    return [
        (least[k], skeleton.depth[k], least[skeleton.parent[k]] if k else None, partial[k]["n_convs"], children[k], partial[k]["n_leaves"] + leaves[k], partial[k]["saved_tokens"] + saved[k], ends.get(k, EMPTY_SHA256), k)
        for k in range(size)
    ]


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row a node of the trie of ``(conv_id, turns)``, turns being ``(key, words)`` with 32 hex digits as key.

    ``conv_id`` is unique and not null; a conversation without turns is a member of the root alone. Columns:
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (root: null), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``. No conversations: no nodes.
    """
    spark = turns.sparkSession
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("path")
    convs = checkpointed(turns.select("conv_id", path, F.transform("turns", lambda t: t["words"]).alias("words")))
    n, shards = convs.count(), shuffle_width(spark)
    if not n:
        return spark.createDataFrame([], _NODE)
    every = max(1, n // (SAMPLE_A_SHARD * shards))
    sample = convs.where(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0).select(F.expr(f"substring(path, 1, {KEY * SPLITTER_TURNS})").alias("path"), "conv_id", F.size("words").alias("n"))
    skeleton = Skeleton(chosen_splitters([(bytes(r["path"]), r["conv_id"], r["n"]) for r in sample.collect()], shards))
    sent = spark.sparkContext.broadcast(skeleton)

    def placed(batches):
        for batch in batches:
            to = [bisect_right(sent.value.splitters, x) for x in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.int64())], names=["conv_id", "path", "words", "shard"])

    dealt = convs.mapInArrow(placed, "conv_id long, path binary, words array<long>, shard long")
    dealt = dealt.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("path", "conv_id")
    found = checkpointed(dealt.mapInArrow(lambda batches: shard_nodes(batches, sent.value), _OUT))
    sums = found.where("part").groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    pieces = found.where("NOT part").repartition(shards, "skeleton").sortWithinPartitions("skeleton", "shard", "seq").select("skeleton", "ends")
    ends = {r["skeleton"]: r["sha"] for r in pieces.mapInArrow(hashed_ends, "skeleton long, sha string").collect()}
    rows = _skeleton_rows(skeleton, {r["skeleton"]: r for r in sums.collect()}, ends)
    tops = spark.createDataFrame(rows, f"{_NODE}, skeleton long")
    names = [c.split()[0] for c in _NODE.split(", ")]
    parents = F.broadcast(tops.select("skeleton", F.col("conv_id").alias("above")))
    local = found.where("part IS NULL").join(parents, "skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return local.select(*names).unionAll(tops.select(*names))


def conversation_trie(conversations: DataFrame, rebuilt=with_block_heads) -> DataFrame:
    """The prefix trie of ``conversations(conv_id, turn, role, text)``, rebuilt by ``rebuilt`` (None: as they are).

    Null roles and texts are empty. Turns that share a number are ordered by role and text; repeated rows are
    turns of their own. Rows without a conversation's id belong to none and are left out. Two turns are equal if
    role and text are; 128 bits of SHA-256 stand for them. Turns of a conversation are gathered as 32 digits and
    a count each, not as text. Columns besides these four play no part. Empty table: empty result.
    """
    turns = ordered_turns(conversations)
    return prefix_trie(turns if rebuilt is None else rebuilt(turns))


def crc32_sql(number: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a number's decimal digits."""
    step = "list_reduce([xor(a, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    octets = f"list_transform(string_split(({number})::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}, lambda a, b: {step}), 4294967295)"


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(read(spark, sf_dir, "conversations"))


OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (SELECT conv_id, {crc32_sql("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
heads AS (SELECT c.conv_id, t.d, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.d <= h),
r AS (
  SELECT * FROM heads
  UNION ALL
  SELECT t.conv_id, t.d - h + (SELECT count(*) FROM heads WHERE heads.conv_id = t.conv_id), role, text FROM t JOIN c USING (conv_id) WHERE t.d > h
),
whole AS (
  SELECT c.conv_id, coalesce(any_value(turns), []) AS turns
  FROM c LEFT JOIN (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY d) AS turns FROM r GROUP BY conv_id) USING (conv_id) GROUP BY c.conv_id
),
members AS (
  SELECT conv_id, len(turns) AS n, d, min(conv_id) OVER (PARTITION BY d, list_slice(turns, 1, d)) AS node,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(turns[d].text, '[^\\x20\\x09-\\x0D]+')) END AS words
  FROM whole, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)
),
nodes AS (
  SELECT node, d, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends
  FROM members GROUP BY node, d
),
tied AS (SELECT x.*, p.node AS parent FROM nodes x LEFT JOIN members p ON p.conv_id = x.node AND p.d = x.d - 1)
SELECT a.node AS conv_id, a.d AS depth, a.parent AS parent_conv_id, a.n_convs, coalesce(kids, 0) AS n_children,
  n_leaves, saved_tokens, a.ends AS ends_sha256
FROM tied a
LEFT JOIN (SELECT parent AS node, d - 1 AS d, count(*) AS kids FROM tied WHERE d > 0 GROUP BY ALL) USING (node, d)
JOIN (
  SELECT m.node, m.d, sum(CASE WHEN kids IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((x.n_convs - 1) * x.words)::BIGINT AS saved_tokens
  FROM nodes x JOIN members m ON m.conv_id = x.node AND m.d <= x.d
  LEFT JOIN (SELECT parent AS node, d - 1 AS d, count(*) AS kids FROM tied WHERE d > 0 GROUP BY ALL) k ON k.node = x.node AND k.d = x.d
  GROUP BY ALL
) USING (node, d)
"""
