"""Operator 9: best-fit packing by minimum bin slack.

Texts are tokenized in one narrow pass that yields a row a piece (id, length, checksum, no ids). Which
pieces share a sequence depends on lengths alone, and there are at most ``CAPACITY`` of those: the plan
is made from the histogram of lengths, whose size does not grow with the corpus. Each step
takes the longest length left, finds by a bitset subset-sum program the combination of lengths left
that fills the rest best, and repeats that bin as often as the histogram allows. The plan is
a list of slot ranges by length and rank; pieces are ranked by length (in shards, whose
prefix sums make the ranks global, as one length may hold a third of all pieces) and look their slot up.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import checkpointed, read

CAPACITY = 4096
END_ID = 1
_END = END_ID.to_bytes(4, "little")
#: Pieces of one length in a rank shard, about.
SHARD_ROWS = 2_000
#: Words that a tokenizing task remembers before it starts afresh.
CACHE_WORDS = 400_000

# What the tokenizer's own pre-tokenizer splits a lower-cased word into.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Words of these characters need no Unicode normalization and are lower-cased letter by letter.
_PLAIN = re.compile(r"[\x21-\x7EÀ-įĲ-ſ]+\Z")
#: Octets as the characters that stand for them in the vocabulary: printable ones for themselves, the others from 256 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OCTET_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_BYTE_CHARS = {c: "".join(_OCTET_CHARS[b] for b in chr(c).encode()) for c in range(0xC0, 0x180)}
#: White space to Python, but not to the tokenizer.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")


class _Pieces(dict):
    """Ids of the pieces met so far; a piece is looked up in the merges the first time it is met."""

    def __init__(self, tokenizer):
        self.merged = tokenizer.model.tokenize
        self.octets = [k.to_bytes(4, "little") for k in range(tokenizer.get_vocab_size())]

    def __missing__(self, piece: str) -> bytes:
        octets = self.octets
        ids = self[piece] = b"".join([octets[t.id] for t in self.merged(piece if piece.isascii() else piece.translate(_BYTE_CHARS))])
        return ids


class _Words(dict):
    """Ids of the words met so far; those outside plain Latin, or with a special token, are the tokenizer's own affair."""

    def __init__(self, tokenizer):
        self.tokenizer, self.pieces = tokenizer, _Pieces(tokenizer)

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if "<|" in word or not ((word.isascii() and word.isprintable()) or _PLAIN.match(word)):
            ids = self.plain(word)
        else:
            low, pieces = word.lower(), self.pieces
            if low.isalpha():
                ids = pieces[low]
            elif low[:-1].isalpha() and not low[-1].isalnum():
                ids = pieces[low[:-1]] + pieces[low[-1]]
            else:
                ids = b"".join([pieces[p] for p in _PIECE.findall(low)])
        self[word] = ids
        return ids


class WordTokenizer:
    """Ids as the tokenizer gives them for whole texts, with the work done once for each new word.

    The tokenizer cuts at white space and then by ``_PIECE`` and merges inside the cuts only, so a text's
    ids are those of its words. Texts with odd separators go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Ids as little-endian 32-bit bytes: a text's ids are then one join.
        self.words = _Words(Tokenizer.from_file(path))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit bytes."""
        words = self.words
        if len(words) > CACHE_WORDS:
            words.clear()
        if len(words.pieces) > CACHE_WORDS:
            words.pieces.clear()
        if _SEPARATORS.search(text):
            return words.plain(text)
        return b"".join(map(words.__getitem__, text.split()))


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """The process's tokenizer: a worker that runs several tasks keeps the words it has learnt."""
    return WordTokenizer(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: texts as ids, an end id, cut where over ``capacity``.

    ``path``: the tokenizer's file on the executors; None: the installed public vocabulary.
    """

    def run(batches):
        tokenizer = word_tokenizer(path or tokenizer_path())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for name, text in zip(part.column(0).to_pylist(), part.column(1)):
                    data = tokenizer.encode(text.as_py() or "") + _END
                    for k, start in enumerate(range(0, len(data) // 4, capacity)):
                        own = data[start * 4 : (start + capacity) * 4]
                        rows.append((name, k, start, len(own) // 4, zlib.crc32(own)))
                columns = list(zip(*rows)) or [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def fullest_combination(available: list[tuple[int, int]], room: int) -> list[int]:
    """Lengths out of ``available`` ((length, count), longest first) whose sum comes nearest to ``room`` from below.

    Bit s of a number says whether sum s can be reached; every item taken in shifts the number.
    """
    mask, reach, taken = (1 << (room + 1)) - 1, 1, []
    for length, count in available:
        if length > room:
            continue
        for _ in range(min(count, room // length)):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            taken.append((length, reach))
            reach = grown
        if reach >> room:
            break
    left, chosen = reach.bit_length() - 1, []
    for length, before in reversed(taken):
        if not before >> left & 1:
            chosen.append(length)
            left -= length
    return chosen


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """``[(repeats, lengths of one bin, longest first)]``: minimum bin slack over a histogram of lengths."""
    left, plan = dict(sorted(((k, n) for k, n in counts.items() if n > 0), reverse=True)), []
    while left:
        longest = next(iter(left))
        rest = [(k, n - (k == longest)) for k, n in left.items() if n > (k == longest)]
        bin_ = [longest, *sorted(fullest_combination(rest, capacity - longest), reverse=True)]
        use = {k: bin_.count(k) for k in set(bin_)}
        repeats = min(left[k] // m for k, m in use.items())
        plan.append((repeats, bin_))
        for k, m in use.items():
            left[k] -= repeats * m
            if not left[k]:
                del left[k]
    return plan


def slot_ranges(plan: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, pieces a sequence, first offset), in order of rank."""
    ranges: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for repeats, bin_ in plan:
        offset = 0
        for length in dict.fromkeys(bin_):
            m = bin_.count(length)
            ranges.setdefault(length, []).append((used.get(length, 0), sequence, m, offset))
            used[length] = used.get(length, 0) + repeats * m
            offset += m * length
        sequence += repeats
    return {k: np.array(v, dtype=np.int64) for k, v in ranges.items()}


def pack(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is the end id alone. Repeated rows and null ids are packed like others; pieces of
    equal length are interchangeable, ties among them go by id and piece. Empty table: empty result.
    """
    spark = docs.sparkSession
    pieces = checkpointed(token_pieces(docs, path, doc_id, text, capacity))
    # Dealt by the place in the checkpoint: rows that repeat, by thousands even, are spread like others.
    pieces = pieces.withColumn("__place", F.monotonically_increasing_id())
    shard = F.pmod("__place", F.col("__shards"))
    # At most `capacity` rows: lengths.
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    shards = spark.createDataFrame([(k, -(-n // SHARD_ROWS)) for k, n in counts.items()], "__length long, __shards long")
    placed = pieces.join(F.broadcast(shards), F.col("length") == F.col("__length")).withColumn("__shard", shard)
    ranked = placed.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__shard").orderBy("doc_id", "piece", "ids_crc32")))
    sums = placed.where("__shards > 1").groupBy("length", "__shard").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__shard")) - F.col("__n")
    sums = sums.select(F.col("length").alias("__of"), F.col("__shard").alias("__os"), before.alias("__before"))
    ranked = ranked.join(sums, (F.col("length") == F.col("__of")) & (F.col("__shard") == F.col("__os")), "left")
    ranked = ranked.withColumn("__rank", F.col("__rank") - 1 + F.coalesce("__before", F.lit(0)))
    slots = spark.sparkContext.broadcast(slot_ranges(pack_histogram(counts, capacity)))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        table = slots.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length).tolist():
                own = length == k
                rows = table[k]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                nth = rank[own] - row[:, 0]
                sequence[own] = row[:, 1] + nth // row[:, 2]
                offset[own] = row[:, 3] + nth % row[:, 2] * k
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, F.col("__rank").cast("long").alias("rank")).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
