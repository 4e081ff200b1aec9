"""Operator 6: mixing sources to target weights by Sainte-Lague apportionment.

All sizes (words) are summed by source. Weights give each source a target, capped at ``MAX_REPEATS``
times its size, the excess shared again by weight: with sources ordered by cap per weight, the
capped ones are a prefix, which running sums find in one pass over the one-row-a-source table.
The corpus is then worth ``total / BLOCK`` equal blocks. Quotas in blocks go to the highest
quotients ``target / (2k + 1)``; the same rule splits a source's quota over its shards, so that a
hot source is many shards and no window holds more than a bounded share of it. In a shard the
documents, in seeded order, form a stream of tokens cut into blocks; the quota is whole passes
over the stream and, for the rest, a seeded cyclic run of blocks. A document takes the passes times
its size and the part of it that lies in the run, so never over ``MAX_REPEATS`` times its size.

Everything runs in DataFrame functions; only the driver-free tables of sources and shards (one row
each) meet in single tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import SPACES, WORD, bounded, checkpointed, read

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Words in a block; small against any source, so that quotas come near targets.
BLOCK = 16
#: Words in a shard, about.
SHARD_WORDS = 2_000_000
SEED = "mix-1"


def _seats(items: DataFrame, group: list[str], want: str, seats: str) -> DataFrame:
    """Exact Sainte-Lague seats: of ``items`` in each ``group``, ``seats`` in all, by ``want``.

    With divisor D = sum / seats, rounding at D * seats / (seats - n) never gives too many seats and at
    D * seats / (seats + n) never too few (n items), so only the quotients between the two, about
    three an item at most, are ranked. Ties go to the lower ``__tie``.
    """
    by = Window.partitionBy(*group)
    sized = items.withColumn("__sum", F.sum(want).over(by)).withColumn("__n", F.sum(F.when(F.col(want) > 0, 1).otherwise(0)).over(by))
    share = F.when(F.col("__sum") > 0, F.col(want) / F.col("__sum")).otherwise(0.0)
    low = F.greatest(F.floor(share * (F.col(seats) - F.col("__n")) + 0.5), F.lit(0))
    high = F.when(F.col(want) > 0, F.ceil(share * (F.col(seats) + F.col("__n")) + 0.5)).otherwise(0)
    ranged = sized.withColumn("__low", low.cast("long")).withColumn("__high", F.greatest(high, low).cast("long"))
    ranged = ranged.withColumn("__open", F.col(seats) - F.sum("__low").over(by))
    ladder = ranged.where("__high > __low").select(
        *group, "__tie", "__open", F.col(want).alias("__want"), F.explode(F.sequence("__low", F.col("__high") - 1)).alias("__k")
    )
    order = Window.partitionBy(*group).orderBy(F.desc(F.col("__want") / (2 * F.col("__k") + 1)), "__tie", "__k")
    won = ladder.withColumn("__rank", F.row_number().over(order)).where("__rank <= __open").groupBy(*group, "__tie").agg(F.count("*").alias("__won"))
    return ranged.join(won, [*group, "__tie"], "left").select(
        *items.columns, (F.col("__low") + F.coalesce("__won", F.lit(0))).alias("quota")
    )


def source_targets(sized: DataFrame) -> DataFrame:
    """``(source, source_size, target, __tie)``: one row a source of ``sized(source, size)``.

    The windows here order one row a source, not documents.
    """
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    everything = Window.partitionBy(F.lit(0))
    named = sums.withColumn("__tie", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    named = named.withColumn("weight", F.element_at(weights, ((F.col("__tie") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
    # Capped sources come first in order of cap per weight: prefix sums give the level for each prefix.
    fill = everything.orderBy(F.col("source_size") / F.col("weight"), "__tie")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    total, all_weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    level = named.withColumn(
        "__level",
        (total - MAX_REPEATS * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double")
        / (all_weight - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"),
    )
    level = level.withColumn("__free", MAX_REPEATS * F.col("source_size") > F.col("__level") * F.col("weight"))
    flat = F.min(F.when(F.col("__free"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("__tie").alias("t"), F.col("__level").alias("level")))).over(everything)
    target = F.least(
        F.coalesce(flat["level"] * F.col("weight"), (MAX_REPEATS * F.col("source_size")).cast("double")),
        (MAX_REPEATS * F.col("source_size")).cast("double"),
    )
    return level.select("source", "source_size", target.alias("target"), "__tie")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, start)``: one row for each row of ``docs``.

    ``taken`` words: whole passes, then ``taken % size`` words from word ``start`` on, cyclically.
    Null source: a source of its own, sorted last. Null text: size 0, takes nothing. Repeated rows
    and null ids are rows like any other; a corpus without words has targets 0. Empty: empty.
    """
    sized = checkpointed(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
        )
    )
    targets = checkpointed(source_targets(sized))
    blocks = F.floor((F.sum("source_size").over(Window.partitionBy(F.lit(0))) + BLOCK / 2) / BLOCK)
    quotas = _seats(targets.withColumn("__all", F.lit(0)).withColumn("__blocks", blocks.cast("long")), ["__all"], "target", "__blocks")
    quotas = checkpointed(
        quotas.select("source", "source_size", "target", F.col("quota").alias("__quota"), F.ceil((F.col("source_size") + 1) / SHARD_WORDS).cast("long").alias("__shards"))
    )
    seeded = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("size").cast("string")).cast("binary"))
    placed = sized.join(bounded(quotas.withColumnRenamed("source", "__source")), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    placed = placed.withColumn("__seed", seeded).withColumn("__shard", F.conv(F.substring("__seed", 1, 12), 16, 10).cast("long") % F.col("__shards"))
    shard_sums = placed.groupBy("source", "__shard").agg(
        F.sum("size").cast("long").alias("__words"), F.first("__quota").alias("__quota"), F.first("target").alias("__target")
    )
    shares = _seats(
        shard_sums.withColumn("__tie", F.col("__shard")).withColumn("__group", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))),
        ["__group"],
        "__words",
        "__quota",
    )
    need = F.least(F.col("quota") * BLOCK, MAX_REPEATS * F.col("__words"))
    shares = checkpointed(shares.select(F.col("source").alias("__source"), F.col("__shard").alias("__of"), "__words", need.cast("long").alias("__need")))
    joined = placed.join(bounded(shares), F.col("source").eqNullSafe(F.col("__source")) & (F.col("__shard") == F.col("__of")))
    stream = Window.partitionBy("source", "__shard").orderBy("__seed", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("size").over(stream)
    words, size = F.col("__words"), F.col("size")
    placed = joined.withColumn("__at", end - size)
    passes = F.when(words > 0, F.floor(F.col("__need") / F.greatest(words, F.lit(1)))).otherwise(0).cast("long")
    placed = placed.withColumn("__passes", passes).withColumn("__rest", F.col("__need") - F.col("__passes") * words)
    # The run of blocks starts at a seeded block of the shard's stream and may wrap round once.
    pick = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + "/"), F.coalesce("source", F.lit("null")), F.lit("/"), F.col("__shard").cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")
    placed = placed.withColumn("__from", pick % F.greatest(F.floor(words / BLOCK), F.lit(1)).cast("long") * BLOCK)

    def overlap(a, b):
        return F.greatest(F.least(F.col("__at") + size, b) - F.greatest(F.col("__at"), a), F.lit(0))

    stop = F.col("__from") + F.col("__rest")
    tail, head = overlap(F.col("__from"), F.least(stop, words)), overlap(F.lit(0), stop - words)
    start = F.when(tail > 0, F.greatest(F.col("__from") - F.col("__at"), F.lit(0))).otherwise(0)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("__passes") * size + tail + head).cast("long").alias("taken"), start.cast("long").alias("start")
    )


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` as the mix takes them: each row once for each whole pass, then once with the part taken.

    The part is ``taken % size`` words from word ``start`` on, wrapping round, joined by single spaces;
    rows that the mix takes nothing of go. ``n_chars``, if there, is that of the text given.
    Rows that agree in id, source and size take what their group takes, shared by rank.
    """
    names = docs.columns
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), lambda w: w != "")
    rank = Window.partitionBy("__i", "__s", "__n").orderBy(F.desc("__taken"), "__start")
    plan = mix(docs, text, source, doc_id).select(
        F.col("doc_id").alias("__i"), F.col("source").alias("__s"), F.col("size").alias("__n"), F.col("taken").alias("__taken"), F.col("start").alias("__start")
    )
    plan = plan.withColumn("__r", F.row_number().over(rank)).where("__taken > 0")
    sized = docs.withColumn("__size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))
    twins = Window.partitionBy(doc_id, source, "__size").orderBy(F.xxhash64(text))
    sized = sized.withColumn("__rank", F.row_number().over(twins))
    same = F.col(doc_id).eqNullSafe(F.col("__i")) & F.col(source).eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__n")) & (F.col("__rank") == F.col("__r"))
    taken = sized.join(plan, same)
    whole, rest = F.floor(F.col("__taken") / F.col("__n")), (F.col("__taken") % F.col("__n")).cast("int")
    turns = F.concat(F.array_repeat(F.lit(False), whole.cast("int")), F.when(rest > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    taken = taken.withColumn("__part", F.explode(turns))
    first = (F.col("__start") + 1).cast("int")
    part = F.concat(F.slice(words, first, rest), F.slice(words, F.lit(1), F.greatest(first - 1 + rest - F.size(words), F.lit(0))))
    given = F.when(F.col("__part"), F.array_join(part, " ")).otherwise(F.col(text))
    out = taken.withColumn(text, given)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length(F.coalesce(F.col(text), F.lit(""))).cast("long"))
    return out.select(*names)


OP6_SQL = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS tie FROM s GROUP BY source),
w AS (SELECT *, [5, 2, 1][(tie - 1) % 3 + 1]::BIGINT AS weight FROM src),
fill AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
flat AS (SELECT level FROM fill WHERE 3 * source_size > level * weight ORDER BY source_size::DOUBLE / weight, tie LIMIT 1),
t AS (
  SELECT source, source_size, tie, ceil((source_size + 1) / 2000000.0)::BIGINT AS shards,
         least(coalesce((SELECT level FROM flat) * weight, 3.0::DOUBLE * source_size), 3.0::DOUBLE * source_size) AS target
  FROM fill
),
n AS (SELECT floor((sum(source_size) + 8) / 16.0::DOUBLE)::BIGINT AS blocks, sum(target) AS want, count(*) AS many FROM t),
ladder AS (SELECT tie, target, unnest(range(0, ceil(target / want * (blocks + many))::BIGINT + 2)) AS k FROM t, n WHERE target > 0),
quota AS (
  SELECT tie, count(*) AS q FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, tie, k) AS r FROM ladder), n
  WHERE r <= blocks GROUP BY tie
),
seeded AS (
  SELECT s.*, t.tie, t.source_size, t.target, t.shards, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size::VARCHAR) AS seed
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
),
p AS (SELECT *, ('0x' || substr(seed, 1, 12))::BIGINT % shards AS shard FROM seeded),
sh AS (SELECT tie, shard, sum(size)::BIGINT AS words FROM p GROUP BY tie, shard),
shq AS (SELECT sh.*, coalesce(q, 0) AS q, sum(words) OVER (PARTITION BY tie) AS all_words, count(*) OVER (PARTITION BY tie) AS many FROM sh LEFT JOIN quota USING (tie)),
ladder2 AS (SELECT tie, shard, words, q, unnest(range(0, ceil(words::DOUBLE / all_words * (q + many))::BIGINT + 2)) AS k FROM shq WHERE words > 0),
quota2 AS (
  SELECT tie, shard, count(*) AS q FROM (SELECT *, row_number() OVER (PARTITION BY tie ORDER BY words::DOUBLE / (2 * k + 1) DESC, shard, k) AS r FROM ladder2)
  WHERE r <= q GROUP BY tie, shard
),
need AS (
  SELECT sh.*, least(coalesce(q, 0) * 16, 3 * words) AS need FROM sh LEFT JOIN quota2 USING (tie, shard)
),
placed AS (
  SELECT p.*, words, CASE WHEN words > 0 THEN need // words ELSE 0 END AS passes, need,
         sum(size) OVER (PARTITION BY tie, shard ORDER BY seed, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS at_word,
         ('0x' || substr(md5('mix-1/' || coalesce(source, 'null') || '/' || shard::VARCHAR), 1, 12))::BIGINT % greatest(words // 16, 1) * 16 AS start_word
  FROM p JOIN need USING (tie, shard)
),
run AS (SELECT *, start_word + need - passes * words AS stop_word FROM placed)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(least(at_word + size, least(stop_word, words)) - greatest(at_word, start_word), 0)
        + greatest(least(at_word + size, stop_word - words) - at_word, 0))::BIGINT AS taken
FROM run
"""
