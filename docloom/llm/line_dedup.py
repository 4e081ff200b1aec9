"""Operator 1: corpus-wide line deduplication by range-partitioned hashes.

Every line becomes ``(hash, document, position)``. The hash range is cut into as many equal
slices as there are shuffle partitions (hashes are uniform, so no sampling pass is needed), rows
go to their slice and are sorted there by hash, document and position. A window streams each
slice: it marks a key's first occurrence in each document and counts those marks. Lines whose
hash a layout sample shows to be frequent are spread over all slices by document; their
per-slice counts (at most ``slices`` rows a key) are added up afterwards, so no slice holds a
whole hot key. Only dropped positions travel back, folded into one run-length bitmap a document.

Everything runs in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import SPACE_CHARS, checkpointed, read, shuffle_width

MIN_DOCS = 10
#: One document in so many is looked at to find frequent lines; only the layout depends on it.
LAYOUT_SAMPLE = 0.02

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    """Lines at ``\\n``; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line's key: ASCII white space stripped at both ends, A-Z lower-cased."""
    return F.btrim(line, F.lit(SPACE_CHARS))


def _row_key(doc_id: str, text: str) -> list[Column]:
    return [F.col(doc_id).alias("__doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__text")]


def _occurrences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    # Two steps: beside a generator the key would be made again, and the text carried along, for every line.
    split = docs.select(*_row_key(doc_id, text), F.split(lowered, "\n", -1).alias("__lines"))
    lines = split.select("__doc", "__text", F.posexplode("__lines").alias("__pos", "__line"))
    keyed = lines.select("__doc", "__text", "__pos", line_key(F.col("__line")).alias("__key"))
    return keyed.where(F.col("__key") != "").select(
        F.xxhash64("__key").alias("__h"), F.xxhash64(F.lit(1), "__key").alias("__g"), "__doc", "__text", "__pos"
    )


def line_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """``(__doc, __text, drop_runs)``: for each document that loses lines, a run-length bitmap.

    ``drop_runs`` alternates lengths of kept and dropped runs from line 0 on; what follows the
    last run is kept. A key found in at least ``min_docs`` documents is dropped everywhere
    (``keep_first``: everywhere but at its first occurrence by document and position).
    """
    spark = docs.sparkSession
    slices = shuffle_width(spark)
    occurrences = _occurrences(docs, doc_id, text)
    # Frequent keys of a document sample: those that may fill a quarter of a slice, so at most 4 * slices of them.
    seen = checkpointed(_occurrences(docs.sample(False, LAYOUT_SAMPLE, 7), doc_id, text).groupBy("__h").agg(F.count("*").alias("__n")))
    total = seen.agg(F.sum("__n")).head()[0] or 0
    hot = seen.where(F.col("__n") > max(4.0, total / (4 * slices))).select("__h", F.lit(True).alias("__hot"))
    placed = occurrences.join(F.broadcast(hot), "__h", "left")
    span = 2**63 // slices + 1
    by_hash = F.least(F.floor(F.shiftrightunsigned("__h", 1) / F.lit(span)), F.lit(slices - 1)).cast("int")
    spread = F.pmod(F.xxhash64("__doc"), F.lit(slices)).cast("int")
    placed = placed.withColumn("__slice", F.when(F.col("__hot"), spread).otherwise(by_hash)).repartitionById(slices, F.col("__slice"))
    key = Window.partitionBy("__slice", "__h", "__g")
    streamed = key.orderBy("__doc", "__text", "__pos")
    marked = placed.withColumn(
        "__first", F.when(F.row_number().over(streamed) == 1, 1).otherwise(F.when(F.lag("__doc").over(streamed).eqNullSafe(F.col("__doc")), 0).otherwise(1))
    ).withColumn("__docs", F.sum("__first").over(streamed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # What the windows let through is little: lines of frequent keys. It is kept, as it is read three times.
    through = marked.where(F.col("__hot") | (F.col("__docs") >= min_docs))
    if keep_first:
        through = through.withColumn("__ord", F.row_number().over(streamed))
    through = checkpointed(through)
    cold = through.where(F.col("__hot").isNull())
    if keep_first:
        cold = cold.where("__ord > 1")
    # Hot keys: add the slices' counts (one row a key and slice) and hand the few sums back.
    heated = through.where(F.col("__hot"))
    sums = (
        heated.groupBy("__h", "__g", "__slice")
        .agg(F.max("__docs").alias("__docs"), F.min(F.struct("__doc", "__text", "__pos")).alias("__head"))
        .groupBy("__h", "__g")
        .agg(F.sum("__docs").alias("__sum"), F.min("__head").alias("__head"))
        .where(F.col("__sum") >= min_docs)
    )
    warm = heated.join(F.broadcast(sums), ["__h", "__g"])
    if keep_first:
        warm = warm.where(~F.struct("__doc", "__text", "__pos").eqNullSafe(F.col("__head")))
    dropped = cold.select("__doc", "__text", "__pos").unionAll(warm.select("__doc", "__text", "__pos"))
    gathered = dropped.groupBy("__doc", "__text").agg(F.array_sort(F.collect_set("__pos")).alias("__at"))
    return gathered.select("__doc", "__text", run_lengths(F.col("__at")).alias("drop_runs"))


def run_lengths(positions: Column) -> Column:
    """Sorted positions as alternating lengths of absent and present runs.

    Lambdas see their own element only, next to its neighbours, so the work is linear in the positions.
    """
    none = F.array(F.lit(-2))
    beside = F.arrays_zip(positions.alias("at"), F.concat(none, positions).alias("before"), F.concat(F.slice(positions, 2, F.size(positions)), none).alias("after"))
    starts = F.transform(F.filter(beside, lambda z: z["at"] != z["before"] + 1), lambda z: z["at"])
    ends = F.transform(F.filter(beside, lambda z: z["after"] != z["at"] + 1), lambda z: z["at"])
    runs = F.arrays_zip(starts.alias("first"), ends.alias("last"), F.concat(F.array(F.lit(-1)), ends).alias("gap"))
    lengths = F.transform(runs, lambda z: F.array(z["first"] - z["gap"] - 1, z["last"] - z["first"] + 1))
    return F.flatten(F.filter(lengths, lambda pair: F.get(pair, F.lit(0)).isNotNull()))


def _kept_lines(lines: Column, runs: Column) -> Column:
    """The kept lines of ``lines``: the runs are spread out to a mark a line, and marked lines go."""
    marks = F.flatten(F.transform(runs, lambda n, k: F.array_repeat(k % 2 == 1, n)))
    marked = F.arrays_zip(lines.alias("line"), marks.alias("drop"))
    return F.transform(F.filter(marked, lambda z: ~F.coalesce(z["drop"], F.lit(False))), lambda z: z["line"])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped``, ``drop_runs`` and ``kept_text`` added.

    Nulls: a null text counts as one empty line, which is never dropped (its key has no
    characters); all rows with a null id count as one document. Repeated rows get equal results
    and count once. Ties (equal keys in a document) are all dropped. Empty table: empty result.
    Columns of ``docs`` with these names are replaced; every other column stays as it is.
    """
    added = ["n_lines", "n_dropped", "drop_runs", "kept_text"]
    base = docs.drop(*[c for c in added if c in docs.columns])
    verdicts = line_verdicts(base, doc_id, text, min_docs, keep_first).withColumnsRenamed({"__doc": "__vd", "__text": "__vt"})
    keyed = base.withColumn("__text", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = keyed.join(verdicts, F.col(doc_id).eqNullSafe(F.col("__vd")) & (F.col("__text") == F.col("__vt")), "left")
    lines = split_lines(F.col(text))
    n_dropped = F.coalesce(
        F.aggregate(F.transform("drop_runs", lambda x, i: F.when(i % 2 == 1, x).otherwise(0)), F.lit(0), lambda a, x: a + x), F.lit(0)
    )
    kept = F.when(F.col("drop_runs").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(
        F.array_join(_kept_lines(lines, F.col("drop_runs")), "\n")
    )
    return joined.select(
        *[F.col(c) for c in base.columns],
        (F.length(F.coalesce(F.col(text), F.lit(""))) - F.length(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        n_dropped.cast("long").alias("n_dropped"),
        "drop_runs",
        kept.alias("kept_text"),
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.line, u.pos,
         lower_ascii AS k
  FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents) u,
    LATERAL (SELECT translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii)
),
frequent AS (
  SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (f.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (k)
GROUP BY doc_id
"""


def apply_line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every text replaced by its kept lines (``n_chars``, if there, follows)."""
    found = dedup_lines(docs, doc_id, text).withColumn(text, F.col("kept_text"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length(text).cast("long"))
    return found.select(*docs.columns)
