"""Operator 8: quality rules with host-level verdicts.

Statistics and two base rules are read off every whole text in one narrow pass. A document
also fails a host rule when its symbols, repeated lines or repeated words pass a lower bar (``RULES``). Hosts
(the ``source`` column stands for the domain) are summed up by partial aggregation; each rule's
failure rate by host is shrunk towards the corpus by a beta prior whose mean and strength are
fitted to the hosts by moments; a host whose shrunk rate passes ``HOST_RATE`` on any rule is rejected, and
the verdict is joined back to its documents.

Everything runs in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACE_CHARS, SPACES, bounded, checkpointed, read

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: A host is rejected when the shrunk share of its documents that fail a rule is above this.
HOST_RATE = 0.5


def _length_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _windows(words: Column, width: int = 3) -> Column:
    """A hash for each window of ``width`` words, in order."""
    n = F.size(words)
    at = F.when(n >= width, F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(width)]))


def _repeat_positions(hashes: Column) -> Column:
    """Positions from 1, in order, of the windows that occur twice or more; only texts that have any are sorted."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))
    beside = F.arrays_zip(placed.alias("x"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), placed).alias("before"), F.slice(placed, 2, F.size(placed)).alias("after"))
    twin = F.filter(beside, lambda z: z["x"].isNotNull() & (z["x"]["h"].eqNullSafe(z["before"]["h"]) | z["x"]["h"].eqNullSafe(z["after"]["h"])))
    repeats = F.sort_array(F.transform(twin, lambda z: z["x"]["i"]))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), repeats).otherwise(F.array().cast("array<int>"))


def _covered(positions: Column, width: int = 3) -> Column:
    """How many words the windows at ``positions`` cover: the length of a union of intervals."""
    start = F.struct(F.lit(-width).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, at: Column) -> Column:
        return F.struct(at.cast("long").alias("last"), (state["n"] + F.least(at - state["last"], F.lit(width))).cast("long").alias("n"))

    return F.aggregate(positions, start, step, lambda s: s["n"])


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed``.

    ``n_lines`` counts lines with a word.
    Null and empty texts have no words and fail the base rules. Columns of these names are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]
    base = docs.drop(*[c for c in names if c in docs.columns])
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, SPACES), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    stage = base.withColumns({"__words": words, "__lines": lines})
    stage = stage.withColumn("__windows", _windows(F.col("__words")))
    stage = stage.withColumn("__at", _repeat_positions(F.col("__windows")))
    stage = stage.select(
        *[c for c in base.columns if c != text],
        F.size("__words").cast("long").alias("n_words"),
        _length_without(whole, SPACE_CHARS).cast("long").alias("word_chars"),
        (F.length(whole) - _length_without(whole, SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("__at")).alias("n_repeat_words"),
    )
    return stage.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


#: The rules whose failures are counted by host, over the columns of :func:`text_statistics`.
RULES = {
    "base": "base_failed",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "repeats": "100 * n_repeat_words > 20 * n_words",
}


def host_verdicts(stats: DataFrame, host: str) -> DataFrame:
    """``(host, host_docs, host_rate, host_rejected)``, one row a host (null is a host of its own).

    Beta prior by moments over hosts, weighted by documents: mean m = corpus rate; with the variance v
    of host rates, strength s = m(1-m)/v - 1, kept within [2, 10000]. Shrunk rate = (fails + m s) / (docs + s).
    """
    sums = stats.groupBy(F.col(host).alias("__host")).agg(
        F.count("*").alias("host_docs"), *[F.sum(F.expr(rule).cast("long")).alias(f"__{name}") for name, rule in RULES.items()]
    )
    sums = checkpointed(sums)
    moments = [F.sum("host_docs").cast("double").alias("docs")]
    for name in RULES:
        k = F.col(f"__{name}")
        moments += [F.sum(k).cast("double").alias(f"k_{name}"), F.sum(k * k / F.col("host_docs")).alias(f"kk_{name}")]
    prior = sums.agg(*moments).head()
    rates = []
    for name in RULES:
        docs = prior["docs"] or 1.0
        mean = (prior[f"k_{name}"] or 0.0) / docs
        spread = max((prior[f"kk_{name}"] or 0.0) / docs - mean * mean, 0.0)
        strength = min(max(mean * (1 - mean) / spread - 1, 2.0), 10_000.0) if spread > 0 else 10_000.0
        rates.append((F.col(f"__{name}") + mean * strength) / (F.col("host_docs") + strength))
    rate = F.greatest(*rates) if len(rates) > 1 else rates[0]
    return sums.select("__host", "host_docs", rate.alias("host_rate"), (rate > HOST_RATE).alias("host_rejected"))


def apply_quality_rules(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` without its text, with its statistics, ``host_rate`` and ``kept``.

    Kept: the base rules pass and the host is not rejected. Repeated rows get equal results; an
    empty table gives an empty result. Columns of ``docs`` named like the result's are replaced.
    """
    base = docs.drop(*[c for c in ("host_docs", "host_rate", "host_rejected", "kept") if c in docs.columns])
    # The statistics are needed twice (by host and in the result), so they are kept, without the text.
    stats = checkpointed(text_statistics(base, text))
    joined = stats.join(bounded(host_verdicts(stats, host)), F.col(host).eqNullSafe(F.col("__host")), "left").drop("__host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return apply_quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
),
tri AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
stats AS (
  SELECT d.doc_id, source, len(w) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines,
         len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered c USING (doc_id)
),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats),
rules AS (
  SELECT source, count(*) AS n,
         sum((base_failed)::INT) AS base,
         sum((10 * n_symbols > word_chars)::INT) AS symbols,
         sum((10 * n_dup_lines > 3 * n_lines)::INT) AS lines,
         sum((100 * n_repeat_words > 20 * n_words)::INT) AS repeats
  FROM failed GROUP BY source
),
long AS (UNPIVOT rules ON base, symbols, lines, repeats INTO NAME rule VALUE k),
prior AS (
  SELECT rule, sum(k) / sum(n)::DOUBLE AS m, greatest(sum(k * k / n::DOUBLE) / sum(n) - (sum(k) / sum(n)::DOUBLE) ** 2, 0) AS v
  FROM long GROUP BY rule
),
strength AS (SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 2), 10000) ELSE 10000 END AS s FROM prior),
verdict AS (
  SELECT source, max((k + m * s) / (n + s)) > 0.5 AS rejected FROM long JOIN strength USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM failed LEFT JOIN verdict ON failed.source IS NOT DISTINCT FROM verdict.source
"""
