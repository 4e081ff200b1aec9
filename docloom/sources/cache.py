"""The result cache: a keyed table of sure field details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalars import cache_key

LEAST_CONFIDENCE = 0.7
ENTRIES = 100


def cache_lookup(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """``docs`` with the ``extract_details`` cached under their text's key, null where there are none."""
    return docs.withColumn("key", cache_key(F.col("text"))).join(cache.select("key", "extract_details"), "key", "left")


def cache_entries(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """``(key, doc_id, extract_details)`` of documents with details that have a value and confidence 0.7 or more."""
    sure = fields.where(F.col("field_value").isNotNull() & (F.col("confidence") >= LEAST_CONFIDENCE))
    detail = F.struct("field_ord", "field_name", "field_type", "field_value", "confidence")
    grouped = sure.groupBy("doc_id").agg(F.array_sort(F.collect_list(detail)).alias("extract_details"))
    return docs.select("doc_id", cache_key(F.col("text")).alias("key")).join(grouped, "doc_id")


def cache_upsert(cache: DataFrame, entries: DataFrame, most: int = ENTRIES) -> DataFrame:
    """The cache ``(key, seq, extract_details)`` after ``entries``: a known key keeps its place and takes the new
    details, new keys follow in order of document; the ``most`` newest places stay (the cache's own bound)."""
    new = entries.groupBy("key").agg(F.max_by("extract_details", "doc_id").alias("n_details"), F.min("doc_id").alias("first_doc"))
    both = cache.join(new, "key", "full_outer")
    # New entries rank after every old one: (0, old place) or (1, document).
    placed = both.select(
        "key",
        F.coalesce("n_details", "extract_details").alias("extract_details"),
        F.when(F.col("seq").isNotNull(), F.lit(0)).otherwise(1).alias("age"),
        F.coalesce("seq", "first_doc").alias("at"),
    )
    newest = placed.orderBy(F.desc("age"), F.desc("at"), "key").limit(most)
    last = F.row_number().over(_by_age())
    return newest.select("key", last.cast("long").alias("seq"), "extract_details")


def _by_age():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy("age", "at", "key")
