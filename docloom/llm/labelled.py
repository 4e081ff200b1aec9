"""A bounded sample of labelled documents for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpointed, held_out


def training_labels(labels: DataFrame, label: str, most: dict[int, int], doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, label)``: up to ``most[v]`` rows of each label value ``v`` outside the held-out fold.

    Rows are picked in order of a hash of their id, so reruns agree. An id with several labels gets
    the largest. At most ``sum(most.values())`` rows: small enough to broadcast.
    """
    free = labels.where(~held_out(doc_id) & F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    free = free.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    picked = None
    for value, n in most.items():
        part = free.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.unionAll(part)
    return checkpointed(picked)
