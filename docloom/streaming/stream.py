"""Documents as they arrive: the batch answer for every micro-batch, written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docloom.plans.process import process
from docloom.sources.cache import cache_entries, cache_upsert
from docloom.sources.store import dropped_after

DOCUMENT_SCHEMA = "doc_id long, text string"


def process_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Parquet documents landing in ``in_dir`` to responses in ``out_dir``, a folder for each batch.

    A batch that is run again after a failure overwrites its own folder, so each document is answered once. What a
    batch keeps in the shared folder on its way goes once its answers are written.
    """
    stream = spark.readStream.schema(DOCUMENT_SCHEMA).parquet(in_dir)

    def write(batch: DataFrame, number: int) -> None:
        with dropped_after(batch.sparkSession):
            process(batch).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_cache(spark: SparkSession, in_dir: str, fields_of, cache_dir: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Keeps the result cache over micro-batches: version n + 1 is written from version n and the batch.

    ``fields_of(documents)`` gives a batch's field details.
    """
    stream = spark.readStream.schema(DOCUMENT_SCHEMA).parquet(in_dir)

    def update(batch: DataFrame, number: int) -> None:
        before = f"{cache_dir}/version={number}"
        empty = spark.createDataFrame([], "key string, seq long, extract_details array<struct<field_ord:int,field_name:string,field_type:string,field_value:string,confidence:double>>")
        cache = empty if number == 0 else spark.read.parquet(before)
        cache_upsert(cache, cache_entries(batch, fields_of(batch))).write.mode("overwrite").parquet(f"{cache_dir}/version={number + 1}")

    writer = stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
