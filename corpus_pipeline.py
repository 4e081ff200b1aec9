"""A corpus pipeline of five operators: ``documents`` in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import common, line_dedup, mixing, near_text, packing, quality_model


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_model.keep_good(docs, common.read(spark, sf_dir, "labels"))


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that ten documents or more share.

    Null and empty texts are one empty line, which stays. Repeated rows count as one document and all stay. Empty table: no rows.
    """
    return line_dedup.apply_line_dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at similarity 0.8 stays: that with the smallest id.

    Null texts and texts without words count as copies of one another. Of rows that share id and text any one stays. Empty table: no rows.
    """
    return near_text.one_of_each_similar_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their weights.

    Null sources are a source of their own, null texts have no words and are never taken; equal rows are told apart by their place among themselves. Empty table: no rows.
    """
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are tokenized and packed into sequences: one row a piece.

    Null and empty texts are their end token alone; repeated rows are packed each for itself. Empty table: no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good_documents),
    ("line dedup", drop_frequent_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Fingerprints, classifiers and tokenizers are beyond SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written as Parquet and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            folder = common.shared_folder(spark, f"stage{number + 1}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
