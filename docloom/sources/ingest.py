"""Requests in, envelopes out: schemas, checks, payloads, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPTIONS = (
    "auto_infer_fields boolean, llm_only boolean, disable_ai boolean, analyze_ocr boolean, llm_image boolean, detect_table boolean, table_force boolean,"
    " enhance_image boolean, handwriting_mode boolean, llm_provider string, llm_model string, table_detect_threshold double"
)
REQUEST_SCHEMA = f"file_id string, file_path string, file_content string, file_name string, text string, options struct<{OPTIONS.replace(' boolean', ':boolean').replace(' string', ':string').replace(' double', ':double')}>"
MAX_TEXT = 50_000
MAX_PAYLOAD = 8 * 1024 * 1024
MAX_FILE = 10 * 1024 * 1024
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tiff", "tif", "webp", "pdf")
_MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "bmp": "image/bmp", "tiff": "image/tiff", "tif": "image/tiff", "webp": "image/webp", "pdf": "application/pdf"}


def read_requests(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Document requests (JSON lines or Parquet) with the fixed schema."""
    return spark.read.schema(REQUEST_SCHEMA).format(kind).load(path)


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): text over 50,000 characters, payload over 8 MiB, or neither text nor file is code 400."""
    has_text = F.coalesce(F.col("text") != "", F.lit(False))
    has_file = F.coalesce(F.col("file_content") != "", F.lit(False)) | F.coalesce(F.col("file_path") != "", F.lit(False))
    message = (
        F.when(F.length("text") > MAX_TEXT, "text too long")
        .when(F.length("file_content") * 0.75 > MAX_PAYLOAD, "file_content too large")
        .when(~has_text & ~has_file, "text or file is required")
    )
    judged = requests.withColumn("message", message)
    return judged.where("message IS NULL").drop("message"), judged.where("message IS NOT NULL").withColumn("code", F.lit(400))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def validate_files(files: DataFrame) -> DataFrame:
    """``files(path, length)`` with ``ok``: a known extension and 10 MiB at most."""
    return files.withColumn("ok", extension(F.col("path")).isin(*EXTENSIONS) & (F.col("length") <= MAX_FILE))


def decode_payload(requests: DataFrame) -> DataFrame:
    """``requests`` with ``payload`` (binary, null where it is no base64) and ``suffix`` (``.png`` by default)."""
    body = F.substring_index("file_content", ",", -1)
    suffix = F.concat(F.lit("."), F.coalesce(F.nullif(extension(F.col("file_name")), F.lit("")), F.lit("png")))
    return requests.withColumn("payload", F.try_to_binary(body, F.lit("base64"))).withColumn("suffix", suffix)


def to_data_url(name: Column, payload: Column) -> Column:
    """``data:<mime>;base64,<payload>``; what is a data URL already stays."""
    mime = F.coalesce(*[F.when(extension(name) == k, v) for k, v in _MIME.items()], F.lit("image/png"))
    return F.when(payload.startswith("data:"), payload).otherwise(F.concat(F.lit("data:"), mime, F.lit(";base64,"), payload))


def ensure_ids(requests: DataFrame) -> DataFrame:
    """Missing ids filled with a UUID."""
    return requests.withColumn("file_id", F.coalesce("file_id", F.uuid()))


def success_envelope(responses: DataFrame) -> DataFrame:
    """``(doc_id, value)``: ``{code, message, data}`` as JSON."""
    data = F.struct(*[c for c in responses.columns if c != "doc_id"])
    return responses.select("doc_id", F.to_json(F.struct(F.lit(200).alias("code"), F.lit("success").alias("message"), data.alias("data"))).alias("value"))


def error_envelope(rejected: DataFrame) -> DataFrame:
    """``(value)``: ``{code, message, detail}`` as JSON, detail left out where null."""
    return rejected.select(F.to_json(F.struct("code", "message", F.col("file_id").alias("detail")), {"ignoreNullFields": "true"}).alias("value"))


def write_responses(responses: DataFrame, path: str) -> None:
    success_envelope(responses).select("value").write.mode("overwrite").text(path)


def write_rejects(rejected: DataFrame, path: str) -> None:
    error_envelope(rejected).write.mode("overwrite").text(path)
