"""Batch exchange with an external model: inputs and work lists out, replies in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalars import trimmed
from docloom.operators.ocr import weak_text_flag
from docloom.operators.shape import BLOCKS, _NUMERIC


def build_model_input(docs: DataFrame, guide: str = "") -> DataFrame:
    """``(doc_id, model_input)`` of ``docs(doc_id, text, table_lines, doc_hint, candidates, pairs)``: titled sections, empty ones left out."""

    def section(title: str, body: Column) -> Column:
        return F.when(body.isNotNull() & (body != ""), F.concat(F.lit(f"【{title}】\n"), body))

    parts = [
        F.concat(F.lit("【清洗文本】\n"), F.coalesce("text", F.lit(""))),
        section("表格行", F.array_join("table_lines", "\n")),
        section("文档类型提示", F.to_json("doc_hint")),
        section("候选字段", F.when(F.size("candidates") > 0, F.to_json(F.transform("candidates", lambda c: F.struct(*[c[k].alias(k) for k in ("field_name", "field_type", "field_value", "confidence")]))))),
        section("键值对对齐", F.when(F.size("pairs") > 0, F.to_json("pairs"))),
        section("NORMALIZE_GUIDE", F.lit(guide)),
    ]
    return docs.select("doc_id", F.concat_ws("\n\n", *parts).alias("model_input"))


# What the model is asked, before the document's text.
CORRECTION_PROMPT = "你是 OCR 纠错器，请在保持原文语义的基础上纠正常见 OCR 错误，输出纯文本。\n要求：不编造内容；保持换行；只返回纠正后的文本。\n\n原文：\n"
FIELD_PROMPT = (
    '你是高校文档结构化解析引擎。请从文本中提取下列字段，输出严格 JSON：{"extract_details":[{"field_name":"","field_value":"","field_type":"","confidence":0.0}]}。\n'
    "规则：\n1) 缺失用 null；2) 不要返回 NaN/undefined；3) confidence 0~1；4) 只输出 JSON。\n字段列表：\n"
)
CLASS_PROMPT = (
    '根据以下高校文档文本判断文档类型，输出 JSON：{"document_type":"","confidence":0.0,"probabilities":{}}。'
    "类型示例：成绩单、学籍卡、在校证明、毕业证书/学历证书、学位证书、合同、申请、通知、课表、其他。\n文本：\n"
)


def _prompted(docs: DataFrame, prompt: str) -> DataFrame:
    return docs.select("doc_id", F.concat(F.lit(prompt), F.coalesce("text", F.lit(""))).alias("prompt"))


def build_field_prompt(docs: DataFrame, template: dict) -> DataFrame:
    """``(doc_id, prompt)``: the template's fields as a list, then the text."""
    listed = "\n".join(f"- {f['name']} ({f.get('type') or 'TEXT'}): {f.get('description') or ''}" for f in template.get("fields") or [])
    return _prompted(docs, f"{FIELD_PROMPT}{listed}\n文本：\n")


def build_correction_prompt(docs: DataFrame) -> DataFrame:
    """``(doc_id, prompt)``: the text to be corrected where recognition went wrong."""
    return _prompted(docs, CORRECTION_PROMPT)


def build_classification_prompt(docs: DataFrame) -> DataFrame:
    """``(doc_id, prompt)``: the text whose type is asked for."""
    return _prompted(docs, CLASS_PROMPT)


_BLOCK = ", ".join(f"{b}: struct<{', '.join(f'{n}: ' + ('double' if n in _NUMERIC else 'string') for n in names)}>" for b, names in BLOCKS.items())
_COURSE = "academic_year: string, semester: string, course_code: string, course_seq: string, course_name: string, credit: string, score: string, gpa: string"
_DETAIL = "field_name: string, field_type: string, field_value: string, confidence: double"
REPLY_SCHEMA = (
    "struct<document_type: string, confidence: double, confidence_overall: double, probabilities: map<string, double>, summary: string, text: string, "
    f"extract_details: array<struct<{_DETAIL}>>, courses: array<struct<{_COURSE}>>, {_BLOCK}>"
)


def parse_model_replies(replies: DataFrame) -> DataFrame:
    """``replies(doc_id, reply)`` with ``parsed`` (null unless the part from the first ``{`` to the last ``}`` is JSON) and the class it gives."""
    first, last = F.locate("{", F.col("reply")), F.length("reply") - F.locate("}", F.reverse("reply")) + 1
    body = F.when((first > 0) & (F.locate("}", F.col("reply")) > 0) & (last > first), F.substr(F.col("reply"), first, last - first + 1))
    rows = replies.withColumn("__body", body).withColumn("__ok", F.try_parse_json("__body").isNotNull())
    rows = rows.withColumn("parsed", F.when(F.col("__ok"), F.from_json("__body", REPLY_SCHEMA)))
    return rows.select(
        "doc_id", "parsed", F.coalesce("parsed.document_type", F.lit("generic_document")).alias("document_type"), F.coalesce("parsed.confidence", "parsed.confidence_overall", F.lit(0.0)).alias("confidence")
    )


def reply_fields(parsed: DataFrame) -> DataFrame:
    """Field details of replies: those that a reply lists, then the values of its blocks, each name's first value."""
    listed = F.coalesce("parsed.extract_details", F.array().cast(f"array<struct<{_DETAIL}>>"))
    sure = F.coalesce("parsed.confidence_overall", "parsed.confidence", F.lit(0.0))
    shaped = [F.struct(F.lit(n).alias("field_name"), F.lit("NUMBER" if n in _NUMERIC else "TEXT").alias("field_type"), F.col(f"parsed.{b}.{n}").cast("string").alias("field_value"), sure.alias("confidence")) for b, names in BLOCKS.items() for n in names]
    named = F.filter(F.concat(listed, F.array(*shaped)), lambda d: (d["field_name"] != "") & (d["field_value"] != ""))
    rows = parsed.select("doc_id", F.posexplode(named).alias("field_ord", "d")).select("doc_id", "field_ord", "d.*")
    first = rows.groupBy("doc_id", "field_name").agg(F.min_by(F.struct("field_ord", "field_type", "field_value", "confidence"), "field_ord").alias("d"))
    return first.select("doc_id", "d.field_ord", "field_name", F.coalesce("d.field_type", F.lit("TEXT")).alias("field_type"), "d.field_value", F.coalesce("d.confidence", F.lit(0.0)).alias("confidence"))


def reply_courses(parsed: DataFrame) -> DataFrame:
    """Course rows of replies, as they give them."""
    return parsed.select("doc_id", F.posexplode("parsed.courses").alias("line_no", "c")).select("doc_id", "line_no", "c.*")


def needs_model(docs: DataFrame) -> DataFrame:
    """``(doc_id, route)`` of ``docs(doc_id, text, confidence, total_boxes, extracted_fields, disable_ai, llm_only)``: text, image or none."""
    off, only = F.coalesce("disable_ai", F.lit(False)), F.coalesce("llm_only", F.lit(False))
    weak = weak_text_flag(F.col("text"), F.col("confidence"), F.col("total_boxes"))
    route = F.when(off, "none").when(F.col("total_boxes").isNotNull() & weak, "image").when(only | (F.coalesce("extracted_fields", F.lit(0)) == 0), "text").otherwise("none")
    return docs.select("doc_id", route.alias("route"))


def apply_corrections(docs: DataFrame, replies: DataFrame) -> DataFrame:
    """``docs(doc_id, text, confidence)`` with corrected texts where there are any; ``source`` says whose the text is."""
    fixed = F.nullif(trimmed(F.col("corrected")), F.lit(""))
    joined = docs.join(replies.select("doc_id", "corrected"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce(fixed, "text").alias("text"), "confidence", F.when(fixed.isNotNull(), "llm").otherwise("ocr").alias("source"))
