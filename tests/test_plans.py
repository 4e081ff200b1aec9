"""What is made once must stand once in the plan; it once stood there for every use."""

from pyspark.sql import functions as F

from docloom.functions import packs
from docloom.operators import card, classify, entities, lines, tables
from docloom.plans.fixtures import render


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_cut_once(spark):
    docs = spark.createDataFrame([(1, " a  b c d e\n\n日期 5\n课程 1 2 3")], "doc_id long, text string")
    for rows in (lines.segment_document(docs), lines.section_lines(docs), lines.split_text_sections(docs)):
        assert _plan(rows).count("split(") == 1
    assert lines.segment_document(docs).first().asDict() == {
        "doc_id": 1, "text": " a  b c d e\n\n日期 5\n课程 1 2 3", "header": ["a  b c d e", "日期 5", "课程 1 2 3"], "meta": ["日期 5"], "table": ["a  b c d e", "课程 1 2 3"], "body": ["日期 5"],
    }


def test_lines_of_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(r.doc_id, r.header, r.table) for r in lines.segment_document(docs).orderBy("doc_id").collect()] == [(1, None, None), (2, [], [])]
    assert tables.courses_from_lines(docs).count() == 0


def test_rendered_lines_are_not_listed_by_listagg(spark, sf):
    assert "listagg" not in _plan(render(spark, sf, "transcripts")).lower()


def test_long_scores_judge_once(spark):
    docs = spark.createDataFrame([(1, "请假条")], "doc_id long, text string")
    rows = classify.long_scores(classify.classify_free(docs), "nlp")
    assert "Union" not in _plan(rows)
    assert rows.where("score > 0").orderBy("type_ord").select("doc_type", "type_ord", "score").collect() == [("请假条", -1, 1.0), ("请假条", 12, 1.0)]


def test_courses_are_judged_once(spark):
    course = "doc_id long, line_no int, academic_year string, semester string, course_code string, course_seq string, course_name string, credit double, score double, gpa double"
    rule = spark.createDataFrame([(1, 0, None, None, None, None, "高等数学", 1.0, 2.0, 3.0)], course)
    docs = spark.createDataFrame([(1, "成绩单"), (2, "成绩单")], "doc_id long, text string")
    types = docs.select("doc_id", F.lit("成绩单").alias("document_type"))
    _, outcome = tables.resolve_courses(rule, rule.where("false"), docs, types, rule.withColumn("course_name", F.lit("模型")))
    assert "Join" not in _plan(outcome)
    assert sorted(map(tuple, outcome.collect())) == [(1, "replace"), (2, "clear")]


def test_segments_are_made_once(spark):
    docs = spark.createDataFrame([(1, "姓名 甲 学号 12")], "doc_id long, text string")
    rows = card.label_segments(docs)
    assert _plan(rows).count("split(text#") == len((*card.LABELS, *card.CODE_LABELS))
    assert sorted((r.label, r.segment) for r in rows.collect()) == [("姓名", "甲"), ("学号", "12")]


def test_spans_are_found_once(spark):
    docs = spark.createDataFrame([(1, "学号：12345678")], "doc_id long, text string")
    rows = entities.extract_entities(docs, ["STUDENT_ID"])
    assert _plan(rows).count("regexp_replace(") == sum(r[0] == "STUDENT_ID" for r in packs.ENTITY_RULES)
    assert rows.count() == 2
