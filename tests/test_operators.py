"""Literal rows for what the rendered forms do not reach, and the invariants."""

import json
import pathlib
import warnings

from pyspark.sql import functions as F

from docloom.functions import predicates, scalars
from docloom.operators import card, classify, entities, fields, lines, ocr, shape, tables
from docloom.plans.process import begin, process, resume
from docloom.sources import cache, ingest, templates
from docloom.streaming.stream import process_stream, stream_cache

LEAVE = "请、销假单\n姓名：张三 学号：242040390 班级：软升243\n请假原因：论文调研\n开始日期：2024年5月6日\n本人手机号：_18455716598\nE-mail: zhang.san@example.com"


def _docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "v string").select(*columns).head()


def test_dates(spark):
    v = F.col("v")
    for text, want in (("2024年5月6日", "2024-05-06"), ("2024/5/6", "2024-05-06"), ("2024-5", "2024-05"), ("2024年5月", None), ("", None), (None, None), ("2024-13-40", "2024-13-40")):
        assert _one(spark, text, scalars.normalize_date(v))[0] == want
    for text, want in (("2024年5月", "2024-05-01"), ("2024-13-40", None), ("2024.5.6", "2024-05-06")):
        assert _one(spark, text, scalars.normalize_date_strict(v))[0] == want


def test_identities(spark):
    v = F.col("v")
    assert _one(spark, "手机 184-5571-6598", scalars.normalize_phone(v))[0] == "18455716598"
    assert _one(spark, "28455716598", scalars.normalize_phone(v))[0] is None
    assert _one(spark, "34010119990101123x", scalars.normalize_id_number(v), scalars.normalize_identity(F.lit("ID_NUMBER"), v))[:] == ("34010119990101123x", "34010119990101123X")
    assert _one(spark, "10,000.50（元）", scalars.parse_money(v))[0] == 10000.5
    assert _one(spark, "自2024-5-6至2024/5/9", scalars.extract_date_range(v))[0] == ("2024-05-06", "2024-05-09")


def test_predicates(spark):
    v = F.col("v")
    assert _one(spark, "联系方式：", predicates.is_label_like(v), predicates.is_bad_value(v))[:] == (True, True)
    assert _one(spark, "张三", predicates.is_label_like(v), predicates.is_bad_value(v))[:] == (False, False)
    assert _one(spark, None, predicates.is_label_like(v), predicates.is_bad_value(v))[:] == (False, True)
    assert _one(spark, "_班级：软升243_", predicates.clean_kv_value(v))[0] == "软升243"


def test_spans_are_the_text(spark):
    docs = _docs(spark, LEAVE, "\U0001f600 手机：13912345678 😀 手机：13912345679", "", None)
    found = entities.extract_entities(docs)
    assert found.count() > 20
    joined = found.join(docs.withColumnRenamed("text", "t"), "doc_id")
    assert joined.where(F.substr("t", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text")).count() == 0
    values = {(r["type"], r["text"]) for r in found.collect()}
    assert {("PHONE", "18455716598"), ("STUDENT_ID", "242040390"), ("EMAIL", "zhang.san@example.com")} <= values


def test_leave_form_is_no_roster(spark):
    docs = _docs(spark, LEAVE)
    found = entities.extract_entities(docs, ["PERSON", "STUDENT_ID", "PHONE"])
    assert classify.classify_weighted(docs, found).head()["document_type"] == "请假条"


def test_shares_sum_to_one(spark):
    docs = _docs(spark, LEAVE, "没有", "成绩单 课程 合同")
    for row in classify.classify_free(docs).collect():
        total = sum(row["probabilities"].values())
        assert total == 0 or abs(total - 1) < 18 * 5e-5


def test_key_values(spark):
    docs = _docs(spark, "学院：计算机学院\n专业 软件工程\n学制\n两年\n性别 男 民族 汉族")
    got = {(r["rule"], r["key"], r["value"]) for r in entities.align_key_values(docs).collect()}
    assert (3, "学制", "两年") in got and (0, "性别", "男") in got and (0, "民族", "汉族") in got
    assert not [p for p in got if p[1] == "学院" and p[2] == "计算机学院" and p[0] == 2]


def test_tables(spark):
    html = "<table><tr><th>学期</th><th>课 程</th></tr><tr></tr><tr><td>2024</td><td>a&amp;b</td></tr></table>"
    t = spark.createDataFrame([(1, 0, html), (2, 0, "行一\n行 二")], "doc_id long, table_no int, html string")
    assert [(r[0], r["row"], r["cells"]) for r in tables.html_table_to_grid(t).orderBy("doc_id", "row").collect()] == [(1, 0, ["学期", "课程"]), (1, 2, ["2024", "a&b"]), (2, 0, ["行一"]), (2, 1, ["行二"])]


def test_courses(spark):
    docs = _docs(spark, "2024-2025-1 100001 01 高等数学 必修 4 95 4.0", "2024-2025-1\n100001\n01\n高等数学\n必修\n4\n95\n2024-2025-2\n100002\n02\n英语\n必修\n3\n88", "无")
    by_line = tables.courses_from_lines(docs)
    assert [tuple(r)[5:] for r in by_line.collect()] == [("01", "高等数学 必修", 4.0, 95.0, 4.0)]
    tokens = tables.courses_from_tokens(docs, by_line)
    assert [(r["course_code"], r["credit"], r["score"]) for r in tokens.orderBy("line_no").collect()] == [("100001", 4.0, 95.0), ("100002", 3.0, 88.0)]
    assert {r["doc_id"]: r["noisy"] for r in tables.noisy_courses(docs, by_line).collect()} == {0: False, 1: True, 2: True}


def test_roster_fields(spark):
    """First member, first triple, commonest class, the word itself; what is no roster is left out."""
    docs = _docs(
        spark, "成员名单\n0 软升001 王五 男\n2 软升002 李四 女\n3 软升001 赵六 女", "班级名单\n软件 张 男", "班级成员表\n姓名：张三\n性别：女\n软工7 软工7", "通知：姓名 张三", "班级名单\n1 计科7 男\n2 计科8 男\n3 计科8 女",
    )
    got: dict = {}
    for r in fields.infer_roster_fields(docs, tables.roster_rows(docs), tables.roster_sample(docs), tables.roster_class(docs)).orderBy("doc_id", "field_ord").collect():
        got.setdefault(r["doc_id"], []).append((r["field_value"], r["confidence"], r["source_position"] and r["source_position"]["context"]))
    assert got[0] == [("软升002", 0.85, "roster-sample"), ("李四", 0.85, "roster-sample"), ("女", 0.85, "roster-sample")]
    assert got[1] == [("软件", 0.85, "roster-sample"), ("张", 0.85, "roster-sample"), ("男", 0.85, "roster-sample")]
    assert got[2][0] == ("软工7", 0.9, "roster-majority") and got[2][1][:2] == ("张三", 0.9) and got[2][2][:2] == ("女", 0.9)
    assert got[4] == [("计科8", 0.9, "roster-majority"), (None, 0.0, None), (None, 0.0, None)] and 3 not in got
    assert [f["name"] for f in fields.roster_template()["fields"]] == ["class", "name", "gender"]


def test_roster(spark):
    docs = _docs(spark, "序号 班级 姓名 性别\n2 软升243 张三 男\n1 软升243 李四 女\n3 软升243 张三 男")
    assert [(r["number"], r["name"]) for r in tables.roster_rows(docs).orderBy("ord").collect()] == [(1, "李四"), (2, "张三")]


def test_bad_pattern_is_left_out(spark):
    import pytest

    with pytest.warns(UserWarning):
        rows = fields.extract_fields(_docs(spark, LEAVE), {"fields": [{"name": "x", "type": "TEXT", "patterns": ["(", "学号：(\\d+)"]}]})
    row = rows.head()
    assert (row["field_value"], row["confidence"]) == ("242040390", 0.9)
    assert LEAVE[row["source_position"]["start"] :].startswith("学号：242040390")


def test_null_base_blocks(spark):
    kind = "doc_id long, field_ord int, field_name string, field_type string, field_value string, confidence double"
    base = spark.createDataFrame([(1, 0, "a", "TEXT", None, 0.0)], kind)
    extra = spark.createDataFrame([(1, 0, "a", "TEXT", "x", 0.9), (1, 1, "b", "TEXT", "y", 0.8)], kind)
    merged, summary = shape.merge_fields(base, extra)
    assert {(r["field_name"], r["field_value"]) for r in merged.collect()} == {("a", None), ("b", "y")}
    assert summary.head()["confidence"] == 0.8


def test_birth_date_from_id(spark):
    kind = "doc_id long, field_ord int, field_name string, field_type string, field_value string, confidence double"
    rows = spark.createDataFrame([(1, 0, "id", "ID_NUMBER", "34010119990203123x", 0.9), (1, 1, "day", "DATE", None, 0.9), (1, 2, "name", "PERSON", "姓 名", 0.9)], kind)
    got = {r["field_name"]: (r["field_value"], r["confidence"]) for r in shape.fix_fields(rows).collect()}
    assert got == {"id": ("34010119990203123X", 0.9), "day": ("1999-02-03", 0.6), "name": (None, 0.0)}


def test_sanitize(spark):
    v = F.col("v")
    assert _one(spark, "周宇清", shape.sanitize(v), shape.sanitize(v, strict=True))[:] == (None, "周宇清")
    assert _one(spark, "姓名：周宇清", shape.sanitize(v, strict=True))[0] == "周宇清"


def test_quality(spark):
    got = {r["doc_id"]: (r["level"], r["problems"]) for r in lines.assess_quality(_docs(spark, "", None, "???" * 30, "一二三四五六七八九十")).collect()}
    assert got[0] == got[1] == ("critical", ["文本缺失"])
    assert got[2][0] == "critical" and got[3] == ("good", [])


def test_variants(spark):
    rows = [(1, 0, "aaaaaaaaaa", 0.5, 3), (1, 1, "aaaaaaaaaaaa", 0.5, 3), (1, 2, "", 0.9, 9)]
    got = ocr.pick_best_variant(spark.createDataFrame(rows, "doc_id long, variant int, text string, confidence double, total_boxes int")).head()
    assert got["variant"] == 1


def test_card(spark):
    docs = _docs(spark, "姓名 周宇清 性别 男 软件工程丨普通全日制\n学号 242040390 民族 汉族 学制 2年 系所 计算机学院 班级 软升243 入学日期 2024年9月1日")
    got = card.student_card(docs, entities.extract_entities(docs, ["ID_NUMBER", "STUDENT_ID", "DATE"])).head().asDict()
    want = {"name": "周宇清", "gender": "男", "nation": "汉族", "student_id": "242040390", "major": "软件工程", "class_name": "软升243", "study_mode": "普通全日制", "enroll_date": "2024-09-01", "schooling_length": "2年", "college": "计算机学院"}
    assert {k: got[k] for k in want} == want


def test_requests(spark):
    rows = [("1", None, None, None, "x" * 50_001), ("2", None, None, None, "ok"), ("3", None, "!!", "a.png", None), ("4", None, None, None, None)]
    requests = spark.createDataFrame(rows, "file_id string, file_path string, file_content string, file_name string, text string")
    ok, bad = ingest.validate_requests(requests)
    assert {r["file_id"] for r in ok.collect()} == {"2", "3"} and {r["file_id"] for r in bad.collect()} == {"1", "4"}
    assert ingest.decode_payload(requests.where("file_id = '3'")).head()["payload"] is None
    assert ingest.ensure_ids(requests.withColumn("file_id", F.lit(None).cast("string"))).where("file_id IS NULL").count() == 0


def test_cache_keeps_places(spark):
    kind = "key string, seq long, extract_details array<string>"
    old = spark.createDataFrame([("a", 1, ["x"]), ("b", 2, ["y"])], kind)
    new = spark.createDataFrame([("a", 7, ["z"]), ("c", 8, ["w"])], "key string, doc_id long, extract_details array<string>")
    got = [(r["key"], r["extract_details"]) for r in cache.cache_upsert(old, new, 2).orderBy("seq").collect()]
    assert got == [("b", ["y"]), ("c", ["w"])]


def test_stream_answers_as_batch(spark, tmp_path):
    docs = _docs(spark, LEAVE, "成绩单\n2024-2025-1 100001 01 高等数学 必修 4 95 4.0")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    process_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    keep = ["doc_id", "document_type", "fields.extract_main.status", "summary"]
    streamed = spark.read.parquet(str(tmp_path / "out")).select(*keep).orderBy("doc_id").collect()
    assert streamed == process(docs).select(*keep).orderBy("doc_id").collect() and len(streamed) == 2


def test_stream_keeps_the_cache_over_batches(spark, tmp_path):
    """Two batches, the second with a text seen before: each version follows from the one before and its batch."""
    form = "姓名 张三 学号 {} 性别 男"
    for k, rows in enumerate(([(1, form.format(242040001)), (2, form.format(242040002))], [(3, form.format(242040001)), (4, form.format(242040004))])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream_cache(spark, str(tmp_path / "in"), fields.proof_fields, str(tmp_path / "cache"), str(tmp_path / "state")).awaitTermination()
        got = spark.read.parquet(str(tmp_path / f"cache/version={k + 1}")).orderBy("seq").collect()
        keys = [1, 2] if k == 0 else [1, 2, 4]
        want = [spark.createDataFrame([(form.format(242040000 + i),)], "t string").select(scalars.cache_key(F.col("t"))).head()[0] for i in keys]
        assert [r["key"] for r in got] == want
        assert all({d["field_name"] for d in r["extract_details"]} == {"name", "student_id", "gender"} for r in got)


def test_contract_repair(spark):
    """Labels leave their slots, and what is empty is filled from entities, pairs and text."""
    text = "贷款合同\n专业名称 专业名称软件工程\n学院 计算机科学学院\n地址：安徽省合肥市蜀山区 长江路 1 号\n金额 8000（元）\n期限 3 年"
    docs = spark.createDataFrame([(1, text), (2, "通知")], "doc_id long, text string")
    details = spark.createDataFrame([(1, 0, "name", "TEXT", "姓名", 0.9), (1, 1, "major", "TEXT", "专业", 0.9), (2, 0, "name", "TEXT", "姓名", 0.9)], "doc_id long, field_ord int, field_name string, field_type string, field_value string, confidence double")
    types = spark.createDataFrame([(1, "贷款合同"), (2, "通知")], "doc_id long, document_type string")
    kinds = [("PERSON", "学生姓名"), ("PERSON", "李四的父亲"), ("ID_NUMBER", "11010119900101123X"), ("VERIFY_CODE", "12345678"), ("VERIFY_CODE", "1234567890123456"), ("ADDRESS_FULL", "安徽省合肥市蜀山区 长江路"), ("BANK_ACCOUNT_NO", "6222000011"), ("LOAN_CONTRACT_NO", "622200001"), ("LOAN_BANK_NAME", "徽商银行")]
    found = spark.createDataFrame([(1, k, 1, t, v) for k, (t, v) in enumerate(kinds)], "doc_id long, rule int, ord int, type string, text string")
    pairs = spark.createDataFrame([(1, 1, 2, "专业名称", "专业名称软件工程与技术", 0.8), (1, 2, 2, "学院", "计算机科学学院", 0.8)], "doc_id long, line_no int, rule int, key string, value string, confidence double")
    rows = {r["doc_id"]: r.asDict() for r in shape.post_process_contract(shape.flatten_fields(details), docs, types, found, pairs).collect()}
    got = rows[1]
    assert (got["name"], got["id_number"], got["major"], got["college"]) == ("李四", "11010119900101123X", "软件工程与技术", "计算机科学学院")
    assert (got["address"], got["bank_name"], got["account_number"]) == ("安徽省合肥市蜀山区", "徽商银行", "12345678")
    assert got["certificate_id"] == got["verify_code"] == "1234567890123456"
    assert got["summary"] == "类型 贷款合同，借款人 李四，金额 8000.0 元，期限 3.0 年"
    assert rows[2]["name"] == "姓名" and rows[2]["summary"] is None


def test_inferred_fields_by_keyword_entity_and_shape(spark):
    text = "申请人 王五\n事由：\n  参加会议\n证件编号：AB-1234\n家长\n11010119900101123X"
    docs = _docs(spark, text)
    found = entities.extract_entities(docs, ["PERSON", "DATE"])
    got = {r["field_name"]: r for r in fields.infer_fields(docs, found).collect()}
    assert list(got) == [f["name"] for f in fields.inferred_template()["fields"]]
    assert (got["name"]["field_value"], got["name"]["confidence"]) == ("王五", 0.9)
    assert got["reason"]["field_value"] == "参加会议"
    place = got["certificate_id"]["source_position"]
    assert got["certificate_id"]["field_value"] == "AB-1234" == text[place["start"] : place["end"]]
    assert place["context"] == text[place["start"] - 15 : place["end"] + 15]
    assert (got["id_number"]["field_value"], got["id_number"]["confidence"]) == ("11010119900101123X", 0.9)
    # The keyword alone on its line takes the next line, as published.
    assert got["contact"]["field_value"] == "11010119900101123X"
    assert got["address"]["field_value"] is None and got["address"]["confidence"] == 0.0


def _tokens(spark, text):
    docs = _docs(spark, text)
    rows = tables.courses_from_tokens(docs, tables.courses_from_lines(docs)).orderBy("line_no").collect()
    return [(r["semester"], r["course_code"], r["course_name"], r["credit"], r["score"], r["gpa"]) for r in rows]


def test_token_courses(spark):
    far = " ".join(["选"] * 60)
    assert _tokens(spark, f"成绩单 2024-2025-1 100 01 高等数学 必修 {far} 4学分 95分 备注 4.5 完") == [("2024-2025-1", "100", "高等数学必修", 4.0, 95.0, 4.5)]
    # No words before its credit: the semester right before that credit opens the next course.
    assert _tokens(spark, "卡 2024-2025-1 7 8 9 2024-2025-2 3 5 大学 英语 2 88 6 7 3.5") == [("2024-2025-2", "3", "大学英语", 2.0, 88.0, 3.5)]
    # The search goes on behind the score, and a semester needs five tokens after it.
    assert _tokens(spark, "卡 2024-2025-1 7 8 体育 3 2024-2025-2 3 5 大学 英语 2 88") == [("2024-2025-1", "7", "体育", 3.0, 2024.0, 3.0)]
    assert _tokens(spark, "卡 2024-2025-1 7 8 体育 30") == [] and _tokens(spark, "卡 2024-2025-1 7 8 体育 30 40 50") == []


def test_resolved_courses(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, line_no int, academic_year string, semester string, course_code string, course_seq string, course_name string, credit double, score double, gpa double")
    one = lambda doc, name, k=0: (doc, k, None, None, None, None, name, 1.0, 2.0, None)
    docs = _docs(spark, *"abcd")
    kinds = docs.select("doc_id", F.when(F.col("doc_id") == 3, "通知").otherwise("成绩单").alias("document_type"))
    rule = rows(one(0, "高等数学"), one(0, "2024", 1), one(1, "1234", 0), one(3, "9"))
    table = rows(one(2, "2023", 5))
    names = lambda df: sorted((r["doc_id"], r["course_name"]) for r in df.collect())
    kept, outcome = tables.resolve_courses(rule, table, docs, kinds)
    assert names(kept) == [(0, "高等数学"), (2, "2023")] and {r["outcome"] for r in outcome.collect()} == {"keep"}
    kept, outcome = tables.resolve_courses(rule, table, docs, kinds, model=rows(one(1, "模型"), one(2, "7")))
    assert names(kept) == [(1, "模型")] and [r["outcome"] for r in outcome.orderBy("doc_id").collect()] == ["clear", "replace", "clear", "keep"]
    kept, _ = tables.resolve_courses(rule, table, docs, kinds, image=rows(one(0, "图像课程"), one(1, "图像课程"), one(3, "5")))
    assert names(kept) == [(0, "图像课程"), (1, "图像课程"), (2, "2023")]


def test_raw_recognition(spark):
    raw = '{"lines": ["a", 5, " "], "result": [{"html": "<TABLE>x</TABLE>"}, 3, "s", {"html": 5}], "data": {"html": "<table>"}, "structure": [{"html": "<table>2"}]}'
    docs = spark.createDataFrame([(1, "t", raw), (2, " p \nq", "nope"), (3, None, None), (4, "z", '{"lines": "x"}')], "doc_id long, text string, raw string")
    rows = {r["doc_id"]: r for r in lines.read_raw(docs).collect()}
    assert rows[1]["text"] == "a\n5" and rows[1]["lines"] == ["a", "5"] and rows[1]["html"] == ["<TABLE>x</TABLE>", "<table>2"]
    assert rows[2]["lines"] == ["p", "q"] and rows[2]["html"] == [] and rows[3]["lines"] == [] and rows[4]["lines"] == ["z"]


def test_table_of_templates_answers_as_the_compiled_pack(spark, tmp_path):
    pack = [
        {"template_id": "b", "document_type": "请假条", "match_keywords": ["学号", "E-MAIL"], "fields": [
            {"name": "id", "type": "STUDENT_ID", "patterns": ["没有(x)", r"学号[:：]\s*(\d+)"], "validation": {"min_length": 12}}, {"name": "who", "type": "PERSON", "required": True, "patterns": []},
            {"name": "class", "type": "TEXT", "patterns": [r"软升\d+", "("], "validation": {"enum": ["软升1"]}}, {"name": "day", "type": "NUMBER", "patterns": [r"(?:日期)[(：](\d{4})"], "validation": {"max": 2000}}]},
        {"template_id": "a", "document_type": "通知", "match_keywords": [], "required_fields": [{"field_name": "title", "field_type": "TEXT", "description": "标题"}]},
        {"template_id": "c", "document_type": "请假条", "match_keywords": ["学号", "e-mail"], "fields": []},
    ]
    (tmp_path / "pack.json").write_text(json.dumps(pack, ensure_ascii=False))
    with warnings.catch_warnings(record=True):
        table = templates.load_templates(spark, str(tmp_path))
        docs = _docs(spark, LEAVE, "无", LEAVE.replace("软升243", "软升1"))
        kinds = spark.createDataFrame([(0, "请假条"), (1, "通知"), (2, "其他")], "doc_id long, document_type string")
        chosen = lambda t: sorted(map(tuple, classify.select_template(docs.join(kinds, "doc_id"), t).collect()))
        order = F.when(F.col("template_id") == "b", 0).when(F.col("template_id") == "a", 1).otherwise(2)
        assert chosen(table.withColumn("ord", order)) == chosen(pack) and [t for _, t, _ in chosen(pack)] == ["b", "a", "b"]
        found = entities.extract_entities(docs, ["PERSON"])
        picked = docs.withColumn("template_id", F.when(F.col("doc_id") == 1, "a").otherwise("b"))
        got = fields.extract_by_templates(picked, table, found).where("doc_id <> 1")
        want = fields.extract_fields(docs.where("doc_id <> 1"), pack[0], found)
    plain = lambda df: sorted(tuple(r.asDict(True)[c] for c in ("doc_id", "field_ord", "field_name", "field_value", "confidence", "source_position")) + (r["validation"]["is_valid"],) for r in df.collect())
    assert [str(x) for x in plain(got)] == [str(x) for x in plain(want)]
    assert [r["field_name"] for r in fields.extract_by_templates(picked, table).where("doc_id = 1").collect()] == ["title"]


def test_loan_contract_slots(spark):
    docs = _docs(spark, "贷款合同 12000 元 期限 30月", "助学贷款 3.5 年 50 \\(元)", "贷款合同", "无")
    kinds = docs.select("doc_id", F.when(F.col("doc_id") == 2, "通知").otherwise("合同").alias("document_type"))
    found = spark.createDataFrame(
        [(0, 1, 0, "PERSON", "欧阳修文", 0.5), (0, 1, 1, "PERSON", "O.K", 0.9), (0, 1, 2, "PERSON", "Longer name", 1.0), (0, 2, 0, "VERIFY_CODE", "12345678", 0.1), (0, 2, 1, "VERIFY_CODE", " 123456789 ", 0.1), (0, 3, 0, "LOAN_BANK_NAME", "开户行", 0.9)],
        "doc_id long, rule int, ord int, type string, text string, confidence double",
    )
    pairs = spark.createDataFrame([(1, 4, 1, "验证", "11010519491231002X"), (1, 5, 1, "账号", "6222000011112222"), (1, 6, 1, "院系学院", "x")], "doc_id long, line_no int, rule int, key string, value string")
    flat = shape.flatten_fields(docs.select("doc_id", F.lit(0).alias("field_ord"), F.lit("name").alias("field_name"), F.lit("旧名").alias("field_value")))
    rows = {r["doc_id"]: r.asDict(True) for r in shape.map_loan_contract(found, pairs, kinds, docs, flat).collect()}
    assert rows.keys() == {0, 1}
    assert rows[0]["basic_info"]["name"] == "O.K" and rows[0]["certificate_info"]["verify_code"] == "123456789" and rows[0]["financial_info"] == {"bank_name": None, "account_number": "12345678", "loan_amount": 12000.0, "loan_years": 2.5}
    assert rows[1]["financial_info"] == {"bank_name": None, "account_number": "6222000011112222", "loan_amount": 50.0, "loan_years": 3.5} and rows[1]["basic_info"]["college"] == "x"
    over = shape.with_contract(flat, shape.map_loan_contract(found, pairs, kinds, docs, flat)).orderBy("doc_id").collect()
    assert [r["name"] for r in over] == ["O.K", "旧名", "旧名", "旧名"] and over[0]["loan_amount"] == "12000.0"


def test_exchange_with_cache(spark, tmp_path):
    """What rules or cache answer is not asked; replies give fields, class and courses; what is not answered says why."""
    docs = _docs(spark, LEAVE, "甲乙丙丁", "戊己庚辛", "子丑寅卯")
    seen = spark.createDataFrame([(2, "name", "TEXT", "王五", 0.9, 0)], "doc_id long, field_name string, field_type string, field_value string, confidence double, field_ord int")
    known = cache.cache_upsert(cache.cache_entries(docs, seen).where("false").select("key", F.lit(0).cast("long").alias("seq"), "extract_details"), cache.cache_entries(docs, seen))
    work = begin(docs, str(tmp_path / "state"), known)
    assert sorted(r["doc_id"] for r in work.collect()) == [1, 3] and all("甲乙丙丁" in r["field_prompt"] and "甲乙丙丁" in r["class_prompt"] for r in work.where("doc_id = 1").collect())
    courses = ",".join(f'{{"course_name": "课程{k}课", "credit": "{k}"}}' for k in range(4))
    reply = f'{{"document_type": "成绩单", "confidence": 0.9, "basic_info": {{"name": "张 三丰"}}, "extract_details": [{{"field_name": "hobby", "field_value": "围棋"}}], "courses": [{courses}]}}'
    replies = spark.createDataFrame([(1, reply), (1, '{"document_type": "通知", "confidence": 0.1}'), (3, "不知道"), (0, reply)], "doc_id long, reply string")
    rows, after = resume(spark, str(tmp_path / "state"), replies, known)
    rows = {r["doc_id"]: r.asDict(True) for r in rows.collect()}
    assert rows.keys() == {0, 1, 2, 3}
    assert rows[1]["document_type"] == "成绩单" and rows[1]["classification"]["source"] == "llm" and len(rows[1]["courses"]) == 4 and "围棋" in str(rows[1]["fields"]["extract_details"])
    assert rows[2]["classification"]["source"] == "nlp" and "王五" in str(rows[2]["fields"]["extract_details"]) and not rows[2]["notes"]
    assert any("LLM 调用失败" in n for n in rows[3]["notes"]) and "原因" in rows[3]["summary"] and rows[0]["basic_info"]["student_id"] == "242040390"
    assert after.count() > known.count()


def test_stream_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    """A batch that dies between its answers and its commit is answered again, once; the shared folder holds no more after it than before."""
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    files = lambda: {p for p in pathlib.Path(folder.removeprefix("file:")).rglob("*") if p.is_file() and not p.name.startswith(".")}
    before = files()
    run = lambda: process_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    _docs(spark, LEAVE).write.parquet(str(tmp_path / "in"))
    run()
    commit = next((tmp_path / "state" / "commits").glob("0"))
    commit.unlink()
    for crc in (tmp_path / "state" / "commits").glob(".0.crc"):
        crc.unlink()
    run()
    assert [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [0]
    assert files() <= before



def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()



def test_merge_fields_makes_the_base_once(spark):
    kind = "doc_id long, field_ord int, field_name string, field_type string, field_value string, confidence double"
    base = spark.createDataFrame([(1, 0, "a", "TEXT", None, 0.0), (1, 1, "b", "TEXT", "x", 0.5)], kind)
    extra = spark.createDataFrame([(1, 0, "a", "TEXT", "no", 0.9), (1, 1, "c", "TEXT", "y", 0.9), (1, 2, "c", "TEXT", "z", 0.9), (1, 3, None, "TEXT", "w", 0.9), (2, 0, "a", "TEXT", "v", 0.9)], kind)
    merged, summary = shape.merge_fields(base, extra)
    assert sorted((r.doc_id, r.field_ord, r.field_name, r.field_value) for r in merged.collect()) == [(1, 0, "a", None), (1, 1, "b", "x"), (1, 10_001, "c", "y"), (1, 10_002, "c", "z"), (1, 10_003, None, "w"), (2, 10_000, "a", "v")]
    assert {r.doc_id: (r.total_fields, r.extracted_fields) for r in summary.collect()} == {1: (5, 4), 2: (1, 1)}
    assert "Join" not in _plan(merged)



def test_patterns_run_only_on_texts_with_their_words(spark):
    text = "HTTPS://A.cn 姓名：王小明 安徽大学 贵校学生李四的 2024年9月1日"
    docs = spark.createDataFrame([(1, text), (2, "2024-2025-1"), (3, None)], "doc_id long, text string")
    proofs = fields.proof_fields(docs)
    found = {r.field_name: r.field_value for r in proofs.collect() if r.doc_id == 1 and r.field_value}
    assert found == {"name": "王小明", "school_name": "安徽大学", "verify_url": "HTTPS://A.cn"}
    assert not [r for r in proofs.collect() if r.doc_id > 1 and r.field_value]
    loans = {r.field_name: r.field_value for r in fields.loan_contract_fields(docs).collect()}
    assert loans["name"] == "李四" and loans["issue_date"] == "2024-09-01"
    assert "出生日期)" in _plan(proofs)



def test_fail_analysis_makes_each_side_once(spark):
    typed = spark.createDataFrame([(1, "班级成员表"), (2, "班级成员表")], "doc_id long, document_type string")
    got = spark.createDataFrame([(1, "class", "软升001"), (1, "class", "软升001"), (1, "name", "")], "doc_id long, field_name string, field_value string")
    rows = fields.fail_analysis(fields.expected_fields(typed), got)
    assert {r.doc_id: r.missing for r in rows.collect()} == {1: ["gender", "name"], 2: ["class", "gender", "name"]}
    assert _plan(rows).count("posexplode") == 1


def test_tables_and_types_are_kept_where_read_twice(spark, sf):
    from docloom.plans import queries

    assert "regexp_extract_all" not in _plan(queries.d4_format_tables(spark, sf))


def test_rules_without_their_words_are_not_run(spark):
    """A rule's match is only looked for where its words stand; values are repaired once and not at all where they are null."""
    docs = spark.createDataFrame([(1, "姓名 王小明 学号：12345678 手机：13800000000 E-mail: a@b.cn 请假离校原因：病了"), (2, "QQ 12345 微信号：bAAAA 贷款年度2024 家长姓名李四"), (3, "无"), (4, None)], "doc_id long, text string")
    rows = entities.extract_entities(docs)
    found = {(r.doc_id, r.type, r.text) for r in rows.collect()}
    assert {(1, "PERSON", "王小明"), (1, "STUDENT_ID", "12345678"), (1, "PHONE", "13800000000"), (1, "EMAIL", "a@b.cn"), (1, "LEAVE_REASON", "病了"), (2, "QQ", "12345"), (2, "WECHAT", "bAAAA"), (2, "LOAN_YEAR", "2024"), (2, "PARENT_NAME", "李四")} <= found
    assert not [f for f in found if f[0] == 4]
    plan = _plan(entities.extract_entities(docs, ["LOAN_AMOUNT"]))
    assert "Contains(" in plan or "contains(" in plan.lower()
    details = spark.createDataFrame(
        [(1, 0, "a", "TEXT", "姓 名", 0.9), (1, 1, "b", "DATE", None, 0.0), (1, 2, "c", "ID_NUMBER", "11010519491231002x", 0.9), (1, 3, "d", "TEXT", " ", 0.5), (1, 4, "e", "DATE", "2024年9月1日", 0.7), (1, 5, "f", None, "v", None)],
        "doc_id long, field_ord int, field_name string, field_type string, field_value string, confidence double",
    )
    fixed = shape.fix_fields(details)
    assert [(r.field_value, r.confidence) for r in fixed.orderBy("field_ord").collect()] == [(None, 0.0), ("1949-12-31", 0.6), ("11010519491231002X", 0.9), (None, 0.5), ("2024-09-01", 0.7), ("v", 0.0)]
    assert "isnotnull(field_value" in _plan(fixed).lower()


def test_cards_and_loans_are_dealt_over_tasks(spark, sf):
    from docloom.plans.fixtures import render

    for name in ("cards", "loans"):
        assert render(spark, sf, name).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
