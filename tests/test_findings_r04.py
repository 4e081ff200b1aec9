"""Work of round 4 that is done within the row: same results as the rules by tables, and nothing of it crosses the wire."""

from pyspark.sql import functions as F

from docloom.operators import classify, entities
from docloom.plans import process as flow
from docloom.plans import queries
from docloom.plans.fixtures import render
from docloom.streaming.stream import process_stream

ODD = [
    None, "", "姓名", "身份证 11010519491331002X\n日期：2024年13月45日", "学号：12345678\x01 姓\x02名：王小明", "姓名：王１明 姓名：李四 姓名：姓名 学\x01号：123456",
    "班级成员表 名单 软升001 软升002 软升001", "班级成员表\n0 软升001 王小明 男\n3 软升001 李四五 女\n软升001 李四五 女\n王小明 软升002 男", "成绩单 2024-2025-1 a b 高等数学 4 90 3.5 2024-2025-2 c d 大学英语 3 80 3.0",
    "成绩单\n2024|数学|3|90|A\n2023|语文||80|B-\na  b   c", "成绩单\n2024-2025-1  100001  01  高等数学  必修  4  95  4.0\n2024-2025-2 100002 02 物 4 95 4.0",
    "贷款合同\n专业名称 专业名称软件工程\n学院 计算机科学学院\n地址：安徽省合肥市蜀山区 长江路 1 号\n金额 8000（元）\n期限 3 年\n借款人 贷款金额 500元 贷款",
    "合同 协议 甲方 乙方 签订 助学贷款\n姓名：王五 学院：计算机学院\n开户行：徽商银行\n账号：622200001111\n验证码：12345678\n地址：安徽省合肥市蜀山区长江路1号\n12 年 500（元）\n所在学院 某某大学学院",
    "学籍卡 学籍证明 学籍 学生", "实习协议 三方协议 甲方 乙方 实习", "HTTPS://A.cn 姓名：王小明 安徽大学 贵校学生李四的 2024年9月1日", "证号：XYZ12 班级：\x1c",
]


def _plain(value):
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in sorted(value.items())}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _docs(spark, sf):
    texts = [*ODD, *[r.text for name in ("leave_forms", "rosters", "cards", "loans", "transcripts") for r in render(spark, sf, name).limit(3).collect()]]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def _long(docs):
    """Entities, free classes, types and field details by tables."""
    found, free = entities.normalize_entities(entities.extract_entities(docs, flow.RESPONSE_TYPES)).cache(), classify.classify_free(docs)
    return found, free, flow.document_types(docs, found, free)


def test_types_within_the_row(spark, sf):
    docs = _docs(spark, sf)
    _, free, types = _long(docs)
    wanted = types.join(free.select("doc_id", F.col("document_type").alias("free_type")), "doc_id").select("doc_id", "document_type", "confidence", "probabilities", "free_type")
    rows = flow.typed_rows(docs).select("doc_id", "document_type", "confidence", "probabilities", "free_type")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Window" not in plan
    assert {r.doc_id: _plain(r) for r in rows.collect()} == {r.doc_id: _plain(r) for r in wanted.collect()}


def test_responses_within_the_row(spark, sf):
    docs = _docs(spark, sf)
    found, free, types = _long(docs)
    wanted = flow.respond(docs, found, free, types, flow.base_fields(docs, found, free))
    rows = flow.process(docs)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not any(step in plan for step in ("Join", "Aggregate", "Window", "Sort ", "checkpoint"))
    got, want = ({r.doc_id: _plain(r) for r in x.collect()} for x in (rows, wanted))
    assert got.keys() == want.keys() and rows.columns == wanted.columns
    for k, row in want.items():
        assert got[k] == row, ODD[k] if k < len(ODD) else k


def test_each_row_is_answered(spark):
    docs = spark.createDataFrame([(1, "请假条 姓名：王小明"), (1, "成绩单"), (None, "请假条"), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.document_type) for r in flow.process(docs).select("doc_id", "document_type").collect())
    assert got == [("1", "成绩单"), ("1", "请假条"), ("2", "其他"), ("None", "请假条")]


def test_stream_keeps_nothing_on_the_way(spark, sf, tmp_path, monkeypatch):
    """A micro-batch is answered without a checkpoint of its own."""

    def never(df):
        raise AssertionError("a checkpoint was made")

    monkeypatch.setattr(flow, "cut", never)
    render(spark, sf, "leave_forms").limit(5).write.parquet(str(tmp_path / "in"))
    process_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r.document_type for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"请假条"}


def test_types_are_picked_without_a_checkpoint(spark, sf, monkeypatch):
    def never(df):
        raise AssertionError("a checkpoint was made")

    monkeypatch.setattr(flow, "cut", never)
    monkeypatch.setattr(queries.store, "cut", never)
    assert queries.g6_pick_type(spark, sf).columns == ["doc_id", "document_type"]


def test_contract_slots_within_the_row(spark, sf):
    plan = queries.h5_map_loan_contract(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(step in plan for step in ("Join", "Aggregate", "Window", "Union"))
