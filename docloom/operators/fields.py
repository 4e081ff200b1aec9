"""Fields: templates, expectations, proofs, loan contracts, validation and summaries."""

from __future__ import annotations

import re
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import packs
from docloom.functions import scalars as S
from docloom.functions.predicates import clean_kv_value
from docloom.operators.entities import first_entity
from docloom.operators.lines import kept, let, step
from docloom.operators.tables import class_of, sample_of

ENTITY_TYPES = {kind for kind, *_ in packs.ENTITY_RULES}

# Fields expected of each document type (name, type, description).
EXPECTED: dict[str, list[tuple[str, str, str]]] = {
    "成绩单": [("semester", "TEXT", "学年/学期"), ("course_name", "TEXT", "课程名称"), ("credit", "NUMBER", "学分"), ("score", "NUMBER", "成绩"), ("gpa", "NUMBER", "平均绩点"), ("stat_date", "DATE", "统计时间")],
    "贫困证明": [("applicant_name", "PERSON", "申请人姓名"), ("id_number", "ID_NUMBER", "身份证号"), ("address", "ADDRESS", "家庭住址"), ("issuer", "ORG", "发证单位"), ("issue_date", "DATE", "出具日期"), ("reason", "TEXT", "困难原因")],
    "班级成员表": [("class", "CLASS", "班级"), ("name", "PERSON", "姓名"), ("gender", "TEXT", "性别")],
    "奖学金证明": [("applicant_name", "PERSON", "获奖人姓名"), ("id_number", "ID_NUMBER", "身份证号"), ("school", "ORG", "学校"), ("college", "ORG", "学院"), ("major", "TEXT", "专业"), ("scholarship_name", "TEXT", "奖学金名称"), ("scholarship_amount", "NUMBER", "奖学金金额"), ("issue_date", "DATE", "出具日期"), ("issuer", "ORG", "出具单位")],
    "在校证明": [("student_name", "PERSON", "学生姓名"), ("student_id", "STUDENT_ID", "学号"), ("school", "ORG", "学校"), ("college", "ORG", "学院"), ("major", "TEXT", "专业"), ("class", "CLASS", "班级"), ("enroll_date", "DATE", "入学日期"), ("expected_grad_date", "DATE", "预计毕业日期"), ("status", "TEXT", "学籍状态"), ("issue_date", "DATE", "出具日期")],
    "学籍信息卡": [("student_name", "PERSON", "姓名"), ("student_id", "STUDENT_ID", "学号"), ("class", "CLASS", "班级"), ("major", "TEXT", "专业"), ("school", "ORG", "学校"), ("college", "ORG", "学院"), ("status", "TEXT", "学籍状态")],
    "毕业证书/学历证书": [("name", "PERSON", "姓名"), ("gender", "TEXT", "性别"), ("birth_date", "DATE", "出生日期"), ("school_name", "ORG", "学校名称"), ("college", "ORG", "学院/系所"), ("major", "TEXT", "专业"), ("degree_level", "TEXT", "学历层次"), ("education_type", "TEXT", "学历类别"), ("study_mode", "TEXT", "学习形式/学制"), ("enroll_date", "DATE", "入学日期"), ("expected_grad_date", "DATE", "毕业/结业日期"), ("certificate_id", "CERT_ID", "证书编号"), ("issue_date", "DATE", "证书签发日期")],
    "生源地助学贷款合同": [("name", "PERSON", "借款人姓名"), ("id_number", "ID_NUMBER", "身份证号"), ("address", "ADDRESS", "家庭住址"), ("school_name", "ORG", "学校"), ("college", "ORG", "学院"), ("major", "TEXT", "专业"), ("loan_amount", "NUMBER", "贷款金额"), ("loan_years", "NUMBER", "贷款年限"), ("bank_name", "ORG", "贷款银行"), ("account_number", "NUMBER", "贷款/还款账号"), ("contract_id", "CERT_ID", "合同编号"), ("issue_date", "DATE", "签订日期")],
    "贷款合同": [("name", "PERSON", "借款人姓名"), ("id_number", "ID_NUMBER", "身份证号"), ("loan_amount", "NUMBER", "贷款金额"), ("loan_years", "NUMBER", "贷款年限"), ("bank_name", "ORG", "贷款银行"), ("account_number", "NUMBER", "账号"), ("contract_id", "CERT_ID", "合同编号"), ("issue_date", "DATE", "签订日期")],
    "收入证明": [("name", "PERSON", "姓名"), ("id_number", "ID_NUMBER", "身份证号"), ("employer", "ORG", "单位"), ("income", "NUMBER", "月/年收入"), ("issue_date", "DATE", "开具日期")],
    "请假条": [("name", "PERSON", "请假人姓名"), ("leave_type", "TEXT", "假期类型"), ("start_date", "DATE", "开始日期"), ("end_date", "DATE", "结束日期"), ("days", "NUMBER", "天数"), ("reason", "TEXT", "请假原因"), ("approver", "PERSON", "批准人")],
    "休学申请": [("name", "PERSON", "申请人"), ("id_number", "ID_NUMBER", "身份证"), ("student_id", "STUDENT_ID", "学号"), ("reason", "TEXT", "休学原因"), ("start_date", "DATE", "休学开始"), ("end_date", "DATE", "休学结束")],
    "通知": [("title", "TEXT", "通知标题"), ("issuer", "ORG", "发布单位"), ("date", "DATE", "发布日期"), ("content", "TEXT", "通知内容")],
    "录取凭证": [("candidate_name", "PERSON", "姓名"), ("exam_id", "TEXT", "准考证号"), ("admit_school", "ORG", "录取学校"), ("major", "TEXT", "专业"), ("admit_date", "DATE", "录取日期")],
    "课程表": [("student_name", "PERSON", "姓名"), ("class", "CLASS", "班级"), ("week", "TEXT", "周次"), ("course_slot", "TEXT", "课程安排")],
    "会议纪要": [("meeting_title", "TEXT", "会议主题"), ("meeting_date", "DATE", "会议日期"), ("attendees", "TEXT", "参会人员"), ("summary", "TEXT", "会议摘要")],
    "合同": [("party_a", "ORG", "甲方"), ("party_b", "ORG", "乙方"), ("sign_date", "DATE", "签订日期"), ("amount", "NUMBER", "金额")],
}
EXPECTED_OTHERWISE = [("name", "PERSON", "姓名"), ("id_number", "ID_NUMBER", "证件号/身份证号"), ("issuer", "ORG", "发证/发布单位"), ("date", "DATE", "日期"), ("reason", "TEXT", "原因/说明")]


def expected_lists(typed: DataFrame) -> DataFrame:
    """``(doc_id, r)`` for ``typed(doc_id, document_type)``: all fields of :func:`expected_fields` of a document as one array, sorted."""
    # Types are gathered, one short row a document, and not the fields that each stands for.
    kinds = typed.groupBy("doc_id").agg(F.collect_list(F.coalesce("document_type", F.lit(""))).alias("k"))

    def listed(wanted: list[tuple[str, str, str]]) -> Column:
        names = ("field_ord", "field_name", "field_type", "description")
        return F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, (k, *w))]) for k, w in enumerate(wanted)])

    table = F.create_map(*[x for kind, wanted in EXPECTED.items() for x in (F.lit(kind), listed(wanted))])
    every = F.flatten(F.transform("k", lambda kind: F.coalesce(F.try_element_at(table, kind), listed(EXPECTED_OTHERWISE))))
    return kinds.select("doc_id", F.array_sort(every).alias("r"))


def expected_fields(typed: DataFrame) -> DataFrame:
    """``(doc_id, document_type, field_ord, field_name, field_type, description)`` for ``typed(doc_id, document_type)``."""
    spark: SparkSession = typed.sparkSession
    kind = "array<struct<field_name:string,field_type:string,description:string>>"
    table = spark.createDataFrame(list(EXPECTED.items()), f"document_type string, wanted {kind}")
    otherwise = F.array(*[F.struct(F.lit(n).alias("field_name"), F.lit(t).alias("field_type"), F.lit(d).alias("description")) for n, t, d in EXPECTED_OTHERWISE])
    joined = typed.select("doc_id", "document_type").join(F.broadcast(table), "document_type", "left")
    rows = joined.select("doc_id", "document_type", F.posexplode(F.coalesce("wanted", otherwise)).alias("field_ord", "f"))
    return rows.select("doc_id", "document_type", "field_ord", "f.*")


def fail_analysis(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """``(doc_id, missing)``: expected names without an extracted value, sorted."""
    # Both sides are gathered to a row a document first: each is made once, and one row a document is joined.
    got = extracted.where(F.coalesce(F.col("field_value") != "", F.lit(False))).groupBy("doc_id").agg(F.collect_set("field_name").alias("__got"))
    wanted = expected.groupBy("doc_id").agg(F.array_sort(F.collect_list("field_name")).alias("__wanted"))
    lost = F.filter("__wanted", lambda name: ~F.array_contains(F.coalesce("__got", F.array().cast("array<string>")), name))
    return wanted.join(got, "doc_id", "left").select("doc_id", lost.alias("missing"))


def template_from_expected(expected: DataFrame) -> DataFrame:
    """``(doc_id, template_id, fields)``: an automatic template out of the expected fields."""
    field = F.struct("field_ord", F.col("field_name").alias("name"), F.col("field_type").alias("type"), "description")
    grouped = expected.groupBy("doc_id", "document_type").agg(F.array_sort(F.collect_list(field)).alias("f"))
    made = F.transform("f", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["description"].alias("description"), F.lit(False).alias("required"), F.array().cast("array<string>").alias("patterns")))
    return grouped.select("doc_id", F.concat(F.lit("auto-"), "document_type").alias("template_id"), made.alias("fields"))


def valid_patterns(patterns: list[str]) -> list[str]:
    """The patterns that compile; others are dropped with a warning, as a bad pattern would fail the whole job."""
    kept = []
    for p in patterns:
        try:
            re.compile(p)
            kept.append(p)
        except re.error as error:
            warnings.warn(f"pattern {p!r} is left out: {error}", stacklevel=2)
    return kept


_NO_POSITION = "struct<start:int,end:int,context:string>"


def _first_match(text: Column, patterns: list[str]) -> Column:
    """``struct(value, position)`` of the first pattern that matches, null if none does."""
    tries = []
    for p in valid_patterns(patterns):
        groups = re.compile(p).groups
        java = f"(?iU){p}"
        whole, value = F.regexp_extract(text, java, 0), S.trimmed(F.regexp_extract(text, java, 1 if groups else 0))
        # The match's place: what stands before the first match is as long as the text's part up to it.
        start = (F.regexp_instr(text, F.lit(java)) - 1).cast("int")
        end = (start + F.length(whole)).cast("int")
        at = F.greatest(start - 20, F.lit(0))
        position = F.struct(start.alias("start"), end.alias("end"), F.substr(text, at + 1, end + 20 - at).alias("context"))
        tries.append(F.when(text.rlike(java), F.struct(value.alias("value"), position.alias("position"))))
    return F.coalesce(*tries) if tries else F.lit(None).cast(f"struct<value:string,position:{_NO_POSITION}>")


def extract_fields(docs: DataFrame, template: dict, entities: DataFrame | None = None) -> DataFrame:
    """``(doc_id, field_ord, field_name, field_type, field_value, confidence, source_position, validation)`` by a template.

    A field takes its first pattern that matches (0.9); a required person, organisation or date without one
    takes the document's first entity of that type (0.85). A value that fails validation has half its confidence.
    """
    specs = template.get("fields") or []
    made = []
    for k, f in enumerate(specs):
        made.append(
            F.struct(
                F.lit(k).alias("field_ord"), F.lit(f["name"]).alias("field_name"), F.lit(f["type"]).alias("field_type"),
                F.lit(bool(f.get("required"))).alias("required"), _first_match(F.col("text"), f.get("patterns") or []).alias("hit"),
            )
        )
    rows = docs.select("doc_id", F.inline(F.array(*made)))
    value, position, confidence = F.col("hit.value"), F.col("hit.position"), F.when(F.col("hit").isNotNull(), 0.9)
    if entities is not None:
        first = entities.groupBy("doc_id", F.col("type").alias("field_type")).agg(
            F.min_by(F.struct(F.col("text").alias("value"), F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(None).cast("string").alias("context")).alias("position")), F.struct("rule", "ord")).alias("ner")
        )
        rows = rows.join(first, ["doc_id", "field_type"], "left")
        may = F.col("hit").isNull() & F.col("required") & F.col("field_type").isin("PERSON", "ORG", "DATE")
        value = F.when(may, F.col("ner.value")).otherwise(value)
        position = F.when(may, F.col("ner.position")).otherwise(position)
        confidence = F.when(may & F.col("ner").isNotNull(), 0.85).otherwise(confidence)
    rows = rows.select("doc_id", "field_ord", "field_name", "field_type", value.alias("field_value"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"), position.alias("source_position"))
    return validate_fields(rows, {f["name"]: f.get("validation") or {} for f in specs})


def validate_fields(fields: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """``fields`` with ``validation`` struct(is_valid, message); the first failed check counts and halves the confidence."""
    v = F.col("field_value")

    def checks(rule: dict) -> Column:
        c = F.when(v.isNull(), "Value not found")
        if "pattern" in rule:
            c = c.when(~v.rlike(f"(?U)^(?:{rule['pattern']})"), f"Value does not match pattern: {rule['pattern']}")
        if "min_length" in rule:
            c = c.when(F.length(v) < rule["min_length"], f"Value too short (min: {rule['min_length']})")
        if "max_length" in rule:
            c = c.when(F.length(v) > rule["max_length"], f"Value too long (max: {rule['max_length']})")
        number = F.col("field_type") == "NUMBER"
        c = c.when(number & v.try_cast("double").isNull(), "Invalid numeric value")
        if "min" in rule:
            c = c.when(number & (v.try_cast("double") < rule["min"]), f"Value below minimum ({rule['min']})")
        if "max" in rule:
            c = c.when(number & (v.try_cast("double") > rule["max"]), f"Value above maximum ({rule['max']})")
        if "enum" in rule:
            c = c.when(~v.isin(*rule["enum"]), f"Value not in allowed list: {rule['enum']}")
        return c

    message = F.coalesce(*[F.when(F.col("field_name") == name, checks(rule)) for name, rule in rules.items()], F.when(v.isNull(), "Value not found"))
    out = fields.withColumn("__m", message)
    valid = F.col("__m").isNull()
    return (
        out.withColumn("confidence", F.bround(F.when(valid, F.col("confidence")).otherwise(F.col("confidence") * 0.5), 4))
        .withColumn("validation", F.struct(valid.alias("is_valid"), F.coalesce("__m", F.lit("验证通过")).alias("message")))
        .drop("__m")
    )


def _groups(pattern: Column) -> Column:
    """1 if a pattern has a capturing group, else 0; escapes and character classes aside."""
    bare = F.regexp_replace(F.regexp_replace(pattern, r"\\\\.", ""), r"\[[^\]]*\]", "")
    return F.when(bare.rlike(r"\((?!\?)|\(\?P?<[A-Za-z]"), 1).otherwise(0)


def extract_by_templates(docs: DataFrame, templates: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """:func:`extract_fields` where each of ``docs(doc_id, text, template_id)`` names its template in a table of them (see ``load_templates``).

    Fields, patterns and checks are columns of the table, which is joined by id; documents without a known template have no
    rows. Patterns are used as they stand in the table: ``load_templates`` leaves out those that do not compile.
    """
    spec = templates.select("template_id", F.posexplode("fields").alias("field_ord", "f"))
    rows = docs.select("doc_id", "text", "template_id").join(F.broadcast(spec) if spec.count() <= 50_000 else spec, "template_id")
    text, f = F.col("text"), F.col("f")

    def attempt(p: Column) -> Column:
        java = F.concat(F.lit("(?iU)"), p)
        whole, value = F.call_function("regexp_extract", text, java, F.lit(0)), S.trimmed(F.call_function("regexp_extract", text, java, _groups(p)))
        start = (F.regexp_instr(text, java) - 1).cast("int")
        end = (start + F.length(whole)).cast("int")
        at = F.greatest(start - 20, F.lit(0))
        return F.struct(value.alias("value"), F.struct(start.alias("start"), end.alias("end"), F.substr(text, at + 1, end + 20 - at).alias("context")).alias("position"))

    patterns = F.coalesce(f["patterns"], F.array().cast("array<string>"))
    first = F.get(F.filter(patterns, lambda p: F.regexp_like(text, F.concat(F.lit("(?iU)"), p))), F.lit(0))
    # The pattern that matches is found once, behind a generator.
    rows = rows.select("doc_id", "text", "field_ord", "f", F.explode(F.array(first)).alias("p"))
    rows = rows.select("doc_id", "field_ord", "f", F.when(F.col("p").isNotNull(), attempt(F.col("p"))).alias("hit"))
    value, position, confidence, kind = F.col("hit.value"), F.col("hit.position"), F.when(F.col("hit").isNotNull(), 0.9), f["type"]
    rows = rows.withColumn("field_type", kind)
    if entities is not None:
        found = entities.groupBy("doc_id", F.col("type").alias("field_type")).agg(F.min_by(F.struct(F.col("text").alias("value"), F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(None).cast("string").alias("context")).alias("position")), F.struct("rule", "ord")).alias("ner"))
        rows = rows.join(found, ["doc_id", "field_type"], "left")
        may = F.col("hit").isNull() & F.coalesce(f["required"], F.lit(False)) & F.col("field_type").isin("PERSON", "ORG", "DATE")
        value, position = F.when(may, F.col("ner.value")).otherwise(value), F.when(may, F.col("ner.position")).otherwise(position)
        confidence = F.when(may & F.col("ner").isNotNull(), 0.85).otherwise(confidence)
    rows = rows.select("doc_id", "field_ord", f["name"].alias("field_name"), "field_type", value.alias("field_value"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"), position.alias("source_position"), f["validation"].alias("r"))
    v, number, r = F.col("field_value"), F.col("field_value").try_cast("double"), F.col("r")
    numeric = F.col("field_type") == "NUMBER"
    message = (
        F.when(v.isNull(), "Value not found")
        .when(~F.regexp_like(v, F.concat(F.lit("(?U)^(?:"), r["pattern"], F.lit(")"))), F.concat(F.lit("Value does not match pattern: "), r["pattern"]))
        .when(F.length(v) < r["min_length"], F.concat(F.lit("Value too short (min: "), r["min_length"].cast("string"), F.lit(")")))
        .when(F.length(v) > r["max_length"], F.concat(F.lit("Value too long (max: "), r["max_length"].cast("string"), F.lit(")")))
        .when(numeric & number.isNull(), "Invalid numeric value")
        .when(numeric & (number < r["min"]), F.concat(F.lit("Value below minimum ("), r["min"].cast("string"), F.lit(")")))
        .when(numeric & (number > r["max"]), F.concat(F.lit("Value above maximum ("), r["max"].cast("string"), F.lit(")")))
        .when((F.size(r["enum"]) > 0) & ~F.array_contains(r["enum"], v), F.concat(F.lit("Value not in allowed list: "), F.to_json(r["enum"])))
    )
    out = rows.withColumn("m", message)
    return out.select(
        "doc_id", "field_ord", "field_name", "field_type", "field_value", F.bround(F.when(F.col("m").isNull(), F.col("confidence")).otherwise(F.col("confidence") * 0.5), 4).alias("confidence"), "source_position",
        F.struct(F.col("m").isNull().alias("is_valid"), F.coalesce("m", F.lit("验证通过")).alias("message")).alias("validation"),
    )


def summarize_fields(fields: DataFrame) -> DataFrame:
    """``(doc_id, total_fields, extracted_fields, confidence, status)``: mean confidence of fields with a value."""
    has = F.col("field_value").isNotNull()
    return fields.groupBy("doc_id").agg(
        F.count("*").alias("total_fields"),
        F.count_if(has).alias("extracted_fields"),
        F.bround(F.coalesce(F.avg(F.when(has, F.col("confidence"))), F.lit(0.0)), 4).alias("confidence"),
        F.when(F.count_if(has) > 0, "success").otherwise("failed").alias("status"),
    )


# Words of which a pattern's match must hold one. A plain search for them spares most texts the pattern; patterns that are not listed always run.
_MARKS = {
    "姓名[": ("姓名",), "学生姓名": ("学生姓名",), "学号[": ("学号",), "学籍号[": ("学籍号",), "性别[": ("性别",), "出生日期[": ("出生日期",), "学校名称[": ("学校名称",), r"([^\s]{2,30}(?:大学|学院|学校))": ("大学", "学院", "学校"),
    "学院[": ("学院",), "院系名称": ("院系名称",), "专业(?:名称)?[": ("专业",), "学籍状态[": ("学籍状态",), "入学(?:日期|时间)?[": ("入学",), "(?:预计)?毕业(?:日期|时间)?[": ("毕业",),
    "(?:在线验证码|回执验证码|验证码)[": ("验证码",), r"(https?://[^\s]+)": ("://",), "贵校学生[": ("贵校学生",), "身份证号码?": ("身份证号",), "户籍地址": ("户籍地址",), "(?:就读高校|账户名称)": ("就读高校", "账户名称"),
    r"([^\n]{2,30}?(?:大学|学院|学校))\s*[:：]?\s*我行已成功受理": ("我行已成功受理",), "专业名称": ("专业名称",), "[（(]专升本[）)]": ("专升本",), "入学年份": ("入学年份",), "学制": ("学制",), "贷款合同编号": ("贷款合同编号",),
    "用款期限": ("用款期限",), "(?:本次用款金额|贷款金额)": ("本次用款金额", "贷款金额"), "账户名称": ("账户名称",), "账号": ("账号",), "开户行": ("开户行",), "回执验证码[": ("回执验证码",), "([一-龥]+银行[": ("银行",),
}


def _marked(text: Column, pattern: str, value: Column, told: Column | None = None) -> Column:
    """``value``, which a pattern's match gives, null where the text holds none of the pattern's words; ``told`` holds those of ideographs that the text holds."""
    words = next((words for begin, words in sorted(_MARKS.items(), key=lambda m: -len(m[0])) if pattern.startswith(begin)), ())
    tests = [(text if told is None or w == "://" else told).contains(w) for w in words]
    return F.when(reduce(Column.__or__, tests), value) if tests else value


_LOOSE = r"([0-9]{4}[年\-/.][0-9]{1,2}[月\-/.]?[0-9]{0,2}日?)"
# Fields of proofs (name, type, confidence, patterns in order).
PROOF_FIELDS = (
    ("name", "PERSON", 0.95, (r"姓名[:：]?\s*([^\s\n]{2,10})", r"学生姓名[:：]?\s*([^\s\n]{2,10})")),
    ("student_id", "STUDENT_ID", 0.9, (r"学号[:：]?\s*[_\s]*([0-9]{6,12})", r"学籍号[:：]?\s*([0-9]{6,12})")),
    ("gender", "TEXT", 0.85, (r"性别[:：]?\s*([男女])",)),
    ("birth_date", "DATE", 0.8, (r"出生日期[:：]?\s*([0-9]{4}[年\-/.][0-9]{1,2}[月\-/.][0-9]{1,2}日?)",)),
    ("school_name", "ORG", 0.85, (r"学校名称[:：]?\s*([^\n]{2,40})", r"([^\s]{2,30}(?:大学|学院|学校))")),
    ("college", "ORG", 0.8, (r"学院[:：]?\s*([^\n]{2,40})", r"院系名称[:：]?\s*([^\n]{2,40})")),
    ("major", "TEXT", 0.8, (r"专业(?:名称)?[:：]?\s*([^\n]{2,40})",)),
    ("status", "TEXT", 0.75, (r"学籍状态[:：]?\s*([^\s\n]{2,20})",)),
    ("enroll_date", "DATE", 0.75, (rf"入学(?:日期|时间)?[:：]?\s*{_LOOSE}",)),
    ("expected_grad_date", "DATE", 0.75, (rf"(?:预计)?毕业(?:日期|时间)?[:：]?\s*{_LOOSE}",)),
    ("verify_code", "TEXT", 0.7, (r"(?:在线验证码|回执验证码|验证码)[:：]?\s*(\d{4,10})",)),
    ("verify_url", "TEXT", 0.6, (r"(https?://[^\s]+)",)),
)


def _proof(text: Column, kind: str, patterns: tuple[str, ...]) -> Column:
    # Inside a lambda the value found is cleaned without being found again.
    value = F.array(F.coalesce(*[_marked(text, p, F.nullif(F.regexp_extract(text, f"(?iU){p}", 1), F.lit(""))) for p in patterns]))
    clean = (lambda v: F.coalesce(S.normalize_date(v), v)) if kind == "DATE" else clean_kv_value
    return F.get(F.transform(value, clean), F.lit(0))


def proof_fields(docs: DataFrame) -> DataFrame:
    """``(doc_id, field_ord, field_name, field_type, field_value, confidence)``: twelve fields of proofs of study, dates in normal form."""
    made = []
    for k, (name, kind, confidence, patterns) in enumerate(PROOF_FIELDS):
        value = _proof(F.col("text"), kind, patterns)
        made.append(F.struct(F.lit(k).alias("field_ord"), F.lit(name).alias("field_name"), F.lit(kind).alias("field_type"), value.alias("field_value"), F.lit(confidence).alias("confidence")))
    return docs.select("doc_id", F.inline(F.array(*made)))


_SCHOOL = "大学|学院|学校"
# Fields of student loan contracts (name, confidence, patterns in order).
LOAN_FIELDS = (
    ("name", 0.95, (r"学生姓名\s*([^\s\n]{2,10})", r"贵校学生[_\s]*([^\s_]{2,10})[_\s]*的")),
    ("id_number", 0.95, (r"身份证号码?\s*(\d{17}[\dXx])",)),
    ("address", 0.9, (r"户籍地址\s*([^\n]{5,50}?)(?=\s*就学信息|\s*贷款信息|\n|$)",)),
    ("school_name", 0.9, (rf"(?:就读高校|账户名称)\s*([^\n]{{2,30}}?(?:{_SCHOOL}))", rf"([^\n]{{2,30}}?(?:{_SCHOOL}))\s*[:：]?\s*我行已成功受理")),
    ("college", 0.9, (r"院系名称\s*([^\n]{2,30}?(?:学院|系|部))",)),
    ("major", 0.9, (r"专业名称\s*([^\n]{2,30})", r"[（(]专升本[）)]\s*([^\n\s]{2,20})")),
    ("enroll_year", 0.9, (r"入学年份\s*(\d{4})",)),
    ("study_years", 0.9, (r"学制\s*(\d+)\s*年?",)),
    ("contract_id", 0.9, (r"贷款合同编号\s*(\d{10,20})",)),
    ("loan_term_months", 0.9, (r"用款期限\s*(\d+)\s*[（\(]?月[）\)]?",)),
    ("loan_amount", 0.95, (r"(?:本次用款金额|贷款金额)\s*(\d+(?:\.\d+)?)\s*[（\(]?元[）\)]?",)),
    ("account_name", 0.85, (rf"账户名称\s*([^\n]{{2,30}}?(?:{_SCHOOL}))",)),
    ("account_number", 0.9, (r"账号\s*(\d{6,25})",)),
    ("bank_name", 0.9, (r"开户行\s*([^\n]{5,50}?(?:银行|支行|分行))",)),
    ("verify_code", 0.95, (r"回执验证码[为是]?[:：]?\s*(\d{4,10})",)),
    ("issue_date", 0.85, (r"(\d{4}[-年]\d{1,2}[-月]\d{1,2}日?)(?:\s*$|\s*\n)",)),
    ("issuer_bank", 0.85, (r"([一-龥]+银行[一-龥]*(?:支行|分行))",)),
)
LOAN_WORDS = "生源地助学贷款|助学贷款|贷款合同编号|用款期限"


def loan_contract_fields(docs: DataFrame) -> DataFrame:
    """``(doc_id, field_ord, field_name, field_value, confidence, source_text)`` of the loan fields found."""
    t = F.col("text")
    made = []
    for k, (name, confidence, patterns) in enumerate(LOAN_FIELDS):
        value = F.coalesce(*[_marked(t, p, S.found(t, f"(?U){p}")) for p in patterns])
        source = F.coalesce(*[_marked(t, p, S.found(t, f"(?U){p}", 0)) for p in patterns])
        value = _loan_value(name, S.trimmed(value))
        made.append(F.when(value.isNotNull(), F.struct(F.lit(k).alias("field_ord"), F.lit(name).alias("field_name"), value.alias("field_value"), F.lit(confidence).alias("confidence"), source.alias("source_text"))))
    return docs.select("doc_id", kept(F.array_compact(F.array(*made))).alias("f")).select("doc_id", F.inline("f"))


# What a field's type looks like anywhere in a text.
TYPE_PATTERNS = {
    "ID_NUMBER": r"\b(\d{17}[\dXx])\b",
    "STUDENT_ID": r"(?:学号|学籍号)[:：]?\s*([A-Za-z0-9]{6,20})",
    "DATE": r"(\d{4}[年\-\.\/]\d{1,2}[月\-\.\/]?\d{0,2}日?)",
    "PHONE": r"(1[3-9]\d{9})",
    "NUMBER": r"(\d+(?:\.\d+)?)",
}


def loose_fields(docs: DataFrame, expected: DataFrame, samples: DataFrame) -> DataFrame:
    """``(doc_id, field_ord, field_name, field_value, confidence, source_text, reasoning)`` for every expected field.

    In order: a loan contract's own rule, the roster's first triple (0.82), a person's keyword (0.85), a date (0.82), the line after
    the field's description (0.8), the type's pattern (0.75), loose digits (0.6).
    """
    loans = loan_contract_fields(docs.where(F.col("text").rlike(LOAN_WORDS))).select("doc_id", "field_name", F.struct(F.col("field_value").alias("v"), "confidence", F.col("source_text").alias("s"), F.lit("助学贷款专项提取").alias("why")).alias("loan"))
    rows = expected.join(docs.select("doc_id", "text"), "doc_id").join(loans, ["doc_id", "field_name"], "left").join(samples.select("doc_id", F.struct("class", "name", "gender").alias("r")), "doc_id", "left")
    t, name, kind = F.col("text"), F.col("field_name"), F.col("field_type")

    def hit(value: Column, confidence: float, source: Column, why: str) -> Column:
        return F.when(value.isNotNull(), F.struct(value.alias("v"), F.lit(confidence).alias("confidence"), source.alias("s"), F.lit(why).alias("why")))

    sample = F.when(name.isin("class", "班级"), F.col("r.class")).when(name.isin("name", "姓名", "student_name"), F.col("r.name")).when(name.isin("gender", "性别"), F.col("r.gender"))
    person = r"(?U)(?:姓名|学生|申请人|联系人)[:：]?\s*([A-Za-z一-龥]{2,10})"
    date = f"(?U){TYPE_PATTERNS['DATE']}"
    caption = F.coalesce(F.nullif("description", F.lit("")), name)
    # A pattern out of a column is made anew for each row: only texts that hold the caption need it.
    line = F.when(F.contains(t, caption), F.concat(F.lit(r"(?U)\Q"), caption, F.lit(r"\E[:：]?\s*([^\n\r]+)")))
    digits = r"(?U)(\d[\dXx\s]{10,20})"
    packed = F.regexp_replace(F.regexp_extract(t, digits, 1), r"(?U)\s", "")
    typed = F.coalesce(*[F.when(kind == k, hit(S.trimmed(S.found(t, f"(?U){p}")), 0.75, S.found(t, f"(?U){p}", 0), "模式匹配")) for k, p in TYPE_PATTERNS.items()])
    best = F.coalesce(
        F.col("loan"),
        hit(sample, 0.82, F.lit("roster-sample"), "名单行三元组"),
        F.when(kind == "PERSON", hit(S.found(t, person), 0.85, S.found(t, person, 0), "姓名关键词匹配")),
        F.when(kind == "DATE", hit(S.normalize_date(S.found(t, date)), 0.82, S.found(t, date, 0), "日期标准化")),
        hit(F.nullif(S.trimmed(F.call_function("regexp_extract", t, line, F.lit(1))), F.lit("")), 0.8, F.call_function("regexp_extract", t, line, F.lit(0)), "关键词行匹配"),
        typed,
        F.when(kind.isin("ID_NUMBER", "STUDENT_ID", "PHONE"), hit(F.when(F.length(packed) >= 11, packed), 0.6, S.found(t, digits, 0), "宽松数字提取")),
    )
    rows = rows.withColumn("b", best)
    return rows.select("doc_id", "field_ord", "field_name", F.col("b.v").alias("field_value"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("b.s", F.lit("")).alias("source_text"), F.coalesce("b.why", F.lit("未匹配到明确来源")).alias("reasoning"))


# Candidate fields when no template is given (name, type, keywords in order).
INFERRED = (
    ("name", "PERSON", ("姓名", "学生", "申请人", "联系人")),
    ("id_number", "ID_NUMBER", ("身份证", "证件号码", "身份证号", "证号")),
    ("student_id", "STUDENT_ID", ("学号", "学生编号", "学籍号")),
    ("address", "ADDRESS", ("家庭住址", "住址", "地址")),
    ("issuer", "ORG", ("发证单位", "发证机关", "盖章单位")),
    ("admission_school", "ORG", ("录取学校", "录取院校", "录取单位")),
    ("date", "DATE", ("日期", "时间", "填表日期")),
    ("reason", "TEXT", ("原因", "说明", "事由", "申请事项")),
    ("certificate_id", "CERT_ID", ("证件编号", "编号", "证号")),
    ("class", "CLASS", ("班级", "班级名称")),
    ("contact", "PERSON", ("联系人", "家长")),
    ("phone", "PHONE", ("电话", "联系方式", "手机号")),
)
# What a type looks like where neither keyword nor entity tells (pattern, confidence).
INFERRED_BY_SHAPE = {
    "ID_NUMBER": (r"\b(\d{17}[\dXx])\b", 0.9),
    "CERT_ID": (r"(?:证件编号|编号|证号)[:：]?\s*([A-Za-z0-9\-]{4,30})", 0.85),
    "CLASS": (r"(?:班级|班)[:：]?\s*([A-Za-z0-9一-龥\-]{2,20})", 0.8),
}


def _matched(text: Column, pattern: str, confidence: float, width: int) -> Column:
    """As :func:`_placed`, but the place is that of the whole match."""
    return _placed(text, pattern, confidence, width, whole_match=True)


def _placed(text: Column, pattern: str, confidence: float, width: int, whole_match: bool = False) -> Column:
    """``struct(value, confidence, source_position)`` of a pattern's group 1, which ends the match, null without one.

    The text is searched once; the rest is read off the match, inside a lambda, which keeps the generated code short.
    """

    def place(whole: Column) -> Column:
        value = F.regexp_extract(whole, pattern, 1)
        end = F.position(whole, text) - 1 + F.length(whole)
        start = end - F.length(whole if whole_match else value)
        at = F.greatest(start - width, F.lit(0))
        place = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.substr(text, at + 1, end + width - at).alias("context"))
        return F.when(whole != "", F.struct(S.trimmed(value).alias("value"), F.lit(confidence).alias("confidence"), place.alias("source_position")))

    return F.get(F.transform(F.array(F.regexp_extract(text, pattern, 0)), place), F.lit(0))


def keyword_pattern(keyword: str) -> str:
    """A keyword and the rest of its line; the value must hold more than white space."""
    return rf"(?iU){keyword}[:：]?\s*(\S[^\n\r]*)"


def infer_fields(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """``(doc_id, field_ord, field_name, field_type, field_value, confidence, source_position)`` without a template.

    Twelve candidates: the rest of a keyword's line (0.9), else the document's first entity of the type (0.8), else the type's shape.
    What :func:`proof_fields` finds under a candidate's name overrides value and confidence; its other fields follow.
    """
    t, seen = F.col("text"), F.col("__first")
    kinds = [k for k in dict.fromkeys(kind for _, kind, _ in INFERRED) if k in ENTITY_TYPES]
    one = F.struct(F.col("text").alias("value"), F.lit(0.8).alias("confidence"), F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(None).cast("string").alias("context")).alias("source_position"))
    order = F.struct("rule", "ord")
    first = entities.where(F.col("type").isin(*kinds)).groupBy("doc_id").agg(
        F.struct(*[F.min_by(F.when(F.col("type") == k, one), F.when(F.col("type") == k, order)).alias(k) for k in kinds]).alias("__first")
    )
    proofs = {name: (kind, confidence, _proof(t, kind, patterns)) for name, kind, confidence, patterns in PROOF_FIELDS}
    no_place = F.lit(None).cast(_NO_POSITION)
    made = []
    for k, (name, kind, words) in enumerate(INFERRED):
        tries = [F.when(t.contains(w), _placed(t, keyword_pattern(w), 0.9, 15)) for w in words]
        tries += [seen[kind]] if kind in kinds else []
        if kind in INFERRED_BY_SHAPE:
            pattern, confidence = INFERRED_BY_SHAPE[kind]
            tries.append(_placed(t, f"(?U){pattern}", confidence, 10))
        proof, sure = (proofs[name][2], proofs[name][1]) if name in proofs else (F.lit(None).cast("string"), 0.0)
        made.append(F.struct(F.lit(k).alias("field_ord"), F.lit(name).alias("field_name"), F.lit(kind).alias("field_type"), F.coalesce(*tries).alias("hit"), proof.alias("proof"), F.lit(sure).alias("sure")))
    names = {name for name, _, _ in INFERRED}
    empty = F.lit(None).cast(f"struct<value:string,confidence:double,source_position:{_NO_POSITION}>")
    for name, (kind, confidence, value) in proofs.items():
        if name not in names:
            made.append(F.struct(F.lit(len(made)).alias("field_ord"), F.lit(name).alias("field_name"), F.lit(kind).alias("field_type"), empty.alias("hit"), value.alias("proof"), F.lit(confidence).alias("sure")))
    # Inlined in two steps, so that each value is made once.
    rows = docs.select("doc_id", "text").join(first, "doc_id", "left").select("doc_id", F.inline(F.array(*made)))
    appended = ~F.col("field_name").isin(*names)
    return rows.select(
        "doc_id",
        "field_ord",
        "field_name",
        "field_type",
        F.coalesce("proof", "hit.value").alias("field_value"),
        F.when(F.col("proof").isNotNull() | appended, F.col("sure")).otherwise(F.coalesce("hit.confidence", F.lit(0.0))).alias("confidence"),
        F.coalesce("hit.source_position", no_place).alias("source_position"),
    )


def _plain(pattern: str) -> str:
    """The pattern with its flags. Where it names no letters, upper and lower case are the same, and told apart faster."""
    letters = re.search("[A-Za-z]", re.sub(r"\\[a-z]|\(\?:", "", pattern))
    return f"(?iU){pattern}" if letters else f"(?U){pattern}"


def inferred_names() -> list[tuple[str, str]]:
    """``(name, type)`` of the fields of :func:`infer_fields` in order."""
    known = [(name, kind) for name, kind, _ in INFERRED]
    return known + [(name, kind) for name, kind, *_ in PROOF_FIELDS if name not in dict(known)]


def inferred(docs: DataFrame, entities: dict[str, str], types: list[str], wanted: Column) -> DataFrame:
    """``docs`` with a column ``f <name>`` of ``(v, c)``, value and confidence, for each field of :func:`infer_fields`, made within the row.

    Entities of ``types`` count: ``entities`` names columns for the first one of a type, others are looked for in the column ``__clean``.
    ``wanted``: documents that need the fields, they are null in others. Words are looked for in the column ``__told`` (see ``typed``).
    """
    t, told, proofs = F.col("text"), F.col("__told"), {name: (kind, sure, patterns) for name, kind, sure, patterns in PROOF_FIELDS}
    raw = {f"__p {name}": F.when(wanted, F.coalesce(*[_marked(t, p, F.nullif(F.regexp_extract(t, _plain(p), 1), F.lit("")), told) for p in patterns])) for name, (_, _, patterns) in proofs.items()}
    rows = step(docs, raw)

    def clean(name: str) -> Column:
        v = F.col(f"`__p {name}`")
        return F.when(v.isNotNull(), F.coalesce(S.normalize_date(v), v) if proofs[name][0] == "DATE" else clean_kv_value(v))

    rows = step(rows, {f"__q {name}": clean(name) for name in proofs}, docs.columns)

    def said(pattern: str, confidence: float) -> Column:
        value = F.regexp_extract(t, pattern, 1)
        return F.when(value != "", F.struct(S.trimmed(value).alias("v"), F.lit(confidence).alias("c")))

    hints = {name: (kind, words) for name, kind, words in INFERRED}
    made = {}
    for name, kind in inferred_names():
        sure = proofs[name][1] if name in proofs else 0.0
        tries = []
        if name in proofs:
            proof = F.col(f"`__q {name}`")
            tries.append(F.when(proof.isNotNull(), F.struct(proof.alias("v"), F.lit(sure).alias("c"))))
        for w in hints[name][1] if name in hints else ():
            tries.append(F.when(told.contains(w), said(_plain(keyword_pattern(w).removeprefix("(?iU)")), 0.9)))
        if name in hints and kind in types:
            first = F.col(entities[kind]) if kind in entities else first_entity(F.col("__clean"), kind)
            tries.append(F.when(first.isNotNull(), F.struct(first.alias("v"), F.lit(0.8).alias("c"))))
        if name in hints and kind in INFERRED_BY_SHAPE:
            pattern, confidence = INFERRED_BY_SHAPE[kind]
            words = {"CERT_ID": ("编号", "证号"), "CLASS": ("班",)}.get(kind)
            shape = said(f"(?U){pattern}", confidence)
            tries.append(F.when(reduce(Column.__or__, [told.contains(w) for w in words]), shape) if words else shape)
        none = F.struct(F.lit(None).cast("string").alias("v"), F.lit(0.0 if name in hints else sure).alias("c"))
        made[f"f {name}"] = F.when(wanted, F.coalesce(*tries, none))
    return step(rows, made, docs.columns)


def loan_columns(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``l <name>`` of ``(v, c)`` for each field of :func:`loan_contract_fields`, null where it is not found or no loan is spoken of."""
    t, told = F.col("text"), F.col("__told")
    # The longest word holds another one.
    words = LOAN_WORDS.split("|")
    loan = reduce(Column.__or__, [told.contains(w) for w in words if not any(o != w and o in w for o in words)])
    raw = {f"__l {name}": F.when(loan, S.trimmed(F.coalesce(*[_marked(t, p, S.found(t, f"(?U){p}"), told) for p in patterns]))) for name, _, patterns in LOAN_FIELDS}
    rows = step(docs, raw)
    made = {}
    for name, confidence, _ in LOAN_FIELDS:
        value = _loan_value(name, F.col(f"`__l {name}`"))
        made[f"l {name}"] = F.when(value.isNotNull(), F.struct(value.alias("v"), F.lit(confidence).alias("c")))
    return step(rows, made, docs.columns)


def _loan_value(name: str, value: Column) -> Column:
    if name == "major":
        return F.nullif(S.trimmed(F.regexp_replace(value, "贷款信息.*", "")), F.lit(""))
    if name == "issue_date":
        return S.normalize_date(value)
    if name == "loan_amount":
        return value.cast("double").cast("string")
    return value


def inferred_template() -> dict:
    """The template that :func:`infer_fields` stands for, to be used again."""
    fields = [{"name": n, "type": kind, "required": False, "patterns": [rf"{w}[:：]?\s*([^\n\r]+)" for w in words], "description": f"自动推断字段: {n}"} for n, kind, words in INFERRED]
    known = {n for n, _, _ in INFERRED}
    fields += [{"name": n, "type": kind, "required": False, "patterns": [], "description": f"自动推断字段: {n}"} for n, kind, _, _ in PROOF_FIELDS if n not in known]
    return {"template_id": "auto-generated-from-doc", "fields": fields}


# The fields of a roster's own template (name, type, pattern, description) and what a roster calls itself.
ROSTER_FIELDS = (
    ("class", "CLASS", r"班级[:：]?\s*([A-Za-z0-9一-龥]{2,12})", "班级"),
    ("name", "PERSON", r"姓名[:：]?\s*([A-Za-z一-龥]{2,6})", "姓名"),
    ("gender", "TEXT", r"性别[:：]?\s*(男|女)", "性别"),
)
ROSTER_HINT = "班级成员表|成员名单|班级名单"


def roster_template() -> dict:
    """The template that :func:`infer_roster_fields` stands for, to be used again."""
    return {"template_id": "auto-roster", "fields": [{"name": n, "type": kind, "required": False, "patterns": [p], "description": about} for n, kind, p, about in ROSTER_FIELDS]}


def roster_columns(docs: DataFrame, members: str, wanted: Column) -> DataFrame:
    """``docs`` with a column ``r <name>`` of ``(v, c)`` for each field of :func:`infer_roster_fields`, null in documents that are not ``wanted`` or have none.

    ``members`` names the array of members (see ``members_of``).
    """
    t, first = F.col("text"), F.get(members, F.lit(0))
    # A null text has neither members nor a hint.
    listed = F.coalesce(wanted & ((F.size(members) > 0) | t.rlike(ROSTER_HINT)), F.lit(False))
    triple = F.coalesce(F.when(first.isNotNull(), F.struct(*[first[n].alias(n) for n in ("class", "name", "gender")])), sample_of(t))
    rows = step(docs, {"__triple": F.when(listed, triple), "__listed": listed})
    made = {}
    for name, _, pattern, _ in ROSTER_FIELDS:
        own = F.col(f"__triple.{name}")
        tries = [F.when(own != "", F.struct(own.alias("v"), F.lit(0.85).alias("c")))]
        if name == "class":
            tries.append(let(class_of(t), lambda x: F.when(x != "", F.struct(x.alias("v"), F.lit(0.9).alias("c")))))
        value = F.regexp_extract(t, f"(?iU){pattern}", 1)
        tries.append(F.when(value != "", F.struct(S.trimmed(value).alias("v"), F.lit(0.9).alias("c"))))
        made[f"r {name}"] = F.when(F.col("__listed"), F.coalesce(*tries, F.struct(F.lit(None).cast("string").alias("v"), F.lit(0.0).alias("c"))))
    return step(rows, made, docs.columns)


def infer_roster_fields(docs: DataFrame, rows: DataFrame, sample: DataFrame, majority: DataFrame) -> DataFrame:
    """``(doc_id, field_ord, field_name, field_type, field_value, confidence, source_position)``: class, name and gender of rosters, null where not found.

    ``rows``, ``sample`` and ``majority`` are what :func:`docloom.operators.tables.roster_rows`, ``roster_sample`` and ``roster_class`` find in ``docs``.
    The first member's values count (0.85), without members the first triple's; a class is else the commonest one (0.9), any other what follows
    its word in the text (0.9, with its place). Documents without members that do not call themselves a roster are left out.
    """
    first = rows.groupBy("doc_id").agg(F.min_by(F.struct("class", "name", "gender"), "ord").alias("__first"))
    other = sample.select("doc_id", F.struct("class", "name", "gender").alias("__sample"))
    most = majority.select("doc_id", F.col("class").alias("__most"))
    found = docs.select("doc_id", "text").join(first, "doc_id", "left").join(other, "doc_id", "left").join(most, "doc_id", "left")
    found = found.where(F.col("__first").isNotNull() | F.col("text").rlike(ROSTER_HINT)).withColumn("__first", F.coalesce("__first", "__sample"))

    def said(value: Column, confidence: float, where: str) -> Column:
        place = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(where).alias("context"))
        return F.when(value != "", F.struct(value.alias("value"), F.lit(confidence).alias("confidence"), place.alias("source_position")))

    made = []
    for k, (name, kind, pattern, _) in enumerate(ROSTER_FIELDS):
        tries = [said(F.col(f"__first.{name}"), 0.85, "roster-sample")]
        if name == "class":
            tries.append(said(F.col("__most"), 0.9, "roster-majority"))
        tries.append(_matched(F.col("text"), f"(?iU){pattern}", 0.9, 20))
        made.append(F.struct(F.lit(k).alias("field_ord"), F.lit(name).alias("field_name"), F.lit(kind).alias("field_type"), F.coalesce(*tries).alias("hit")))
    # Inlined first, so that each value is made once.
    listed = found.select("doc_id", F.inline(F.array(*made)))
    return listed.select("doc_id", "field_ord", "field_name", "field_type", F.col("hit.value").alias("field_value"), F.coalesce("hit.confidence", F.lit(0.0)).alias("confidence"), F.col("hit.source_position").alias("source_position"))
