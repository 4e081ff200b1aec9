"""Enrolment cards: label segments and one flat record a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators.lines import kept

# Labels printed on cards.
LABELS = (
    "姓名", "学生姓名", "名字", "性别", "民族", "学号", "入学日期", "入学时间", "入学年月", "证件号码", "身份证号码", "学历类别", "班级", "班级名称", "班级名",
    "学制", "分院", "系所", "院系", "院系名称", "学院", "学校", "学校名称", "专业", "专业名称", "学习形式", "学习方式", "培养方式", "方向",
)
CODE_LABELS = ("验证码", "校验码", "验证号码", "核验码", "查询码", "验证代码")
# What a card may say of education, study and nation, in order of precedence.
EDUCATION_TYPES = ("普通高等教育", "成人高等教育", "网络教育", "开放教育", "高等职业教育")
STUDY_MODES = ("普通全日制", "全日制", "非全日制", "业余", "函授", "开放教育", "网络教育")
NATIONS = (
    "汉族", "回族", "藏族", "维吾尔族", "蒙古族", "壮族", "苗族", "彝族", "土家族", "满族", "朝鲜族", "白族", "侗族", "瑶族",
    "傣族", "黎族", "哈尼族", "哈萨克族", "畲族", "拉祜族", "水族", "东乡族", "纳西族", "景颇族", "柯尔克孜族", "土族", "达斡尔族", "仫佬族",
    "羌族", "布朗族", "撒拉族", "毛南族", "仡佬族", "锡伯族", "阿昌族", "普米族", "塔吉克族", "怒族", "乌孜别克族", "俄罗斯族", "鄂温克族", "德昂族",
    "保安族", "裕固族", "京族", "塔塔尔族", "独龙族", "鄂伦春族", "赫哲族", "门巴族", "珞巴族", "基诺族",
)

_ID, _NUMBER, _ORG, _WORD = r"(?U)\b(\d{17}[\dXx])\b", r"(?U)\b(\d{8,12})\b", r"([一-龥A-Za-z·]{2,40}(?:大学|学院))", "([一-龥A-Za-z·]{2,30})"
_CLASS, _DATE, _YEARS = r"([A-Za-z一-龥]{1,10}[0-9]{1,4})", r"(?U)(\d{4}年\d{1,2}月\d{1,2}日)", r"(?U)(?<!\d)(\d{1,2}(?:\.\d+)?年)\b"


def _sound(c: Column) -> Column:
    s = S.trimmed(c)
    return F.coalesce((s != "") & ~s.isin(*LABELS, *CODE_LABELS), F.lit(False))


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def _first(a: Column, keep=None) -> Column:
    return F.get(F.filter(a, keep) if keep else a, F.lit(0))


def _label_hits(text: Column, label: str, number: int) -> Column:
    """Where a label stands: ``(start, label_no, label)`` in order, from the lengths of the text's parts between."""
    kinds = "array<struct<start:int,label_no:int,label:string>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kinds).alias("hits"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part)
        hit = F.struct(start.alias("start"), F.lit(number).alias("label_no"), F.lit(label).alias("label"))
        return F.struct((start + len(label)).alias("at"), F.concat(state["hits"], F.array(hit)).alias("hits"))

    # The last part has no label behind it.
    return F.aggregate(F.split(text, label, -1), begin, step, lambda s: F.slice(s["hits"], 1, F.size(s["hits"]) - 1))


def with_segments(docs: DataFrame) -> DataFrame:
    """``docs`` with ``segments``, an array of ``(label, ord, segment)``: the text from each label to the next label's start.

    Labels inside longer labels count too; empty segments are left out. One narrow pass.
    """
    hits = F.concat(*[F.when(F.col("text").contains(x), _label_hits(F.col("text"), x, k)).otherwise(F.array().cast("array<struct<start:int,label_no:int,label:string>>")) for k, x in enumerate((*LABELS, *CODE_LABELS))])
    rows = docs.withColumn("__hits", kept(F.sort_array(hits)))
    text = F.col("text")

    def cut(z: Column, k: Column) -> Column:
        end = z["hit"]["start"] + F.length(z["hit"]["label"])
        size = F.coalesce(z["after"]["start"], F.length(text)) - end
        segment = S.trimmed(F.when(size > 0, F.substr(text, end + 1, size)).otherwise(""))
        return F.struct(z["hit"]["label"].alias("label"), (k + 1).alias("ord"), segment.alias("segment"))

    pairs = F.arrays_zip(F.col("__hits").alias("hit"), F.slice("__hits", 2, F.size("__hits")).alias("after"))
    return rows.withColumn("segments", kept(F.filter(F.transform(pairs, cut), lambda s: s["segment"] != ""))).drop("__hits")


def label_segments(docs: DataFrame) -> DataFrame:
    """``(doc_id, label, ord, segment)``, one row a segment; see :func:`with_segments`."""
    return with_segments(docs).select("doc_id", F.inline("segments"))


def student_card(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """One flat record a document: each slot is a chain of places, the first that holds a sound value wins."""
    kinds = entities.where(F.col("type").isin("ID_NUMBER", "VERIFY_CODE", "STUDENT_ID", "DATE", "PERSON", "ORG"))
    seen = kinds.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rule", "ord", "type", "text"))).alias("ents"))
    rows = with_segments(docs.select("doc_id", "text")).join(seen, "doc_id", "left")
    t = F.col("text")

    def at(*labels: str) -> Column:
        return F.concat(*[F.transform(F.filter("segments", lambda s: s["label"] == x), lambda s: s["segment"]) for x in labels])

    def ent(*types: str) -> Column:
        return F.transform(F.filter(F.coalesce("ents", F.array().cast("array<struct<rule:int,ord:int,type:string,text:string>>")), lambda e: e["type"].isin(*types)), lambda e: S.trimmed(e["text"]))

    def found(places: Column, pattern: str, keep=None) -> Column:
        return _first(F.flatten(F.transform(places, lambda p: _all(p, pattern))), keep)

    def listed(words, *labels: str) -> Column:
        segment_hit = _first(F.flatten(F.transform(at(*labels), lambda p: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(p, w)))))
        return F.coalesce(segment_hit, _first(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))))

    here = F.array(t)
    rows = rows.withColumn("id_number", F.coalesce(found(ent("ID_NUMBER", "VERIFY_CODE"), _ID), found(here, _ID)))
    other = lambda x: ~x.eqNullSafe(F.col("id_number"))
    whole = F.filter(ent("STUDENT_ID", "VERIFY_CODE"), lambda x: x.rlike("^[0-9]{8,12}$") & other(x))
    rows = rows.withColumn(
        "student_id",
        F.coalesce(_first(whole), found(at("学号"), _NUMBER), found(at("系所"), _NUMBER, other), found(here, r"(?U)学号[:：]?\s*(\d{8,12})", other), found(here, _NUMBER, other)),
    )
    fresh = lambda x: other(x) & ~x.eqNullSafe(F.col("student_id"))
    rows = rows.withColumn("verify_code", F.coalesce(found(at(*CODE_LABELS), _NUMBER, fresh), found(here, _NUMBER, fresh)))
    date = F.coalesce(found(at("入学日期", "入学时间", "入学年月"), _DATE), found(at("系所"), _DATE), found(ent("DATE"), _DATE), found(here, _DATE))
    window = F.array(F.regexp_extract(t, "(学制.{0,60})", 1))
    years = F.coalesce(found(at("学制"), _YEARS), found(at("系所"), _YEARS), found(window, _YEARS), found(here, _YEARS))
    class_like = lambda x: ~x.rlike("[年月日]") & _sound(x)
    named = r"(?U)班级[:：]?\s*([A-Za-z一-龥]{1,10}[0-9]{1,4})"
    class_name = F.coalesce(found(at("班级", "班级名称", "班级名", "系所"), _CLASS, class_like), found(here, named, _sound), found(here, _CLASS, class_like))
    gender = F.coalesce(found(at("性别"), "(男|女)"), found(here, r"(?U)性别[:：]?\s*(男|女)"))
    rows = rows.withColumn("study_mode", listed(STUDY_MODES, "学习形式", "学习方式", "培养方式"))
    subject = lambda x: ~x.rlike("学院|大学") & _sound(x)
    header = F.substring_index(t, "\n", 1)
    left = F.when(header.contains("丨"), F.substring_index(header, "丨", 1))
    ahead = F.call_function("regexp_extract", t, F.concat(F.lit(rf"{_WORD}[|丨｜:/\-－—–】\]\s]*"), F.col("study_mode")), F.lit(1))
    major = F.coalesce(
        _first(F.reverse(_all(left, _WORD)), subject),
        found(at("专业", "专业名称"), _WORD, subject),
        F.when(subject(ahead), ahead),
        found(here, rf"(?U){_WORD}[】\]）》」]?\s*(?:全日制|非全日制)", subject),
    )
    orgs = F.array_distinct(F.concat(F.filter(ent("ORG"), _sound), F.filter(F.flatten(F.transform(F.concat(here, at("学院", "学校", "学校名称", "院系")), lambda p: _all(p, _ORG))), _sound)))
    rows = rows.withColumn("orgs", orgs)
    near = F.array(F.regexp_extract(t, r"(?s)(?:系所|分院)[:：]?\s*(.{0,120})", 1))
    department = F.coalesce(found(at("系所", "分院", "院系"), _ORG, _sound), found(near, "([一-龥A-Za-z·]{2,40}学院)", _sound))
    person = F.coalesce(_first(ent("PERSON"), _sound), found(at("姓名", "学生姓名", "名字"), "([一-龥·]{2,8})", _sound), found(here, r"(?U)姓名[:：]?\s*([一-龥·]{2,8})", _sound))
    college = _first(F.col("orgs"), lambda x: x.contains("学院"))
    return rows.select(
        "doc_id",
        person.alias("name"),
        gender.alias("gender"),
        listed(NATIONS, "民族").alias("nation"),
        "id_number",
        "student_id",
        major.alias("major"),
        class_name.alias("class_name"),
        college.alias("college"),
        department.alias("department"),
        F.coalesce(_first(F.col("orgs"), lambda x: x.contains("大学")), college).alias("school_name"),
        listed(EDUCATION_TYPES, "学历类别", "系所").alias("education_type"),
        "study_mode",
        S.normalize_date(date).alias("enroll_date"),
        years.alias("schooling_length"),
        F.when(fresh(F.col("verify_code")), F.col("verify_code")).alias("verify_code"),
    )
