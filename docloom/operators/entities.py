"""Entities with spans, key/value pairs and slots."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import packs
from docloom.functions import scalars as S
from docloom.functions.predicates import clean_kv_value, clean_value, is_bad_value, is_label_like, is_possible_key
from docloom.operators.lines import kept, let, lines_of

_OPEN, _CLOSE = "\x01", "\x02"


#: Types whose values must be no label, and what such a value may not hold.
_NO_LABEL = {"MAJOR_NAME": "贷款", "LOAN_BANK_NAME": "学院", "COLLEGE_NAME": None}


def _accepted(kind: str, line_value: bool):
    """What a match's value must be to count, by type; None: anything goes."""
    if kind == "PERSON":
        return lambda value: ~value.rlike(r"(?U)\d")
    if kind in _NO_LABEL and line_value:

        def named(value: Column) -> Column:
            line, word = S.trimmed(value), _NO_LABEL[kind]
            good = (line != "") & ~is_label_like(line)
            return good & ~line.contains(word) if word else good

        return named
    return None


def _hits(text: Column, rule: int, kind: str, before: str, value: str, after: str, line_value: bool) -> Column:
    """One rule's matches as an array of ``(rule, ord, type, text, start)``.

    Matches are spliced into the text as marks and the text is cut there; folding over the parts adds their lengths up to the
    matches' places.
    """
    marked = F.regexp_replace(text, f"(?U)({before})({value})({after})", f"$1{_OPEN}$2{_CLOSE}$3")
    kinds = "array<struct<rule:int,ord:int,type:string,text:string,start:int>>"
    begin = F.struct(F.lit(-1).alias("at"), F.array().cast(kinds).alias("hits"))

    def step(state: Column, part: Column) -> Column:
        hit = F.struct(F.lit(rule).alias("rule"), (F.size(state["hits"]) + 1).alias("ord"), F.lit(kind).alias("type"), F.substring_index(part, _CLOSE, 1).alias("text"), state["at"].alias("start"))
        first = state["at"] < 0
        at = F.when(first, F.length(part)).otherwise(state["at"] + F.length(part) - 1)
        return F.struct(at.alias("at"), F.when(first, state["hits"]).otherwise(F.concat(state["hits"], F.array(hit))).alias("hits"))

    found = F.aggregate(F.split(marked, _OPEN, -1), begin, step, lambda state: state["hits"])
    keep = _accepted(kind, line_value)
    return F.filter(found, lambda h: keep(h["text"])) if keep else found


_NO_HITS = "array<struct<rule:int,ord:int,type:string,text:string,start:int>>"


def _may_hit(text: Column, before: str, value: str, after: str) -> Column:
    """A cheap test that every text with a match passes: it holds one of the words that the rule opens with, else the pattern itself."""
    told = _opening(text, before)
    if told is not None:
        return told
    plain = text.contains("@") if "@" in value else F.lit(True)
    return plain & text.rlike(f"(?U)({before})({value})({after})")


def _opening(text: Column, before: str) -> Column | None:
    """Whether the text holds one of the words that a rule opens with; None for a rule without such words."""
    words = re.match(r"\(\?:([^()\\\[\]?*+.]+)\)(?![?*{])|([一-龥]{2,})(?:\\s|\[|\.)", before)
    if words and words[1]:
        # A word that holds another one is found by that one.
        listed = words[1].split("|")
        return reduce(Column.__or__, [text.contains(w) for w in listed if not any(o != w and o in w for o in listed)])
    if words and "|" not in before:
        return text.contains(words[2])
    return None


def unmarked(text: Column) -> Column:
    """The text as entities are looked for in it."""
    return F.when(text.contains(_OPEN) | text.contains(_CLOSE), F.translate(text, _OPEN + _CLOSE, "")).otherwise(text)


def first_entity(text: Column, kind: str) -> Column:
    """A type's first match in the order of its rules, in normal form, null without one; ``text``: see :func:`unmarked`."""
    tries = []
    for k, (own, before, value, after) in enumerate(packs.ENTITY_RULES):
        if own != kind:
            continue
        pattern, keep, told = f"(?U)({before})({value})({after})", _accepted(kind, k in packs.LINE_VALUE_RULES), _opening(text, before)
        if keep:
            hit = F.get(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), keep), F.lit(0))
        else:
            hit = S.found(text, pattern, 2)
        if told is None and "学号" in after:
            told = text.contains("学号")
        tries.append(hit if told is None else F.when(told, hit))
    found = F.coalesce(*tries)
    normal = {"PHONE": S.normalize_phone, "PARENT_PHONE": S.normalize_phone, "STUDENT_ID": S.normalize_student_id, "ID_NUMBER": S.normalize_id_number}.get(kind)
    return let(found, lambda x: F.coalesce(normal(x), x)) if normal else found


def entity_list(text: Column, types: list[str] | None = None) -> Column:
    """All matches of the rules wanted as an array of ``(rule, ord, type, text, start)``; ``text``: see :func:`unmarked`."""
    rules = [(k, r) for k, r in enumerate(packs.ENTITY_RULES) if types is None or r[0] in types]
    return F.flatten(F.array(*[F.when(_may_hit(text, *rule[1:]), _hits(text, k, *rule, k in packs.LINE_VALUE_RULES)).otherwise(F.array().cast(_NO_HITS)) for k, rule in rules]))


def extract_entities(docs: DataFrame, types: list[str] | None = None) -> DataFrame:
    """``(doc_id, rule, ord, type, text, start, end)``: every match of every rule, spans in code points.

    One narrow pass, without a shuffle: a rule's matches are placed inside the row, and only they leave it. ``types``
    keeps the rules wanted. A null text has no matches.
    """
    clean = F.translate("text", _OPEN + _CLOSE, "")
    found = docs.select("doc_id", clean.alias("__t"))
    rows = found.select("doc_id", kept(entity_list(F.col("__t"), types)).alias("__e")).select("doc_id", F.inline("__e"))
    return rows.select("doc_id", "rule", "ord", "type", "text", "start", (F.col("start") + F.length("text")).alias("end"))


def with_context(entities: DataFrame, docs: DataFrame, width: int = 10) -> DataFrame:
    """Entities with ``width`` characters of text on both sides."""
    texts = docs.select("doc_id", F.translate("text", _OPEN + _CLOSE, "").alias("__t"))
    at = F.greatest(F.col("start") - width, F.lit(0))
    joined = entities.join(texts, "doc_id")
    return joined.withColumn("context", F.substr(F.col("__t"), at + 1, F.col("end") + width - at)).drop("__t")


_CLASS, _NAME = "[A-Za-z0-9一-龥]{2,12}", "[一-龥]{2,4}"
_TRIPLES = (
    (rf"(?U)({_CLASS}(?:班级)?)\s*({_NAME})\s+(男|女)", (1, 2, 3)),
    (rf"(?U)({_NAME})\s+(男|女)\s*({_CLASS}(?:班级)?)", (3, 1, 2)),
)


def roster_entities(docs: DataFrame) -> DataFrame:
    """``(doc_id, ord, type, text, context)``: class, person and gender of class-name-gender triples, both orders."""
    out = None
    for order, (pattern, (c, n, g)) in enumerate(_TRIPLES):
        whole, groups = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), [F.regexp_extract_all("text", F.lit(pattern), F.lit(k)) for k in (c, n, g)]
        rows = docs.select("doc_id", F.posexplode(F.arrays_zip(whole.alias("w"), *[x.alias(k) for x, k in zip(groups, "cng")])).alias("at", "m"))
        named = F.array(*[F.struct(F.lit(t).alias("type"), F.col(f"m.{k}").alias("text")) for t, k in (("CLASS", "c"), ("PERSON", "n"), ("GENDER", "g"))])
        part = rows.select("doc_id", (F.col("at") * 2 + order).alias("ord"), F.col("m.w").alias("context"), F.inline(named))
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "ord", "type", "text", "context")


def date_range_entities(docs: DataFrame) -> DataFrame:
    """``(doc_id, type, text, start, end, context)``: both ends of the first date range."""
    ends = docs.select("doc_id", S.extract_date_range(F.col("text")).alias("r"))
    rows = ends.select("doc_id", F.expr("stack(2, 'LEAVE_START_DATE', r.start, 'LEAVE_END_DATE', r.end) AS (type, text)")).where("text IS NOT NULL")
    return rows.select("doc_id", "type", "text", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("date_range").alias("context"))


def normal_text(kind: Column, text: Column) -> Column:
    normal = (
        F.when(kind.isin("PHONE", "PARENT_PHONE"), S.normalize_phone(text))
        .when(kind == "STUDENT_ID", S.normalize_student_id(text))
        .when(kind == "ID_NUMBER", S.normalize_id_number(text))
    )
    return F.coalesce(normal, text)


def normalize_entities(entities: DataFrame) -> DataFrame:
    """Valid phones and ids in their normal form; of equal (type, text, span) the first stays."""
    normal = normal_text(F.col("type"), F.col("text"))
    first = Window.partitionBy("doc_id", "type", "text", "start", "end").orderBy("rule", "ord")
    named = entities.withColumn("text", normal).withColumn("__r", F.row_number().over(first))
    return named.where("__r = 1").drop("__r")


# Words that are no person's name.
NOT_A_PERSON = ("姓名", "性别", "学号", "专业", "班级", "学院", "学校", "学习形式", "全日制", "本科", "必修", "选修", "课程", "学分", "成绩", "绩点")


def clean_entities(entities: DataFrame) -> DataFrame:
    """Trimmed, non-empty; persons of 2-10 characters without digits that are no form word."""
    t = S.trimmed(F.col("text"))
    person = ~t.isin(*NOT_A_PERSON) & ~t.rlike(r"(?U)\d") & F.length(t).between(2, 10)
    return entities.withColumn("text", t).where((F.col("text") != "") & F.when(F.col("type") == "PERSON", person).otherwise(F.lit(True)))


def entity_slots(entities: DataFrame) -> DataFrame:
    """``(doc_id, field_name, field_type, field_value, confidence)``: the first good entity of each slot's type."""
    slots = entities.sparkSession.createDataFrame([(k, *v) for k, v in packs.SLOTS.items()], "type string, field_name string, field_type string, confidence double")
    # Cleaned once, behind a generator: as a plain column the cleaner would be copied into every test of the filter.
    sound = F.filter(F.transform(F.array("text"), clean_kv_value), lambda v: v.isNotNull() & ~is_bad_value(v))
    good = entities.where(F.col("type").isin(*packs.SLOTS)).select("doc_id", "type", "rule", "ord", F.explode(sound).alias("v"))
    first = good.groupBy("doc_id", "type").agg(F.min_by("v", F.struct("rule", "ord")).alias("v"))
    joined = first.join(F.broadcast(slots), "type")
    value = (
        F.when(F.col("field_type") == "DATE", F.coalesce(S.normalize_date(F.col("v")), F.col("v")))
        .when(F.col("type") == "MONEY_AMOUNT", F.coalesce(S.parse_money(F.col("v")).cast("string"), F.col("v")))
        .when(F.col("field_name") == "loan_years", F.coalesce(S.months_to_years(F.col("v")).cast("string"), F.col("v")))
        .otherwise(F.col("v"))
    )
    return joined.select("doc_id", "field_name", "field_type", value.alias("field_value"), "confidence")


# Keys that may stand several to a line.
INLINE_KEYS = (
    "姓名", "学生姓名", "性别", "出生日期", "民族", "身份证号码", "身份证号", "户籍地址", "学校名称", "学校", "学院", "分院", "系所", "院系名称",
    "专业", "专业名称", "层次", "学制", "学历类别", "学习形式", "学籍状态", "入学日期", "入学年份", "预计毕业日期", "在线验证码", "验证网址", "就读高校",
    "贷款合同编号", "用款期限", "本次用款金额", "账户名称", "账号", "开户行", "回执验证码",
)


def align_key_values(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, rule, key, value, confidence)``.

    Rule 0: keys in a row on one line (0.85). Of the others the first that fits a line: 1 key, colon, value
    (0.9); 2 key, space, value (0.82); 3 key on its line, value on the next (0.8). Equal pairs once.
    """
    lines = docs.select("doc_id", kept(lines_of(F.col("text"))).alias("l"))
    lines = lines.select("doc_id", kept(F.arrays_zip(F.col("l").alias("line"), F.slice("l", 2, F.greatest(F.size("l"), F.lit(1))).alias("after"))).alias("l"))
    rows = lines.select("doc_id", F.posexplode("l").alias("line_no", "z"))
    rows = rows.select("doc_id", "line_no", "z.line", "z.after")
    rows = rows.withColumn("m", kept(_halved(F.col("line"))))
    out = rows.select("doc_id", "line_no", kept(_pairs(F.col("line"), F.col("after"), F.col("m"))).alias("z")).select("doc_id", "line_no", F.inline("z"))
    first = Window.partitionBy("doc_id", "key", "value").orderBy("line_no", "rule", "nth")
    return out.withColumn("__r", F.row_number().over(first)).where("__r = 1").select("doc_id", "line_no", "rule", "key", "value", "confidence")


def pair_list(text: Column) -> Column:
    """The pairs of :func:`align_key_values` as an array of ``(line_no, rule, key, value)`` in order, equal ones as often as they stand there."""

    def of_line(lines: Column, line: Column, at: Column) -> Column:
        pairs = let(_halved(line), lambda m: _pairs(line, F.get(lines, at + 1), m))
        return F.transform(pairs, lambda p: F.struct(at.alias("line_no"), p["rule"].alias("rule"), p["key"].alias("key"), p["value"].alias("value")))

    return let(lines_of(text), lambda lines: F.flatten(F.transform(lines, lambda line, at: of_line(lines, line, at))))


def _halved(line: Column) -> Column:
    """What the tests of :func:`_pairs` use several times. A line without a colon's match has an empty key."""
    colon = r"(?U)^(.{1,20})[:：]\s*(.+)"
    halves = F.split(line, r"(?U)[:：\s]+", 2)
    return F.struct(is_possible_key(line).alias("keyed"), F.regexp_extract(line, colon, 1).alias("k1"), clean_value(F.regexp_extract(line, colon, 2)).alias("v1"), halves.alias("halves"))


def _pairs(line: Column, after: Column, m: Column) -> Column:
    """A line's pairs; ``after``: the line that follows, ``m``: see :func:`_halved`."""
    keys = "|".join(INLINE_KEYS)
    inline = rf"(?U)({keys})\s*[:：]?\s*([^\n\r]{{1,100}}?)(?=\s*(?:{keys})\s*[:：]?|$)"
    pairs = F.arrays_zip(F.regexp_extract_all(line, F.lit(inline), F.lit(1)).alias("key"), F.regexp_extract_all(line, F.lit(inline), F.lit(2)).alias("value"))
    pairs = F.when(line.rlike(keys), pairs).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    several = F.transform(pairs, lambda p, i: F.struct(F.lit(0).alias("rule"), i.alias("nth"), p["key"].alias("key"), clean_value(p["value"]).alias("value"), F.lit(0.85).alias("confidence")))
    several = F.filter(several, lambda p: (p["value"] != "") & ~is_possible_key(p["value"]))

    def strip(c: Column) -> Column:
        return F.regexp_replace(c, "^[：: ]+|[：: ]+$", "")

    k1, v1, keyed, halves = (m[c] for c in ("k1", "v1", "keyed", "halves"))
    one = (v1 != "") & is_possible_key(k1)
    k2, v2 = strip(F.get(halves, F.lit(0))), clean_value(F.get(halves, F.lit(1)))
    two = keyed & line.rlike("[ \t]") & (F.size(halves) == 2) & (k2 != "") & (v2 != "") & ~is_possible_key(v2)
    v3 = clean_value(after)
    three = keyed & F.coalesce((v3 != "") & ~is_possible_key(v3), F.lit(False))

    def pair(rule: int, key: Column, value: Column, confidence: float) -> Column:
        return F.array(F.struct(F.lit(rule).alias("rule"), F.lit(0).alias("nth"), key.alias("key"), value.alias("value"), F.lit(confidence).alias("confidence")))

    lone = (
        F.when(one, pair(1, S.trimmed(k1), v1, 0.9))
        .when(two, pair(2, k2, v2, 0.82))
        .when(three, pair(3, F.regexp_replace(line, "^[：:]+|[：:]+$", ""), v3, 0.8))
        .otherwise(F.array().cast("array<struct<rule:int,nth:int,key:string,value:string,confidence:double>>"))
    )
    return F.concat(several, lone)


def extract_relations(docs: DataFrame) -> DataFrame:
    """Relations between entities: none are derived; the typed, empty table."""
    return docs.where(F.lit(False)).select("doc_id", F.lit("").alias("head"), F.lit("").alias("relation"), F.lit("").alias("tail"))


def sample_details(fields: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` field details of each document."""
    return fields.withColumn("__r", F.row_number().over(Window.partitionBy("doc_id").orderBy("field_ord"))).where(F.col("__r") <= n).drop("__r")
