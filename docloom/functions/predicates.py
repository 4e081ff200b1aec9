"""Predicates and cleaners for labels and values of forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.scalars import trimmed

# Strings that are a form's own labels.
LABELS = (
    "贷款信息", "贷款合同编号", "合同编号", "用款期限", "本次用款金额", "回执验证码", "验证码",
    "姓名及手机", "姓名及手机：", "家长姓名及手机", "本人手机号", "微信号", "QQ号", "E-mail",
)
_SHORT_LABEL = "姓名|学院|专业|班级|账号|手机|联系方式"
_KEY_WORDS = "姓名|性别|出生|民族|学校|学院|分院|系所|专业|层次|学制|学历|学习形式|学籍状态|入学|毕业|验证码|验证网址|课程|成绩|学年|学期|学分"
HEADERS = (
    "姓名", "性别", "班级", "班主任", "联系电话", "联系方式", "学校", "学院", "专业", "学号", "学籍号", "证件号", "身份证号",
    "出生日期", "地址", "年级", "班级姓名", "姓名性别", "姓名性别班级", "姓名性别班级班主任",
)


def is_label_like(c: Column) -> Column:
    """A known label, or a digit-free string of up to six characters with a label's word in it."""
    s = F.regexp_replace(trimmed(c), "[：:]", "")
    short = (F.length(s) <= 6) & ~s.rlike(r"(?U)\d") & s.rlike(_SHORT_LABEL)
    return F.coalesce((s != "") & (s.isin(*LABELS) | short), F.lit(False))


def is_possible_key(c: Column) -> Column:
    """Up to twenty characters that hold a key's word."""
    s = F.regexp_replace(c, r"^[：: \t]+|[：: \t]+$", "")
    return F.coalesce((F.length(s) <= 20) & s.rlike(_KEY_WORDS), F.lit(False))


def is_bad_value(c: Column) -> Column:
    """Nothing, a label, a prompt, or a short string that still names a field."""
    s = trimmed(c)
    prompt = s.rlike(r"^.*(姓名|手机|手机号|联系方式|微信|QQ|邮箱|E-?mail)[:：]?$")
    named = s.rlike(r"(姓名|学号|班级|学院|专业|电话|手机号|地址)[:：]") & (F.length(s) <= 20)
    return F.coalesce((s == "") | is_label_like(s) | prompt | named, F.lit(True))


def is_header(c: Column) -> Column:
    """A table's column title, white space aside."""
    return F.coalesce(F.regexp_replace(c, r"(?U)\s+", "").isin(*HEADERS), F.lit(False))


def clean_value(c: Column) -> Column:
    """Trimmed, without quotes and angle brackets."""
    return F.regexp_replace(trimmed(c), "[\"'<>]", "")


def clean_kv_value(c: Column) -> Column:
    """Without underscores and a leading label; a bare colon or nothing is null."""
    s = trimmed(F.replace(trimmed(c), F.lit("_"), F.lit("")))
    s = F.regexp_replace(s, r"(?U)^(?:姓名|学号|班级|专业班级|学院|院系|专业|电话|手机号|地址|家庭地址)[:：]\s*", "")
    return F.when(~s.isin("", ":", "："), s)
