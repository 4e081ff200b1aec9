"""Merging, repairing, pivoting and shaping of fields into the response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.functions.predicates import LABELS, is_header
from docloom.operators.fields import ENTITY_TYPES, summarize_fields
from docloom.operators.lines import clean_text, kept, let, step
from docloom.operators.tables import COURSE_TYPES

_DETAIL = ["doc_id", "field_ord", "field_name", "field_type", "field_value", "confidence"]


def merge_fields(base: DataFrame, extra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base details and those extra ones whose name the document lacks (a null base value counts), with a new summary."""
    added = extra.select(*_DETAIL[:1], (F.col("field_ord") + 10_000).alias("field_ord"), *_DETAIL[2:], F.lit(True).alias("__extra"))
    both = base.select(*_DETAIL, F.lit(False).alias("__extra")).unionByName(added)
    # One window in place of a join of the base with itself, so that either side is made once.
    told = F.min("__extra").over(Window.partitionBy("doc_id", "field_name"))
    merged = both.withColumn("__told", told).where(~F.col("__extra") | F.col("__told") | F.col("doc_id").isNull() | F.col("field_name").isNull()).select(*_DETAIL)
    return merged, summarize_fields(merged)


def _once(c: Column, make) -> Column:
    """``make(c)``, null where ``c`` is: inside a lambda ``c`` is made once, and rows without a value skip all of it."""
    return F.when(c.isNotNull(), F.get(F.transform(F.array(c), make), F.lit(0)))


def _normal(kind: Column, v: Column) -> Column:
    """Identities and dates in normal form, other values as they are."""
    return F.when(kind.isin("ID_NUMBER", "PHONE", "STUDENT_ID"), S.normalize_identity(kind, v)).when(kind == "DATE", F.coalesce(S.normalize_date_strict(v), v)).otherwise(v)


def fix_fields(fields: DataFrame) -> DataFrame:
    """Header words to null with confidence 0; identities and dates in normal form; a null date takes the birth date
    of the document's last id of 18 characters, with confidence 0.6 at most."""
    value, kind = F.col("field_value"), F.col("field_type")
    whole = F.when((kind == "ID_NUMBER") & (F.length(value) == 18) & F.substring(value, 1, 14).rlike(r"^[0-9]{14}$"), value)
    everything = Window.partitionBy("doc_id").orderBy("field_ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = fields.withColumn("__id", F.last(whole, ignorenulls=True).over(everything))
    birth = F.concat_ws("-", F.substring("__id", 7, 4), F.substring("__id", 11, 2), F.substring("__id", 13, 2))
    fixed = _once(value, lambda x: F.when(~is_header(x), F.struct(_normal(kind, x).alias("v"))))
    # Behind a generator: the value is used several times below.
    rows = rows.withColumn("__f", kept(fixed))
    v = F.col("__f.v")
    confidence = F.when(value.isNotNull() & F.col("__f").isNull(), 0.0).otherwise(F.coalesce("confidence", F.lit(0.0)))
    filled = (kind == "DATE") & v.isNull() & F.col("__id").isNotNull()
    least = F.least(confidence, F.lit(0.6))
    rows = rows.withColumn("__v", F.when(filled, birth).otherwise(F.when(~v.isin("", " "), v))).withColumn("__c", F.when(filled, F.when(least == 0, 0.6).otherwise(least)).otherwise(confidence))
    return rows.select("doc_id", "field_ord", "field_name", "field_type", F.col("__v").alias("field_value"), F.col("__c").alias("confidence"))


def settled(rows: DataFrame, named: list[tuple[str, str]], ids: list[str]) -> DataFrame:
    """``rows`` whose columns ``named`` (name, field type) of ``(v, c)`` have gone through :func:`fix_fields` and :func:`normalize_fields`; ``ids``: those of them that hold ids.

    No field has a course's type. What is in normal form stays as it is when it is normalised again, but for a birth date out of an id.
    """

    def normal(kind: str, v: Column) -> Column:
        # As _normal, but only what the type asks for is built.
        return S.normalize_identity(F.lit(kind), v) if kind in ("ID_NUMBER", "PHONE", "STUDENT_ID") else F.coalesce(S.normalize_date_strict(v), v) if kind == "DATE" else v

    other = [c for c in rows.columns if c not in dict(named)]
    whole = [F.when((F.length(f"`{n}`.v") == 18) & F.substring(f"`{n}`.v", 1, 14).rlike(r"^[0-9]{14}$"), F.col(f"`{n}`.v")) for n in ids]
    made = {}
    for n, kind in named:
        v, c = F.col(f"`{n}`.v"), F.col(f"`{n}`.c")
        made[n] = F.when(F.col(f"`{n}`").isNotNull(), F.struct(F.when(~is_header(v), normal(kind, v)).alias("v"), F.when(is_header(v), 0.0).otherwise(c).alias("c")))
    rows = step(rows, made | {"__id": F.coalesce(*reversed(whole)) if whole else F.lit(None).cast("string")}, other)
    born = F.concat_ws("-", F.substring("__id", 7, 4), F.substring("__id", 11, 2), F.substring("__id", 13, 2))
    rows = step(rows, {"__born": F.when(F.col("__id").isNotNull(), F.coalesce(S.normalize_date_strict(born), born))}, [*other, *dict(named)])
    made = {}
    for n, kind in named:
        v, c = F.col(f"`{n}`.v"), F.col(f"`{n}`.c")
        whole, least = F.when(~v.isin("", " "), v), F.least(c, F.lit(0.6))
        value, sure = whole, F.when(whole.isNotNull(), c).otherwise(0.0)
        if kind == "DATE":
            filled = v.isNull() & F.col("__born").isNotNull()
            value, sure = F.when(filled, F.col("__born")).otherwise(whole), F.when(filled, F.when(least == 0, 0.6).otherwise(least)).otherwise(sure)
        made[n] = F.when(F.col(f"`{n}`").isNotNull(), F.struct(value.alias("v"), sure.alias("c")))
    return step(rows, made, other)


def normalize_fields(fields: DataFrame, types: DataFrame) -> DataFrame:
    """Course figures only for course documents; dates and identities in normal form; ``status`` ok or missing (confidence 0)."""
    rows = fields.join(types.select("doc_id", "document_type"), "doc_id", "left")
    kind, v = F.col("field_type"), F.col("field_value")
    course = kind.isin("COURSE", "CREDIT", "SCORE", "GPA") & ~F.coalesce(F.col("document_type").isin(*COURSE_TYPES), F.lit(False))
    v = F.when(~F.coalesce(course, F.lit(False)), v)
    v = _once(v, lambda x: F.get(F.filter(F.array(_normal(kind, x)), lambda n: ~n.isin("", " ")), F.lit(0)))
    rows, v = rows.withColumn("__v", kept(v)), F.col("__v")
    return rows.select(
        "doc_id", "field_ord", "field_name", "field_type", v.alias("field_value"), F.when(v.isNull(), 0.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.when(v.isNull(), "missing").otherwise("ok").alias("status")
    )


# Names of the flat record and, for some, the names looked for in order.
FLAT_NAMES = (
    "name", "gender", "birth_date", "id_number", "student_id", "class", "major", "college", "department", "school_name", "address", "phone", "contact", "issuer",
    "admission_school", "date", "reason", "certificate_id", "verify_code", "verify_url", "enroll_date", "expected_grad_date", "status", "degree_level", "education_type",
    "study_mode", "loan_amount", "bank_name", "account_number", "loan_years", "contract_id", "scholarship_name", "scholarship_amount", "start_date", "end_date", "days",
    "approve_status", "issue_date",
)
ALIASES = {
    "loan_amount": ("loan_amount", "贷款金额", "借款金额"),
    "bank_name": ("bank_name", "loan_bank_name", "贷款银行"),
    "contract_id": ("contract_id", "loan_contract_no", "合同编号"),
    "loan_years": ("loan_years", "loan_term_month"),
    "scholarship_name": ("scholarship_name", "奖学金"),
    "scholarship_amount": ("scholarship_amount", "资助金额"),
}


def flatten_fields(fields: DataFrame) -> DataFrame:
    """One row a document with a column for each flat name: the value of its last detail.

    Where that is null or empty, names with aliases take the first detail of each alias in turn (the name itself is one) that has a value.
    """

    def pick(rank, name: str) -> Column:
        own = F.col("field_name") == name
        return rank(F.when(own, F.struct("field_value")), F.when(own, F.struct("field_ord")))["field_value"]

    seen = sorted({a for names in ALIASES.values() for a in names})
    wide = fields.groupBy("doc_id").agg(*[pick(F.max_by, n).alias(n) for n in FLAT_NAMES], *[pick(F.min_by, a).alias(f"first {a}") for a in seen])

    def filled(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), *[F.nullif(F.col(f"first {a}"), F.lit("")) for a in ALIASES[name]], F.col(name))

    return wide.select("doc_id", *[filled(n).alias(n) if n in ALIASES else F.col(n) for n in FLAT_NAMES])


_LABEL_WORDS = "|".join(sorted({*LABELS, "姓名", "性别", "学号", "班级", "专业", "学院", "学校", "地址", "手机", "联系方式"}, key=len, reverse=True))


def is_label_token(c: Column, strict: bool = False) -> Column:
    """A form's label. As published, any 2-4 Chinese characters without 银行, 学院, 大学, 学校 or 支行 count as one; not if ``strict``."""
    s = S.trimmed(c)
    label = s.rlike(f"^(?:{_LABEL_WORDS})[:：]?$")
    return label if strict else label | (s.rlike("^[一-龥]{2,4}$") & ~s.rlike("银行|学院|大学|学校|支行"))


def sanitize(c: Column, strict: bool = False) -> Column:
    """Trimmed; labels (see :func:`is_label_token`) are null, a label in front of a colon goes."""
    s, label = S.trimmed(c), is_label_token(c, strict)
    bare = F.when((F.length(s) <= 30), F.regexp_replace(s, rf"^(?:{_LABEL_WORDS})\s*[:：]\s*(?=\S)", "")).otherwise(s)
    return F.when((s != "") & ~label, bare)


# The response's blocks and what they hold.
BLOCKS = {
    "basic_info": ("name", "gender", "birth_date", "id_number", "student_id", "class", "major", "college", "department", "school_name", "address", "phone", "contact"),
    "academic_info": ("degree_level", "education_type", "enroll_date", "expected_grad_date", "status", "study_mode"),
    "certificate_info": ("certificate_id", "issue_date", "issuer", "verify_code", "verify_url"),
    "leave_info": ("reason", "start_date", "end_date", "days", "issuer", "approve_status"),
    "financial_info": ("loan_amount", "loan_years", "bank_name", "account_number", "scholarship_name", "scholarship_amount"),
}
_NUMERIC = {"loan_amount", "loan_years", "scholarship_amount"}


def build_blocks(flat: DataFrame, strict: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, basic_info, academic_info, certificate_info, leave_info, financial_info)`` structs; a contract's summary goes along."""

    def one(name: str) -> Column:
        return (S.safe_number(F.col(name)) if name in _NUMERIC else sanitize(F.col(name), strict)).alias(name)

    kept = ["summary"] if "summary" in flat.columns else []
    return flat.select("doc_id", *[c for c in carried if c not in ("doc_id", "summary")], *[F.struct(*[one(n) for n in names]).alias(block) for block, names in BLOCKS.items()], *kept)


LOAN_TYPES = ("合同", "贷款合同", "生源地助学贷款合同")
# Words of a student loan, captions that are no values, words of a school.
LOAN_WORDS = ("助学贷款", "贷款合同", "贷款合同编号")
NO_VALUES = ("开户行", "学生姓名", "名称", "账户名称", "开户银行", "专业名称", "学院名称")
_SCHOOL = "学院|大学|学校"


def map_loan_contract(entities: DataFrame, pairs: DataFrame, types: DataFrame, docs: DataFrame, flat: DataFrame) -> DataFrame:
    """``(doc_id, basic_info, financial_info, certificate_info)`` of contracts that name a student loan: their slots, each by its own rule.

    ``entities(doc_id, rule, ord, type, text[, confidence])`` and ``pairs(doc_id, line_no, rule, key, value)`` count in their order. Labels are
    no values. Name and bank: the surest entity, then the longest; a name has 2-4 characters and no caption in it. Id: the first id inside
    an id or code. School: the longest organisation that is one. College and major: what ``flat`` holds, else by key, a college also by
    entity. Address: the longest. Account: the first number of 8-20 digits among entities, else among values, that is no id. Amount and
    years: the text's first figure before 元, and before 年 (else months by 12). Codes: the longest of 8-20 digits, else as a value.
    """
    loans = docs.where(F.col("text").rlike("|".join(LOAN_WORDS))).select("doc_id", "text").join(types.where("document_type = '合同'").select("doc_id"), "doc_id", "left_semi")
    sure = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)) if "confidence" in entities.columns else F.lit(0.0)
    # Either side is gathered to a row a document, and what its slots hold is told within the row.
    seen = entities.join(loans.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rule", "ord", "type", "text", sure.alias("sure")))).alias("__e"))
    told = pairs.join(loans.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "rule", "key", "value"))).alias("__p"))
    rows = loans.join(flat.select("doc_id", "college", "major"), "doc_id", "left").join(seen, "doc_id", "left").join(told, "doc_id", "left")
    return _slotted(rows, lambda x: x["sure"])


def contracts_within(rows: DataFrame) -> DataFrame:
    """:func:`map_loan_contract` of contracts ``(doc_id, text, college, major)`` that hold their entities ``__e`` and pairs ``__p`` as arrays in order: nothing is joined."""
    return _slotted(rows.where(F.col("text").rlike("|".join(LOAN_WORDS))), lambda _: F.lit(0.0))


def _slotted(rows: DataFrame, sure) -> DataFrame:
    return step(rows, contract_slots(F.col("__e"), F.col("__p"), F.col("text"), F.col("college"), F.col("major"), sure), [])


def contract_slots(e: Column, p: Column, text: Column, college: Column, major: Column, sure=lambda _: F.lit(0.0)) -> dict[str, Column]:
    """The blocks of :func:`map_loan_contract` out of a document's entities ``(rule, ord, type, text)`` and pairs ``(line_no, rule, key, value)``, both in order; ``sure`` tells an entity's confidence."""
    is_id = r"(?U)\b(\d{17}[\dXx])\b"

    def number(c: Column) -> Column:
        """8-20 digits that are no id."""
        return F.coalesce(c.rlike(r"(?U)^\d{8,20}$") & ~c.rlike(r"(?U)^\d{17}[\dXx]$"), F.lit(False))

    def first(rows: Column, keep, value) -> Column:
        return F.get(F.transform(F.filter(rows, keep), value), F.lit(0))

    def most(keep, value, *rank) -> Column:
        """The largest by rank; of equal ones the first."""
        ranked = F.transform(F.filter(e, keep), lambda x: F.struct(*[r(x).alias(f"k{i}") for i, r in enumerate(rank)], (-x["rule"]).alias("r"), (-x["ord"]).alias("o"), value(x).alias("v")))
        return F.array_max(ranked)["v"]

    def of(*kinds: str):
        return lambda x: x["type"].isin(*kinds)

    def said(x: Column) -> Column:
        return x["text"]

    def bare(x: Column) -> Column:
        return S.trimmed(x["text"])

    def long(value):
        return lambda x: F.length(value(x))

    org, coded = of("ORG", "COLLEGE_NAME"), of("VERIFY_CODE")
    e_name = most(lambda x: of("PERSON")(x) & F.length(bare(x)).between(2, 4) & ~said(x).rlike("|".join((*NO_VALUES, "贷款信息"))), said, sure, long(said))
    e_id = first(e, lambda x: of("ID_NUMBER", "VERIFY_CODE")(x) & said(x).rlike(is_id), lambda x: F.regexp_extract(said(x), is_id, 1))
    e_school = most(lambda x: org(x) & said(x).rlike(_SCHOOL), bare, long(bare))
    e_college = first(e, lambda x: org(x) & said(x).contains("学院") & ~is_label_token(said(x)), bare)
    e_address = most(lambda x: of("ADDRESS_FULL")(x) & (said(x) != ""), said, long(said))
    e_bank = most(lambda x: of("LOAN_BANK_NAME")(x) & (said(x) != ""), said, sure, long(said))
    e_account = first(e, lambda x: of("ACCOUNT_NUMBER", "VERIFY_CODE", "NUMBER", "CARD_ID")(x) & number(said(x)), said)
    e_code = most(lambda x: coded(x) & bare(x).rlike(r"(?U)^\d{8,20}$"), bare, long(bare), sure)

    def clean(x: Column) -> Column:
        return F.when(~is_label_token(x["value"]), S.trimmed(x["value"]))

    def keyed(word: str) -> Column:
        return first(p, lambda x: x["key"].contains(word) & (clean(x) != ""), clean)

    k_account = first(p, lambda x: number(x["value"]), lambda x: x["value"])
    k_code = first(p, lambda x: number(S.trimmed(x["value"])), lambda x: S.trimmed(x["value"]))

    def sound(c: Column) -> Column:
        return let(c, lambda x: F.when(~is_label_token(x), S.trimmed(x)))

    def held(c: Column) -> Column:
        return F.when(~c.isin(*NO_VALUES) & (c != ""), c)

    t = F.coalesce(text, F.lit(""))
    amount = S.found(t, r"(?U)(\d+(?:\.\d+)?)(?=\s*(?:（?元|\\))")
    years, months = S.found(t, r"(?U)(\d+(?:\.\d+)?)\s*年").try_cast("double"), S.found(t, r"(?U)(\d+(?:\.\d+)?)\s*月").try_cast("double")
    k_major = let(keyed("专业"), lambda x: F.coalesce(F.nullif(S.trimmed(F.regexp_replace(x, "(名称|专业名称)", "")), F.lit("")), x))
    code = F.coalesce(e_code, k_code)
    return {
        "basic_info": F.struct(
            sound(e_name).alias("name"), e_id.alias("id_number"), e_school.alias("school_name"), F.coalesce(held(college), keyed("学院"), e_college).alias("college"), F.coalesce(held(major), k_major).alias("major"), sound(e_address).alias("address"),
        ),
        "financial_info": F.struct(
            sound(e_bank).alias("bank_name"), F.coalesce(e_account, k_account).alias("account_number"), amount.try_cast("double").alias("loan_amount"),
            F.coalesce(years, F.bround(months / 12, 2)).alias("loan_years"),
        ),
        "certificate_info": let(code, lambda x: F.struct(x.alias("certificate_id"), x.alias("verify_code"))),
    }


def with_contract(flat: DataFrame, contract: DataFrame) -> DataFrame:
    """``flat`` with the contract's values over its own, labels among them as null."""
    slots = [(b, n) for b in ("basic_info", "financial_info", "certificate_info") for n in dict(contract.dtypes)[b][7:-1].replace(",", ":").split(":")[::2]]
    rows = flat.join(contract.select("doc_id", *[F.col(f"{b}.{n}").cast("string").alias(f"__{n}") for b, n in slots]), "doc_id", "left")
    over = overlaid([n for _, n in slots])
    return rows.select("doc_id", *[over[n].alias(n) if n in over else F.col(n) for n in FLAT_NAMES])


def overlaid(names: list[str]) -> dict[str, Column]:
    """Flat values with a contract's (columns ``__<name>``) over them."""
    over = {n: F.when(F.col(f"__{n}") != "", F.col(f"__{n}") if n in _NUMERIC else sanitize(F.col(f"__{n}"))) for n in names}
    return {n: F.when(F.col(f"__{n}") != "", over[n]).otherwise(F.col(n)) for n in names}


_PLACES = "省|市|县|区|镇|乡|村"
_PERIOD = r"(?:期限|用款期限|贷款期限)[^\n\r]{0,10}?(\d+(?:\.\d+)?)\s*年"


def _longest(a: Column, sign: int = -1) -> Column:
    """Strings of an array by length, longest first (``sign`` 1: shortest first); equal lengths keep their order."""
    keyed = F.transform(a, lambda x, i: F.struct((sign * F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def post_process_contract(flat: DataFrame, docs: DataFrame, types: DataFrame, entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """``flat`` with ``summary``; slots of contracts repaired from entities and key/value pairs, in their order.

    Labels leave their slots; what is then empty is filled: names of 2-4 characters, ids, the longest school and address,
    college and major by key, a bank. The longest code of 16-20 digits is certificate and verify code, the shortest of 8-12 digits (else of up
    to 20) that is neither id nor certificate the account. Loans read amount and period off the text where they lack them; other
    contracts have neither. Documents of other types stay as they are, with a null summary.
    """
    seen = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rule", "ord", "type", "text"))).alias("__e"))
    said = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "rule", "key", "value"))).alias("__p"))
    kind = types.select("doc_id", F.col("document_type").alias("__type"), "probabilities" if "probabilities" in types.columns else F.lit(None).cast("map<string,double>").alias("probabilities"))
    rows = flat.join(kind, "doc_id", "left").join(docs.select("doc_id", "text"), "doc_id", "left").join(seen, "doc_id", "left").join(said, "doc_id", "left")
    return repaired(rows)


def repaired(rows: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """:func:`post_process_contract` of a row a document: flat names, ``__type``, ``probabilities``, ``text``, and as arrays in order its entities ``__e`` and pairs ``__p``."""
    contract = F.coalesce(F.col("__type").isin(*LOAN_TYPES), F.lit(False))
    ents = F.coalesce("__e", F.array().cast("array<struct<rule:int,ord:int,type:string,text:string>>"))
    kvs = F.coalesce("__p", F.array().cast("array<struct<line_no:int,rule:int,key:string,value:string>>"))
    t = F.col("text")

    def of(*kinds: str) -> Column:
        return F.transform(F.filter(ents, lambda e: e["type"].isin(*kinds)), lambda e: S.trimmed(e["text"]))

    def by_key(word: str) -> Column:
        return F.transform(F.filter(kvs, lambda p: p["key"].contains(word)), lambda p: p["value"])

    def first(a: Column, keep=None) -> Column:
        return F.get(F.filter(a, keep) if keep else a, F.lit(0))

    def own(name: str) -> Column:
        return F.when(~is_label_token(F.col(name)) & (F.col(name) != ""), F.col(name))

    one_id = r"(?U)\b(\d{17}[\dXx])\b"
    people = F.transform(F.filter(of("PERSON", "COLLEGE_NAME"), lambda x: ~x.rlike("贷款信息|开户行|学生姓名")), lambda x: F.substring_index(x, "的", 1))
    name = F.coalesce(F.when(~F.col("name").isin("姓名", "开户行", "账户名称", "名称"), own("name")), first(people, lambda x: x.rlike("^[一-龥]{2,4}$") & ~x.rlike("学院|大学")))
    id_number = F.coalesce(own("id_number"), first(F.transform(F.filter(of("ID_NUMBER", "VERIFY_CODE"), lambda x: x.rlike(one_id)), lambda x: F.regexp_extract(x, one_id, 1))))
    school = F.coalesce(F.nullif("school_name", F.lit("")), first(_longest(F.filter(of("ORG", "COLLEGE_NAME"), lambda x: x.rlike("学院|大学|学校") & ~is_label_token(x)))))
    colleges = F.transform(by_key("学院"), lambda x: F.regexp_extract(x, "[一-鿿A-Za-z0-9（）()·]{2,40}学院", 0))
    college = F.coalesce(F.when(~F.col("college").contains("账户名称 院系名称 就读高校"), own("college")), first(colleges, lambda x: (x != "") & ~is_label_token(x)))
    majors = F.transform(by_key("专业"), lambda x: S.trimmed(F.regexp_replace(x, "专业名称|名称", "")))
    major = F.coalesce(own("major"), first(majors, lambda x: (x != "") & ~is_label_token(x)))
    first_line = S.trimmed(F.regexp_extract("address", r"^([^\n\r]*)", 1))
    homes = F.filter(of("ADDRESS_FULL"), lambda x: x.rlike(_PLACES))
    homes = F.transform(homes, lambda x: F.regexp_extract(S.trimmed(F.substring_index(F.replace(x, F.lit("\n"), F.lit(" ")), "银行", 1)), r"^(\S*)", 1))
    address = F.coalesce(F.when(~is_label_token(first_line) & (first_line != ""), first_line), first(_longest(homes)))
    codes = _longest(F.filter(of("VERIFY_CODE"), lambda x: x.rlike(r"^\d{8,20}$") & ~x.rlike(one_id)))
    certificate = F.coalesce(first(codes, lambda x: F.length(x) >= 16), first(codes))
    bank = F.coalesce(own("bank_name"), first(of("LOAN_BANK_NAME"), lambda x: x.contains("银行") & ~is_label_token(x)), first(of("ADDRESS_FULL"), lambda x: x.contains("银行")))
    rows = rows.withColumns({"__id": F.when(contract, id_number), "__cert": F.when(contract, certificate)})
    digits = F.filter(F.concat(of(*sorted(ENTITY_TYPES)), F.transform(kvs, lambda p: S.trimmed(p["value"]))), lambda x: x.rlike(r"^\d{8,20}$") & ~x.rlike(one_id) & ~x.eqNullSafe(F.col("__id")) & ~x.eqNullSafe(F.col("__cert")))
    account = F.coalesce(first(_longest(F.filter(digits, lambda x: F.length(x) <= 12), 1)), first(_longest(digits, 1)))
    share = lambda x: F.coalesce(F.try_element_at("probabilities", F.lit(x)), F.lit(0.0))
    loan = F.col("__type").isin("生源地助学贷款合同", "贷款合同") | (share("生源地助学贷款合同") > 0) | (share("贷款合同") > share("合同"))
    amount = F.coalesce(F.col("loan_amount").try_cast("double"), S.found(t, r"(?U)(\d+(?:\.\d+)?)(?=\s*（?元|\s*\(元)").try_cast("double"))
    months = F.bround(S.found(t, r"(?U)(\d+)\s*（?月").try_cast("double") / 12, 2)
    years = F.coalesce(F.col("loan_years").try_cast("double"), S.found(t, f"(?U){_PERIOD}").try_cast("double"), S.found(t, r"(?U)(\d+(?:\.\d+)?)\s*年").try_cast("double"), months)
    made = {
        "name": name, "id_number": F.col("__id"), "school_name": school, "college": college, "major": major, "address": address, "bank_name": bank, "account_number": account,
        "certificate_id": F.coalesce("__cert", "certificate_id"), "verify_code": F.coalesce("__cert", "verify_code"),
        "loan_amount": F.when(loan, amount.cast("string")), "loan_years": F.when(loan, years.cast("string")),
    }
    out = rows.select("doc_id", *carried, "__type", F.when(contract, loan).alias("__loan"), *[F.when(contract, made[n]).otherwise(F.col(n)).alias(n) if n in made else F.col(n) for n in FLAT_NAMES])

    def said_of(label: str, c: Column, unit: str = "") -> Column:
        return F.concat(F.lit(f"{label} "), c, F.lit(unit))

    def figure(n: str) -> Column:
        return F.when(F.col(n).isNotNull(), F.format_string("%.1f", F.bround(F.col(n).try_cast("double"), 1)))

    lent = F.concat_ws("，", said_of("类型", F.col("__type")), said_of("借款人", F.col("name")), said_of("金额", figure("loan_amount"), " 元"), said_of("期限", figure("loan_years"), " 年"), said_of("学校", F.col("school_name")))
    other = F.concat_ws("，", said_of("类型", F.col("__type")), *[said_of(w, F.col(n)) for w, n in (("姓名", "name"), ("学校", "school_name"), ("学院", "college"), ("专业", "major"))])
    return out.select("doc_id", *carried, *FLAT_NAMES, F.when(F.col("__loan"), lent).when(~F.col("__loan"), other).alias("summary"))


def gathered(order: str, *columns: str) -> Column:
    """A document's rows in order, as an aggregate by document."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order, *[c for c in columns if c != order]))), lambda x: F.struct(*[x[c].alias(c) for c in columns]))


def finalize(
    docs: DataFrame, types: DataFrame, fields: DataFrame, blocks: DataFrame, courses: DataFrame, *, analysis: DataFrame | None = None, tables: DataFrame | None = None,
    reasons: DataFrame | None = None, cleared: DataFrame | None = None, templates: DataFrame | None = None,
) -> DataFrame:
    """One response a document: type and candidates, blocks, courses, tables, fields, text, summary, ``meta``, ``classification`` and notes.

    ``types(doc_id, document_type[, confidence, probabilities, source])``; ``analysis(doc_id, level, problems)`` is the quality of
    recognition, ``tables(doc_id, name, row, record)`` what was formatted, ``reasons(doc_id, fail_reason)`` why fields are missing, ``cleared``
    the documents whose courses a model could not confirm, ``templates(doc_id, template_id)`` what fields were looked for. Each side is
    gathered to a row a document first. Confidence is the mean of the fields with a value; status is success if all have one, partial if some do.
    """
    listed = fields.groupBy("doc_id").agg(gathered("field_ord", "field_name", "field_type", "field_value", "confidence", *(["status"] if "status" in fields.columns else [])).alias("details"))
    marks = [c for c in ("academic_year", "semester", "course_code", "course_seq", "course_name", "credit", "score", "gpa") if c in courses.columns]
    taken = courses.groupBy("doc_id").agg(gathered("line_no", *marks).alias("courses"))
    blocks = blocks if "summary" in blocks.columns else blocks.withColumn("summary", F.lit(None).cast("string"))
    kinds = [F.col(c) if c in types.columns else F.lit(None).cast(k).alias(c) for c, k in (("document_type", "string"), ("confidence", "double"), ("probabilities", "map<string,double>"), ("source", "string"))]
    rows = docs.select("doc_id", "text").join(types.select("doc_id", *kinds).withColumnRenamed("confidence", "__sure"), "doc_id", "left")
    main = summarize_fields(fields).select("doc_id", "total_fields", "extracted_fields", "confidence")
    shown = None
    if tables is not None:
        # Maps have no order: their entries are sorted along, and made maps again at the end.
        grouped = tables.withColumn("record", F.map_entries("record")).groupBy("doc_id", "name").agg(gathered("row", "row", "record").alias("rows"))
        made = F.transform(F.sort_array(F.collect_list(F.struct("name", "rows"))), lambda t: F.struct(t["name"].alias("name"), F.transform(t["rows"], lambda r: F.struct(r["row"].alias("row"), F.map_from_entries(r["record"]).alias("record"))).alias("rows")))
        shown = grouped.groupBy("doc_id").agg(made.alias("tables"))
    for other in (main, blocks, listed, taken, shown, analysis, reasons, templates, None if cleared is None else cleared.select("doc_id", F.lit(True).alias("__cleared")).distinct()):
        rows = rows if other is None else rows.join(other, "doc_id", "left")
    for name, kind in (("tables", "array<struct<name:string,rows:array<struct<row:int,record:map<string,string>>>>>"), ("level", "string"), ("problems", "array<string>"), ("fail_reason", "string"), ("template_id", "string"), ("__cleared", "boolean")):
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast(kind))
    return answered(rows)


def answered(rows: DataFrame) -> DataFrame:
    """The responses of :func:`finalize` out of a row a document that holds all its parts; ``__sure`` is the type's confidence, ``confidence`` that of the fields."""
    total, got, sure = F.coalesce("total_fields", F.lit(0)), F.coalesce("extracted_fields", F.lit(0)), F.bround(F.coalesce("confidence", F.lit(0.0)), 4)
    status = F.when(got == 0, "failed").when(got < total, "partial").otherwise("success")
    kind, reason = F.coalesce("document_type", F.lit("generic_document")), F.col("fail_reason")
    because = F.concat(F.lit("，原因："), reason)
    # As published: a reason is said once more where nothing was extracted.
    plain = F.concat(F.lit("类型 "), kind, F.lit("，字段 "), got.cast("string"), F.lit("/"), total.cast("string"), F.lit("，置信度 "), F.format_string("%.2f", F.bround(F.coalesce("confidence", F.lit(0.0)), 2)), F.when((got == 0) & reason.isNotNull(), because).otherwise(""), F.when(reason.isNotNull(), because).otherwise(""))
    bare = F.coalesce(F.size("courses"), F.lit(0)) == 0
    notes = F.array_compact(
        F.array(
            F.concat(F.lit("字段提取失败原因："), reason),
            F.when(F.size("problems") > 0, F.concat(F.lit("OCR 问题："), F.array_join("problems", "；"))),
            F.when(bare & kind.isin("成绩单", "课程表"), "未恢复课程表，可能 OCR 表格被拆散或缺失表格模型"),
            F.when(F.col("__cleared"), "课程列表疑似噪声，LLM 兜底未返回有效课程，已清空"),
        )
    )
    return rows.select(
        "doc_id", kind.alias("document_type"), F.col("probabilities").alias("document_type_candidates"), sure.alias("confidence_overall"), *BLOCKS, "courses", "tables",
        F.struct(F.struct(status.alias("status"), sure.alias("confidence")).alias("extract_main"), F.col("details").alias("extract_details"), "template_id").alias("fields"),
        clean_text(F.col("text")).alias("text"), F.coalesce("summary", plain).alias("summary"), F.struct(F.col("doc_id").cast("string").alias("file_id"), F.col("level").alias("ocr_quality"), F.lit(None).cast("string").alias("stat_date")).alias("meta"),
        F.struct(kind.alias("document_type"), F.coalesce("__sure", sure).alias("confidence"), F.col("probabilities").alias("probabilities"), F.coalesce("source", F.lit("rules")).alias("source")).alias("classification"),
        notes.alias("notes"),
    )
