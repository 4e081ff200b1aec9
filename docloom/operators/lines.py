"""Lines, sections and quality of document text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalars import trimmed

_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
_BREAKS = rf"\r\n|{_BREAK}"


def kept(made: Column) -> Column:
    """A generator of one row, ``made`` itself: what is made behind it is not made again.

    A generator over an expression gets a filter of its own, that the expression is neither null nor empty, and so makes it twice or
    more; over a column that another generator gave, the filter is free.
    """
    return F.explode(F.array(made))


def let(made: Column, use) -> Column:
    """``use(made)`` with ``made`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(made), use), F.lit(0))


def step(rows: DataFrame, made: dict[str, Column], carried: list[str] | None = None) -> DataFrame:
    """``rows`` (or their columns ``carried``) with the columns ``made``, as a projection that is compiled apart from those around it.

    Projections in a row are fused into one method, and the JVM does not compile methods beyond 8,000 bytes. One that holds a lambda is not
    fused, and its columns become methods of their own.
    """
    same = [c for c in (rows.columns if carried is None else carried) if c != "doc_id"]
    return rows.select(let(F.col("doc_id"), lambda x: x).alias("doc_id"), *same, *[c.alias(n) for n, c in made.items()])


def lines_of(text: Column) -> Column:
    """Trimmed, non-empty lines in order."""
    # A pair of breaks gives an empty line, which goes: single characters do.
    return F.filter(F.transform(F.split(text, _BREAK), trimmed), lambda x: x != "")


def split_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line)``, one row a non-empty line."""
    return docs.select("doc_id", kept(lines_of(F.col("text"))).alias("l")).select("doc_id", F.posexplode("l").alias("line_no", "line"))


def digit_share(c: Column) -> Column:
    # By what is left without them: counting makes a string of each.
    return (F.length(c) - F.length(F.regexp_replace(c, r"(?U)\d+", ""))) / F.greatest(F.length(c), F.lit(1))


def spaced(c: Column) -> Column:
    """Three separators or more."""
    return c.rlike(r"[ \t|,][^ \t|,]*+[ \t|,][^ \t|,]*+[ \t|,]")


def tabular(x: Column) -> Column:
    """A line dense in digits or separators."""
    return spaced(x) | (digit_share(x) > 0.35)


def segment_document(docs: DataFrame) -> DataFrame:
    """``docs`` with ``header`` (first three lines), ``meta``, ``table`` and ``body`` line arrays; meta overlaps the others."""
    # Behind generators, so that lines are cut once and each is judged once.
    rows = docs.withColumn("__l", F.explode(F.array(lines_of(F.col("text"))))).withColumn("__j", F.explode(F.array(F.transform("__l", tabular))))
    return rows.select(
        *docs.columns,
        F.slice("__l", 1, 3).alias("header"),
        F.filter("__l", lambda x: x.rlike("日期|时间|编号|盖章|证明")).alias("meta"),
        F.filter("__l", lambda _, i: F.get("__j", i)).alias("table"),
        F.filter("__l", lambda _, i: ~F.get("__j", i)).alias("body"),
    )


def infer_doc_pattern(segments: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """``(doc_id, doc_type, has_table, header_keywords, meta_keywords)`` from segments and their class.

    Without ``types`` the segments have their class with them, as ``document_type``.
    """
    kind = F.lit(None).cast("string") if types is not None else F.col("document_type")
    rows = segments.select(
        "doc_id",
        kind.alias("doc_type"),
        (F.size("table") > 0).alias("has_table"),
        F.filter("header", lambda x: x.rlike("通知|证明|成绩|请假")).alias("header_keywords"),
        F.filter("meta", lambda x: x.rlike("编号|日期|盖章")).alias("meta_keywords"),
    )
    if types is None:
        return rows
    # What the segments say is read ahead of the join, so that lines do not go over the wire.
    joined = rows.drop("doc_type").join(types.select("doc_id", F.col("document_type").alias("doc_type")), "doc_id", "left")
    return joined.select("doc_id", "doc_type", "has_table", "header_keywords", "meta_keywords")


def of_courses(x: Column) -> Column:
    """A line dense in digits or separators, or that names a course."""
    return spaced(x) | reduce(Column.__or__, [x.contains(w) for w in ("学分", "绩点", "成绩", "课程")]) | (digit_share(x) >= 0.35)


def section_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``body`` and ``table``, the lines of either kind: table lines are dense in digits or separators, or name a course."""
    # Behind generators, so that lines are cut once and each is judged once.
    rows = docs.withColumn("__l", F.explode(F.array(lines_of(F.col("text"))))).withColumn("__j", F.explode(F.array(F.transform("__l", of_courses))))
    return rows.select(*docs.columns, F.filter("__l", lambda _, i: ~F.get("__j", i)).alias("body"), F.filter("__l", lambda _, i: F.get("__j", i)).alias("table"))


def split_text_sections(docs: DataFrame) -> DataFrame:
    """``(doc_id, body_text, table_text, nlp_text)``: see :func:`section_lines`."""
    rows = section_lines(docs).withColumns({"body_text": F.array_join("body", "\n"), "table_text": F.array_join("table", "\n")})
    both = F.concat_ws("\n", F.nullif("body_text", F.lit("")), F.nullif("table_text", F.lit("")))
    return rows.select("doc_id", "body_text", "table_text", F.coalesce(F.nullif(both, F.lit("")), F.col("text")).alias("nlp_text"))


def reconstruct_text(docs: DataFrame) -> DataFrame:
    """``docs`` whose text is that of its raw ``lines`` array, where that has any."""
    raw = F.filter(F.transform("lines", trimmed), lambda x: x != "")
    return docs.withColumn("text", F.when(F.size(raw) > 0, F.array_join(raw, "\n")).otherwise(F.col("text")))


def raw_tables(docs: DataFrame) -> DataFrame:
    """``(doc_id, table_no, html)``: tables that recognition left in the arrays ``result``, ``structure`` and ``data`` of strings, in that order.

    Columns may be absent or null; what holds no ``<table`` is no table.
    """
    arrays = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("result", "structure", "data") if c in docs.columns]
    found = F.filter(F.concat(*arrays) if arrays else F.array().cast("array<string>"), lambda x: F.coalesce(F.lower(x).contains("<table"), F.lit(False)))
    return docs.select("doc_id", F.posexplode(found).alias("table_no", "html"))


def read_raw(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """``docs`` with ``text`` and ``lines`` as recognition's own JSON (``raw``) has them, and ``html``, its tables in order.

    Lines are those of the list ``lines`` (values of any kind as text, blank ones left out), and then the text is theirs; else those of the text.
    Tables are the ``html`` of the objects in the lists ``result``, ``structure`` and ``data``, where that holds ``<table``. What is
    no JSON, no list or no object gives nothing.
    """
    json = F.try_parse_json(F.col(raw))

    def listed(name: str) -> Column:
        return F.coalesce(F.try_variant_get(json, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))

    # Behind a generator, so that the JSON is read once.
    found = F.struct(F.transform(listed("lines"), lambda x: trimmed(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("None")))).alias("own"), F.concat(*[F.transform(listed(n), lambda x: F.try_variant_get(x, "$.html", "string")) for n in ("result", "structure", "data")]).alias("html"))
    rows = docs.withColumn("__f", F.explode(F.array(found)))
    own = F.filter("__f.own", lambda x: x != "")
    rows = rows.withColumn("lines", F.when(F.size(own) > 0, own).otherwise(lines_of(F.coalesce("text", F.lit("")))))
    rows = rows.withColumn("text", F.when(F.size(own) > 0, F.array_join(own, "\n")).otherwise(F.col("text")))
    return rows.withColumn("html", F.filter("__f.html", lambda h: F.coalesce(F.contains(F.lower(h), F.lit("<table")), F.lit(False)))).drop("__f")


# Strings that recognition is known to make up.
NOISE = ("糖点", "硬是炎到", "心糖译")


def clean_text(text: Column, noise: tuple[str, ...] = NOISE) -> Column:
    """Noise literals out, ideographic spaces to spaces, runs of white space to one, trimmed."""
    for literal in noise:
        text = F.replace(text, F.lit(literal), F.lit(""))
    return trimmed(F.regexp_replace(F.replace(text, F.lit("　"), F.lit(" ")), r"(?U)\s{2,}", " "))


def assess_quality(docs: DataFrame) -> DataFrame:
    """``(doc_id, level, problems, score)``: shares of damaged and unprintable characters, short and digit-only lines."""
    return assessed(docs.select("doc_id", "text")).drop("text")


def assessed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``level, problems, score`` of :func:`assess_quality`."""
    text = F.col("text")
    n = F.greatest(F.length(text), F.lit(1))
    lines = F.split(F.regexp_replace(text, f"(?:{_BREAKS})$", ""), _BREAKS)
    # The counts are columns of their own, so that each regular expression runs once.
    counts = docs.select(
        *docs.columns,
        (F.regexp_count(text, F.lit("[�?*]")) / n).alias("messy"),
        (F.regexp_count(text, F.lit(r"[\p{C}\p{Z}&&[^ ]]")) / n).alias("noise"),
        F.aggregate(
            lines,
            F.struct(F.lit(0).alias("many"), F.lit(0).alias("short"), F.lit(0).alias("digits")),
            lambda a, x: F.struct(
                (a["many"] + 1).alias("many"),
                (a["short"] + (F.length(trimmed(x)) <= 2).cast("int")).alias("short"),
                (a["digits"] + (F.regexp_count(x, F.lit(r"(?U)\d")) > F.length(x) * 0.5).cast("int")).alias("digits"),
            ),
        ).alias("l"),
        F.coalesce(trimmed(text) == "", F.lit(True)).alias("blank"),
        text.rlike("[�?]").alias("garbled"),
    )
    messy, noise, many, short, digits = (F.col(c) for c in ("messy", "noise", "l.many", "l.short", "l.digits"))
    score = 1 - F.least(F.lit(1.0), messy * 5 + noise * 3 + F.lit(0.1) * short / F.greatest(many, F.lit(1)))
    counts = counts.withColumn("__score", score)
    problems = F.array_compact(
        F.array(
            F.when((messy > 0.02) | (noise > 0.02), "噪声字符过多"),
            F.when(digits > many * 0.5, "表格未被解析"),
            F.when(short > many * 0.4, "文本缺失"),
            F.when(F.col("garbled"), "乱码"),
        )
    )
    s = F.col("__score")
    level = F.when(s >= 0.75, "good").when(s >= 0.5, "medium").when(s >= 0.3, "bad").otherwise("critical")
    return counts.select(
        *docs.columns,
        F.when(F.col("blank"), "critical").otherwise(level).alias("level"),
        F.when(F.col("blank"), F.array(F.lit("文本缺失"))).otherwise(F.array_sort(problems)).alias("problems"),
        F.when(~F.col("blank"), s).alias("score"),
    )


def suggest_repair(docs: DataFrame) -> DataFrame:
    """``(doc_id, suggestions)`` for ``docs(doc_id, text, level, document_type)``."""
    return docs.select(
        "doc_id",
        F.array_compact(
            F.array(
                F.when(F.length(trimmed(F.coalesce("text", F.lit("")))) < 10, "文本过短，建议重新拍照/提高分辨率"),
                F.when(F.col("level").isin("bad", "critical"), "OCR 质量较差：建议开启图像增强/去噪/倾斜矫正"),
                F.when(F.col("document_type") == "未知", "未能稳定判别文档类型：建议保证标题区域清晰"),
            )
        ).alias("suggestions"),
    )
