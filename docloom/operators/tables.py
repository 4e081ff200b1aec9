"""Grids, transcripts, course lists and rosters out of text and table markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators.lines import kept, let, lines_of, of_courses, section_lines, tabular
from docloom.sources.store import cut

_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_table_to_grid(tables: DataFrame) -> DataFrame:
    """``(doc_id, table_no, row, cells)`` for ``tables(doc_id, table_no, html)``: no white space in cells, empty rows skipped but counted.

    Markup without rows gives one cell a line.
    """
    rows = F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr\s*>"), F.lit(1))

    def plain(cell: Column) -> Column:
        text = F.regexp_replace(cell, "<[^>]*>", " ")
        for name, char in _ENTITIES:
            text = F.replace(text, F.lit(name), F.lit(char))
        return F.regexp_replace(text, r"(?U)\s+", "")

    grid = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]\s*>"), F.lit(1)), plain))
    lines = F.transform(lines_of(F.col("html")), lambda x: F.array(F.regexp_replace(x, r"(?U)\s+", "")))
    made = F.when(F.size(grid) > 0, grid).otherwise(lines)
    return tables.select("doc_id", "table_no", kept(made).alias("g")).select("doc_id", "table_no", F.posexplode("g").alias("row", "cells")).where(F.size("cells") > 0)


def plain_table_to_grid(lines: DataFrame) -> DataFrame:
    """``(doc_id, table_no, row, cells)`` of aligned lines ``(doc_id, line_no, line)``: cut at bars and tabs, else at wide gaps; two cells at least."""
    kept = lines.where(F.length("line") >= 4).withColumn("cells", _cells(F.col("line"))).where(F.size("cells") >= 2)
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    return kept.select("doc_id", F.lit(0).alias("table_no"), row.alias("row"), "cells")


def _cells(line: Column) -> Column:
    """The cells of an aligned line: cut at bars and tabs, else at wide gaps."""
    cells = F.when(line.rlike("[|\t]"), F.split(line, "[|\t]")).otherwise(F.split(line, r"(?U)\s{2,}"))
    return F.filter(F.transform(cells, S.trimmed), lambda c: c != "")


def grid_of(text: Column, members: Column) -> Column:
    """A text's tables as an array of ``(table_no, row, cells)``: its roster's members (see :func:`members_of`), then the plain table of its tabular lines."""
    gaps = text.rlike(r"(?U)[|\t]|\s\s")

    def row(table: int, at: Column, cells: Column) -> Column:
        return F.struct(F.lit(table).alias("table_no"), at.alias("row"), cells.alias("cells"))

    listed = F.transform(members, lambda m, at: row(0, at, F.array(m["number"].cast("string"), m["class"], m["name"], m["gender"])))
    wide = F.transform(F.filter(lines_of(text), lambda x: (F.length(x) >= 4) & tabular(x)), _cells)
    plain = F.transform(F.filter(wide, lambda c: F.size(c) >= 2), lambda c, at: row(1, at, c))
    none = F.array().cast("array<struct<table_no:int,row:int,cells:array<string>>>")
    return F.concat(F.coalesce(listed, none), F.coalesce(F.when(gaps, plain), none))


def marks_of(grid: Column) -> Column:
    """The rows of :func:`transcript_from_grid` as an array, for ``grid``, an array of ``(table_no, row, cells)``."""
    return F.transform(F.filter(grid, lambda g: F.size(g["cells"]) >= 3), lambda g: F.struct(g["row"].alias("row"), *_marks(g["cells"])))


def _marks(cells: Column) -> list[Column]:
    at = F.transform(cells, lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    number = F.get(F.filter(at, lambda x: x["c"].rlike(r"^[0-9]+(\.[0-9]+)?$")), F.lit(0))
    wide = F.filter(at, lambda x: x["c"].rlike(r"^[0-9]{1,3}(\.[0-9]+)?$") & (x["i"] > number["i"]))
    grade = F.get(F.filter(cells, lambda c: c.rlike(r"^[A-Fa-f][+-]?$")), F.lit(0))
    first, second = F.get(cells, F.lit(0)), F.get(cells, F.lit(1))
    return [
        F.when(first.rlike(r"(?U)\d{4}"), first).alias("semester"),
        second.alias("course_name"),
        number["c"].alias("credit"),
        F.get(wide, F.lit(0))["c"].alias("score"),
        grade.alias("grade"),
    ]


def transcript_from_grid(grid: DataFrame) -> DataFrame:
    """``(doc_id, table_no, row, semester, course_name, credit, score, grade, cells)`` of rows with three cells or more.

    First number in the row is the credit, the next one of up to three digits the score, the first letter grade the grade.
    """
    return grid.where(F.size("cells") >= 3).select("doc_id", "table_no", "row", *_marks(F.col("cells")), "cells")


TABULAR_TYPES = ("成绩单", "课程表", "班级成员表")


def format_tables(grid: DataFrame, transcript: DataFrame, types: DataFrame) -> DataFrame:
    """``(doc_id, name, row, record)`` for documents of tabular types: cells as ``col1..n``, transcripts with numbers cast."""
    wanted = types.where(F.col("document_type").isin(*TABULAR_TYPES)).select("doc_id", "document_type")
    plain = grid.join(wanted, "doc_id").select(
        "doc_id",
        F.concat(F.lit("auto_table_"), (F.col("table_no") + 1).cast("string")).alias("name"),
        "row",
        _record(F.col("document_type"), F.col("cells")).alias("record"),
    )
    named = _named(lambda c: F.col(c))
    marks = transcript.join(wanted, "doc_id").select("doc_id", F.lit("transcript").alias("name"), "row", named.alias("record"))
    return plain.unionByName(marks)


def _record(kind: Column, cells: Column) -> Column:
    members = (kind == "班级成员表") & (F.size(cells) == 4)
    return F.map_from_arrays(F.when(members, F.array(*map(F.lit, ("number", "class", "name", "gender")))).otherwise(F.transform(cells, lambda _, i: F.concat(F.lit("col"), (i + 1).cast("string")))), cells)


def _named(mark) -> Column:
    """A transcript's row as a map; ``mark(name)`` gives its parts."""
    return F.create_map(
        F.lit("semester"), mark("semester"), F.lit("course_name"), mark("course_name"),
        F.lit("credit"), mark("credit").try_cast("double").cast("string"), F.lit("score"), mark("score").try_cast("double").cast("string"), F.lit("grade"), mark("grade"),
    )


def tables_of(kind: Column, grid: Column, marks: Column) -> Column:
    """What :func:`format_tables` makes of a document's type, grid and transcript rows, as an array of ``(name, rows)`` sorted by name; null: no rows."""

    def listed(name: str, rows: Column) -> Column:
        return let(rows, lambda r: F.when(F.size(r) > 0, F.struct(F.lit(name).alias("name"), r.alias("rows"))))

    def of(table: int) -> Column:
        rows = F.filter(grid, lambda g: g["table_no"] == table)
        return listed(f"auto_table_{table + 1}", F.transform(rows, lambda g: F.struct(g["row"].alias("row"), _record(kind, g["cells"]).alias("record"))))

    # Maps have no order: rows are sorted by their entries.
    said = F.sort_array(F.transform(marks, lambda m: F.struct(m["row"].alias("row"), F.map_entries(_named(lambda c: m[c])).alias("record"))))
    transcript = listed("transcript", F.transform(said, lambda m: F.struct(m["row"].alias("row"), F.map_from_entries(m["record"]).alias("record"))))
    made = F.array_compact(F.array(of(0), of(1), transcript))
    return F.when(kind.isin(*TABULAR_TYPES), let(made, lambda t: F.when(F.size(t) > 0, t)))


_TERM = r"20[0-9]{2}[-/]20[0-9]{2}[-]?[12一二]"
_COURSES = "array<struct<line_no:int,academic_year:string,semester:string,course_code:string,course_seq:string,course_name:string,credit:double,score:double,gpa:double>>"


def line_courses(text: Column) -> Column:
    """The rows of :func:`courses_from_lines` of a text as an array in order."""

    def listed(lines: Column) -> Column:
        return let(F.filter(lines, of_courses), lambda dense: F.when(F.size(dense) > 0, dense).otherwise(lines))

    def course(line: Column, at: Column) -> Column:
        even = S.trimmed(F.regexp_replace(F.regexp_replace(line, "[|]+", " "), r"(?U)\s{2,}", " "))
        return F.when(line.rlike(_TERM), let(F.split(even, " "), lambda p: F.when((F.size(p) >= 6) & F.get(p, F.lit(0)).rlike(_TERM), read(at, p))))

    def read(at: Column, p: Column) -> Column:
        # The first three columns are no numbers: see courses_from_lines.
        return let(F.transform(p, lambda x, i: F.when(i >= 3, S.first_number(x))), lambda v: credited(at, p, v))

    def credited(at: Column, p: Column, v: Column) -> Column:
        spot = F.filter(F.sequence(F.lit(3), F.least(F.size(p), F.lit(10)) - 1), lambda i: (F.get(v, i) > 0) & (F.get(v, i) <= 20))
        return let(F.get(spot, F.lit(0)), lambda k: F.when(k > 3, let(S.parse_semester(F.get(p, F.lit(0))), lambda s: row(at, p, v, k, s))))

    def row(at: Column, p: Column, v: Column, k: Column, s: Column) -> Column:
        later = F.filter(F.sequence(k + 2, F.greatest(F.least(F.size(p), k + 6) - 1, k + 2)), lambda i: (F.get(v, i) >= 0) & (F.get(v, i) <= 5))
        return F.struct(
            at.alias("line_no"), s["academic_year"].alias("academic_year"), F.concat_ws("-", s["academic_year"], s["term"]).alias("semester"), F.get(p, F.lit(1)).alias("course_code"), F.get(p, F.lit(2)).alias("course_seq"),
            F.array_join(F.slice(p, F.lit(4), k - 3), " ").alias("course_name"), F.get(v, k).alias("credit"), F.get(v, k + 1).alias("score"), F.get(v, F.get(later, F.lit(0))).alias("gpa"),
        )

    made = let(lines_of(text), lambda lines: F.transform(listed(lines), course))
    sound = F.filter(made, lambda c: c.isNotNull() & (c["course_name"] != "") & ~c["course_name"].rlike(r"(?U)^\d+$"))
    return F.when(text.rlike(_TERM), sound).otherwise(F.array().cast(_COURSES))


def courses_of(text: Column, by_line: Column) -> Column:
    """A text's cleaned courses as an array: those of its lines (``by_line``: see :func:`line_courses`), without any those of its tokens."""

    def tokens(p: Column) -> Column:
        return let(F.transform(p, S.first_number), lambda v: let(_walked(p, v), lambda w: F.transform(w, lambda c, at: F.struct(at.alias("line_no"), *_token_course(p, v, c)))))

    words = let(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""), lambda p: F.when(F.size(p) >= 6, tokens(p)))
    every = F.when(F.size(by_line) > 0, by_line).when(text.rlike(_TERM_TOKEN), words)
    named = F.filter(every, lambda c: _sound_name(c["course_name"]))
    return F.transform(named, lambda c: F.struct(*[(S.trimmed(c[n]) if n == "course_name" else c[n]).alias(n) for n in ("line_no", *COURSE_FIELDS)]))


COURSE_FIELDS = ("academic_year", "semester", "course_code", "course_seq", "course_name", "credit", "score", "gpa")


def mark_courses(marks: Column) -> Column:
    """Transcript rows (see :func:`marks_of`) as courses, as :func:`courses_from_transcript` makes them."""
    none = F.lit(None).cast("string")
    return F.transform(
        marks,
        lambda m: F.struct(
            m["row"].alias("line_no"), none.alias("academic_year"), m["semester"].alias("semester"), none.alias("course_code"), none.alias("course_seq"), m["course_name"].alias("course_name"),
            m["credit"].try_cast("double").alias("credit"), F.nullif(m["score"], F.lit("")).try_cast("double").alias("score"), F.lit(None).cast("double").alias("gpa"),
        ),
    )


def courses_from_lines(docs: DataFrame) -> DataFrame:
    """Course rows of lines with six columns or more that open with a semester.

    The credit is the first of columns 3-9 that holds a number in (0, 20], and stands after column 3; the name lies before
    it, the score after it, and the grade point is the first of the four columns after that with a number in [0, 5].
    """
    sections = section_lines(docs.select("doc_id", "text"))
    rows = sections.select("doc_id", kept(F.when(F.size("table") > 0, F.col("table")).otherwise(F.col("body"))).alias("l")).select("doc_id", F.posexplode("l").alias("line_no", "line"))
    even = S.trimmed(F.regexp_replace(F.regexp_replace("line", "[|]+", " "), r"(?U)\s{2,}", " "))
    semester = _TERM
    # Generators keep the columns and their numbers: as plain columns they would be made again in every test of the filter below.
    fits = F.filter(F.array(F.split(even, " ")), lambda p: (F.size(p) >= 6) & F.get(p, F.lit(0)).rlike(semester))
    # The first three columns are no numbers: a semester alone takes longer to be read as one than all others.
    made = F.transform(fits, lambda p: F.struct(p.alias("p"), F.transform(p, lambda x, i: F.when(i >= 3, S.first_number(x))).alias("v")))
    rows = rows.where(F.col("line").rlike(semester)).select("doc_id", "line_no", kept(made).alias("m")).select("doc_id", "line_no", F.inline("m"))
    spot = F.filter(F.sequence(F.lit(3), F.least(F.size("p"), F.lit(10)) - 1), lambda i: (F.get("v", i) > 0) & (F.get("v", i) <= 20))
    rows = rows.select("doc_id", "line_no", "p", "v", kept(F.get(spot, F.lit(0))).alias("at")).where("at > 3").withColumn("s", S.parse_semester(F.get("p", F.lit(0))))
    later = F.filter(F.sequence(F.col("at") + 2, F.greatest(F.least(F.size("p"), F.col("at") + 6) - 1, F.col("at") + 2)), lambda i: (F.get("v", i) >= 0) & (F.get("v", i) <= 5))
    name = F.array_join(F.slice("p", F.lit(4), F.greatest(F.col("at") - 3, F.lit(0))), " ")
    out = rows.select(
        "doc_id",
        "line_no",
        F.col("s.academic_year").alias("academic_year"),
        F.concat_ws("-", "s.academic_year", "s.term").alias("semester"),
        F.get("p", F.lit(1)).alias("course_code"),
        F.get("p", F.lit(2)).alias("course_seq"),
        name.alias("course_name"),
        F.get("v", F.col("at")).alias("credit"),
        F.get("v", F.col("at") + 1).alias("score"),
        F.get("v", F.get(later, F.lit(0))).alias("gpa"),
    )
    return out.where((F.col("course_name") != "") & ~F.col("course_name").rlike(r"(?U)^\d+$"))


_TERM_TOKEN = r"(?U)20\d{2}\s*[-/]\s*20\d{2}\s*[-]?\s*[12一二]"


def courses_from_tokens(docs: DataFrame, line_courses: DataFrame) -> DataFrame:
    """Course rows of documents without line courses, from their stream of tokens (the whole text, as recognition may set one token a line).

    A course opens at a token with a semester that five tokens follow at least. Its credit is the next token from the third on that
    holds a number in (0, 20], however far; the words between (two characters or more, a letter among them) are its name, the score
    follows the credit, and the grade point is the first of the next four tokens with a number in [0, 5]. The search goes on two
    tokens after the credit. A semester without words before its credit opens no course; the next semester does.
    """
    left = docs.join(line_courses.select("doc_id").distinct(), "doc_id", "left_anti").where(F.col("text").rlike(_TERM_TOKEN))
    tokens = F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "")
    # Behind a generator, so that tokens are cut once.
    rows = left.select("doc_id", F.explode(F.array(tokens)).alias("p")).where(F.size("p") >= 6)
    rows = rows.select("doc_id", "p", F.explode(F.array(F.transform("p", S.first_number))).alias("v"))
    rows = rows.select("doc_id", "p", "v", kept(_walked(F.col("p"), F.col("v"))).alias("w")).select("doc_id", "p", "v", F.posexplode("w").alias("line_no", "c"))
    return rows.select("doc_id", "line_no", *_token_course(F.col("p"), F.col("v"), F.col("c")))


def _words(p: Column, start: Column, end: Column) -> Column:
    """The words of a name among the tokens from ``start`` to before ``end``."""
    span = F.slice(p, start + 1, F.greatest(end - start, F.lit(0)))
    return F.filter(span, lambda x: x.rlike("[一-鿿A-Za-z]") & (F.length(x) >= 2))


def _walked(p: Column, v: Column) -> Column:
    """``(start, at)`` of the courses among tokens ``p`` with numbers ``v``: where each opens and where its credit stands."""
    size = F.size(p)

    def opens(i: Column) -> Column:
        # Few tokens hold a year: the plain test spares the others the pattern.
        return F.coalesce((i + 5 < size) & F.get(p, i).contains("20") & F.get(p, i).rlike(_TERM_TOKEN), F.lit(False))

    def pays(i: Column) -> Column:
        return F.coalesce((F.get(v, i) > 0) & (F.get(v, i) <= 20), F.lit(False))

    events = F.filter(F.sequence(F.lit(0), size - 1), lambda i: opens(i) | pays(i))
    none = F.array().cast("array<struct<start:int,at:int>>")

    def state(resume: Column, start: Column, kept: Column) -> Column:
        return F.struct(resume.cast("int").alias("resume"), start.cast("int").alias("start"), kept.alias("kept"))

    def step(a: Column, k: Column) -> Column:
        """One event: an open course ends at its credit; without words, a semester right before that credit opens the next one."""
        start = a["start"]
        ends = (start >= 0) & (k >= start + 3) & pays(k)
        named = F.size(_words(p, start + 3, k)) > 0
        done = state(k + 2, F.lit(-1), F.concat(a["kept"], F.array(F.struct(start.alias("start"), k.alias("at")))))
        again = F.when((k - 2 > start) & opens(k - 2), k - 2).when((k - 1 > start) & opens(k - 1), k - 1).otherwise(-1)
        begins = (start < 0) & (k >= a["resume"]) & opens(k)
        return F.when(ends & named, done).when(ends, state(a["resume"], again, a["kept"])).when(begins, state(a["resume"], k, a["kept"])).otherwise(a)

    return F.aggregate(events, state(F.lit(0), F.lit(-1), none), step, lambda a: a["kept"])


def _token_course(p: Column, v: Column, c: Column) -> list[Column]:
    start, at = c["start"], c["at"]
    s = S.parse_semester(F.get(p, start))
    marks = F.filter(F.slice(v, at + 3, 4), lambda x: (x >= 0) & (x <= 5))
    return [
        s["academic_year"].alias("academic_year"),
        F.concat_ws("-", s["academic_year"], s["term"]).alias("semester"),
        F.get(p, start + 1).alias("course_code"),
        F.get(p, start + 2).alias("course_seq"),
        F.array_join(_words(p, start + 3, at), "").alias("course_name"),
        F.get(v, at).alias("credit"),
        F.get(v, at + 1).alias("score"),
        F.get(marks, F.lit(0)).alias("gpa"),
    ]


def _sound_name(name: Column) -> Column:
    return F.coalesce((F.length(S.trimmed(name)) >= 2) & ~S.trimmed(name).rlike(r"(?U)^\d+$"), F.lit(False))


def clean_courses(courses: DataFrame) -> DataFrame:
    """Courses with a real name; ``credit, score, gpa`` as doubles, unreadable ones null."""
    out = courses.where(_sound_name(F.col("course_name")))
    out = out.withColumn("course_name", S.trimmed(F.col("course_name")))
    for c in ("credit", "score", "gpa"):
        out = out.withColumn(c, F.replace(F.col(c).cast("string"), F.lit(","), F.lit("")).try_cast("double"))
    return out


def noisy_courses(docs: DataFrame, courses: DataFrame) -> DataFrame:
    """``(doc_id, n, bad, noisy)``: half of the names or more are blank, short, or mostly digits; no rows: noisy."""
    name = S.trimmed(F.coalesce("course_name", F.lit("")))
    bad = (F.length(name) <= 2) | (F.regexp_count(name, F.lit(r"(?U)\d")) > F.length(name) * 0.5)
    counts = courses.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    joined = docs.select("doc_id").join(counts, "doc_id", "left").na.fill({"n": 0, "bad": 0})
    return joined.withColumn("noisy", (F.col("n") == 0) | (F.col("bad") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2))))


def courses_from_transcript(rows: DataFrame) -> DataFrame:
    """Course rows out of transcript rows, as they are: ``score``, where that is empty or zero ``final_score``, where that is too ``score_total``.

    Columns that the rows lack are null.
    """

    def own(name: str, kind: str) -> Column:
        c = F.col(name) if name in rows.columns else F.lit(None)
        return c.try_cast(kind) if name in rows.columns else c.cast(kind)

    def held(name: str) -> Column:
        c = own(name, "string")
        return F.when((c != "") & (c.try_cast("double").isNull() | (c.try_cast("double") != 0) | F.lit(dict(rows.dtypes).get(name) == "string")), c)

    return rows.select(
        "doc_id",
        F.col("row").alias("line_no"),
        *[own(n, "string").alias(n) for n in ("academic_year", "semester", "course_code", "course_seq", "course_name")],
        own("credit", "double").alias("credit"),
        F.coalesce(held("score"), held("final_score"), own("score_total", "string")).try_cast("double").alias("score"),
        own("gpa", "double").alias("gpa"),
    )


#: Types whose courses a model may list anew.
COURSE_TYPES = ("成绩单", "成绩单/学业成绩表", "课程表", "课表/选课单")


def resolve_courses(
    rule: DataFrame, transcript: DataFrame, docs: DataFrame, types: DataFrame, model: DataFrame | None = None, image: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(courses, outcome)``: courses of rules and transcripts, and what became of them by document.

    Courses that a model read off the image replace rule courses that are missing or noisy. Rule courses are cleaned,
    transcript rows are added as they are. With a ``model`` (None: none is enabled) course documents whose list is shorter than three or noisy
    take the model's cleaned courses (``replace``) or, where it has none, lose theirs (``clear``); all else is kept (``keep``).
    """
    if image is not None:
        # Whether an image speaks at all is by its raw rows; what it then brings is clean.
        weak = noisy_courses(docs, rule).where("noisy").join(image.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id")
        rule = rule.join(weak, "doc_id", "left_anti").unionByName(clean_courses(image).join(weak, "doc_id", "left_semi"))
    own = clean_courses(rule).unionByName(transcript)
    if model is None:
        return own, docs.select("doc_id", F.lit("keep").alias("outcome"))
    # Each is used several times: to judge, and to choose by the judgement.
    own, offered = cut(own), cut(clean_courses(model).select(*own.columns))
    asked = types.where(F.col("document_type").isin(*COURSE_TYPES)).select("doc_id", F.lit(True).alias("asked"))
    judged = noisy_courses(docs, own).join(asked, "doc_id", "left").join(offered.select("doc_id", F.lit(True).alias("has")).distinct(), "doc_id", "left")
    weak = F.coalesce("asked", F.lit(False)) & ((F.col("n") < 3) | F.col("noisy"))
    outcome = cut(judged.select("doc_id", F.when(weak & F.coalesce("has", F.lit(False)), "replace").when(weak, "clear").otherwise("keep").alias("outcome")))
    gone, swapped = outcome.where("outcome <> 'keep'").select("doc_id"), outcome.where("outcome = 'replace'").select("doc_id")
    return own.join(gone, "doc_id", "left_anti").unionByName(offered.join(swapped, "doc_id", "left_semi")), outcome


_CLASS, _NAME, _SEX, _NO = "([A-Za-z0-9一-龥]{2,12})(?:班级)?", "([一-龥]{2,4})", "(男|女)", r"(?:^|\s)(?:(\d{1,3})\s+)?"
# Column orders of rosters (pattern, groups of class, name and gender).
ROSTER_ORDERS = (
    (rf"(?U){_NO}{_CLASS}\s+{_NAME}\s+{_SEX}", (2, 3, 4)),
    (rf"(?U){_NO}{_CLASS}\s+{_SEX}\s+{_NAME}", (2, 4, 3)),
    (rf"(?U){_NO}{_SEX}\s+{_CLASS}\s+{_NAME}", (3, 4, 2)),
    (rf"(?U){_NO}{_NAME}\s+{_CLASS}\s+{_SEX}", (3, 2, 4)),
)


def _gendered(docs: DataFrame) -> DataFrame:
    """Documents that hold a gender: no others can hold a member, and the patterns are slow."""
    return docs.where(F.col("text").contains("男") | F.col("text").contains("女"))


def _triples(text: Column) -> Column:
    """All matches of the four column orders as ``(pattern, at, no, class, name, gender)``."""

    def members(order: int) -> Column:
        pattern, (c, n, g) = ROSTER_ORDERS[order]
        groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(a) for k, a in ((1, "no"), (c, "class"), (n, "name"), (g, "gender"))]
        return F.transform(F.arrays_zip(*groups), lambda m, at: F.struct(F.lit(order).alias("pattern"), at.alias("at"), *[m[a].alias(a) for a in ("no", "class", "name", "gender")]))

    return F.concat(*[members(order) for order in range(len(ROSTER_ORDERS))])


def members_of(text: Column) -> Column:
    """The rows of :func:`roster_rows` of a text as an array of ``(number, class, name, gender)`` in order; null for texts that hold no gender."""
    key, place = ("class", "name", "gender"), ("pattern", "at", "no")

    def struct(m: Column, *names: str) -> Column:
        return F.struct(*[m[n].alias(n) for n in names])

    sound = F.filter(_triples(text), lambda m: F.length(m["class"]).between(3, 12) & m["class"].rlike(r"(?U)\d") & m["class"].rlike("[A-Za-z一-龥]"))
    # Sorted by what they say, equal ones stand side by side: the first stays.
    same = F.array_sort(F.transform(sound, lambda m: struct(m, *key, *place)))
    once = let(same, lambda s: F.filter(s, lambda m, i: ~struct(m, *key).eqNullSafe(struct(F.get(s, i - 1), *key))))
    ranked = F.array_sort(F.transform(once, lambda m: struct(m, *place, *key)))
    numbered = F.transform(ranked, lambda m, i: F.struct(F.coalesce(F.nullif(m["no"], F.lit("")).try_cast("int"), i + 1).alias("number"), m.alias("m")))
    # A number of zero counts as none: such members stand last.
    sorted_ = F.array_sort(F.transform(numbered, lambda x: F.struct(F.coalesce(F.nullif(x["number"], F.lit(0)), F.lit(1_000_000)).alias("o"), x["m"]["pattern"].alias("pattern"), x["m"]["at"].alias("at"), x.alias("x"))))
    made = F.transform(sorted_, lambda y: F.struct(y["x"]["number"].alias("number"), *[y["x"]["m"][n].alias(n) for n in key]))
    return F.when(text.contains("男") | text.contains("女"), made)


def roster_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, number, class, name, gender, ord)``: members of rosters in four column orders, each once, sorted by number (zero last).

    A class has 3-12 characters with a digit and a letter, a name 2-4 characters; a member without a number gets its rank.
    """
    # All orders in one pass: the parts of a union would each read the texts.
    found = _gendered(docs).select("doc_id", kept(_triples(F.col("text"))).alias("m")).select("doc_id", F.inline("m"))
    sound = F.length("class").between(3, 12) & F.col("class").rlike(r"(?U)\d") & F.col("class").rlike("[A-Za-z一-龥]")
    once = Window.partitionBy("doc_id", "class", "name", "gender").orderBy("pattern", "at")
    rows = found.where(sound).withColumn("__r", F.row_number().over(once)).where("__r = 1")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("pattern", "at"))
    rows = rows.withColumn("number", F.coalesce(F.nullif("no", F.lit("")).try_cast("int"), rank))
    # A number of zero counts as none: such members stand last.
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce(F.nullif("number", F.lit(0)), F.lit(1_000_000)), "pattern", "at"))
    return rows.select("doc_id", "number", "class", "name", "gender", order.alias("ord"))


_CLS, _SHORT = "([A-Za-z0-9一-龥]{2,12}(?:班级)?)", "([一-龥]{1,4})"
_SAMPLES = ((rf"(?U){_CLS}\s+{_SHORT}\s+(男|女)", (1, 2, 3)), (rf"(?U){_SHORT}\s+(男|女)\s+{_CLS}", (3, 1, 2)))


def roster_sample(docs: DataFrame) -> DataFrame:
    """``(doc_id, class, name, gender)``: the first triple, class first preferred; documents without one are left out."""
    return _gendered(docs).select("doc_id", sample_of(F.col("text")).alias("r")).where("r IS NOT NULL").select("doc_id", "r.*")


def sample_of(t: Column) -> Column:
    """A text's first triple as ``(class, name, gender)``, null without one."""
    picks = [F.when(t.rlike(p), F.struct(*[F.regexp_extract(t, p, k).alias(a) for k, a in zip(g, ("class", "name", "gender"))])) for p, g in _SAMPLES]
    return F.when(t.contains("男") | t.contains("女"), F.coalesce(*picks))


def roster_class(docs: DataFrame) -> DataFrame:
    """``(doc_id, class)``: the commonest class, among full triples, else before a gender, else among class-like tokens."""

    rows = docs.select("doc_id", kept(_class_names(F.col("text"))).alias("c")).select("doc_id", F.posexplode("c").alias("at", "class"))
    counts = rows.groupBy("doc_id", "class").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    return counts.groupBy("doc_id").agg(F.max_by("class", F.struct("n", -F.col("at"))).alias("class"))


def class_of(text: Column) -> Column:
    """A text's commonest class, of equally common ones the first; null without any."""
    each = F.array_sort(F.transform(_class_names(text), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    # Sorted, equal ones stand side by side: a run's length is the way to where the next one begins.
    runs = let(each, lambda s: F.filter(F.transform(s, lambda e, k: F.struct(k.alias("k"), e["x"].alias("x"), e["i"].alias("i"), (~e["x"].eqNullSafe(F.get(s, k - 1)["x"])).alias("new"))), lambda r: r["new"]))
    counted = let(F.size(each), lambda size: let(runs, lambda r: F.transform(r, lambda e, k: F.struct((F.coalesce(F.get(r, k + 1)["k"], size) - e["k"]).alias("n"), (-e["i"]).alias("at"), e["x"].alias("x")))))
    return F.array_max(counted)["x"]


def _class_names(text: Column) -> Column:
    """The class-like words that :func:`roster_class` counts."""

    def listed(*patterns: str) -> Column:
        return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])

    strict = listed(rf"(?U){_CLS}\s+[一-龥]{{1,4}}\s+(?:男|女)", rf"(?U)[一-龥]{{1,4}}\s+(?:男|女)\s+{_CLS}")
    body = "([A-Za-z0-9一-龥]{2,12})"
    relaxed = listed(rf"(?U){body}\s+(?:男|女)", rf"(?U){body}\s+[一-龥]{{1,4}}\s+(?:男|女)")
    tokens = F.filter(listed(body), lambda x: x.rlike(r"[0-9软计信工班]"))
    return F.when(F.size(strict) > 0, strict).when(F.size(relaxed) > 0, relaxed).otherwise(tokens)
