"""Oracle SQL for the library's queries, over the same tables."""

from __future__ import annotations

from docloom.functions import packs
from docloom.functions.predicates import HEADERS
from docloom.operators import card
from docloom.operators.fields import EXPECTED, EXPECTED_OTHERWISE, INFERRED, LOAN_FIELDS, PROOF_FIELDS
from docloom.operators.lines import NOISE
from docloom.operators.shape import ALIASES, FLAT_NAMES
from docloom.sources.exchange import CLASS_PROMPT, CORRECTION_PROMPT, FIELD_PROMPT
from docloom.plans.fixtures import oracle as fixture


def _hits(words: list[str], text: str = "text") -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + ")"


_LEAVE, _ROSTERS, _MARKS, _TABLES = (fixture(n) for n in ("leave_forms", "rosters", "transcripts", "html_tables"))
_FORMS = f"SELECT doc_id * 4 AS doc_id, text FROM ({_LEAVE}) UNION ALL SELECT doc_id * 4 + 1, text FROM ({_ROSTERS}) UNION ALL SELECT doc_id * 4 + 2, text FROM ({_MARKS})"
_TRIM = "trim({}, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
_LINES = f"""
SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS line_no
FROM (SELECT doc_id, {_TRIM.format("l")} AS line, pos
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))
WHERE line <> ''
"""
_DIGITS = "(length(regexp_replace(line, '[^0-9]', '', 'g')) / greatest(length(line), 1)::DOUBLE)"
_SEPS = "(length(line) - length(regexp_replace(line, '[ \\t|,]', '', 'g')))"
_FREE = "SELECT doc_id, list_value(" + ", ".join(f"{{'s': {_hits(w)}, 'o': {-k}, 't': '{t}'}}" for k, (t, w) in enumerate(packs.TYPE_KEYWORDS.items())) + ") AS c FROM ({docs})"


def _free(docs: str) -> str:
    return f"""
SELECT doc_id, CASE WHEN b.s > 0 THEN b.t ELSE '未知' END AS document_type, CASE WHEN b.s > 0 THEN round_even(b.s / total::DOUBLE, 4) ELSE 0 END AS confidence
FROM (SELECT doc_id, list_sort(c)[-1] AS b, list_sum(list_transform(c, lambda x: x.s)) AS total FROM ({_FREE.replace('{docs}', docs)}))
"""


def _share_of(kind: str) -> str:
    """A type's share of keyword hits, null where no type has a hit."""
    own, every = packs.TYPE_KEYWORDS.get(kind, []), [f"{_hits(w)}" for w in packs.TYPE_KEYWORDS.values()]
    total = " + ".join(every)
    return f"CASE WHEN {total} > 0 THEN round_even({_hits(own)} / ({total})::DOUBLE, 4) ELSE 0 END" if own else "NULL::DOUBLE"


_COURSES = f"""
SELECT doc_id, pos - 1 AS line_no, p[1] AS semester, p[2] AS course_code, p[3] AS course_seq, p[4] AS name, p[5] AS kind, p[6] AS q, p[7] AS score, p[8] AS gpa
FROM (SELECT doc_id, string_split(l, ' ') AS p, pos
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM ({_MARKS})) WHERE pos > 1)
"""
_COURSE_ROWS = f"""
SELECT doc_id, line_no, semester, course_code, course_seq,
       CASE WHEN q::DOUBLE BETWEEN 1e-9 AND 20 THEN name || ' ' || kind
            WHEN score::DOUBLE BETWEEN 1e-9 AND 20 THEN name || ' ' || kind || ' ' || q
            ELSE name || ' ' || kind || ' ' || q || ' ' || score END AS course_name,
       CASE WHEN q::DOUBLE BETWEEN 1e-9 AND 20 THEN q::DOUBLE ELSE gpa::DOUBLE END AS credit,
       CASE WHEN q::DOUBLE BETWEEN 1e-9 AND 20 THEN score::DOUBLE END AS score,
       CASE WHEN q::DOUBLE BETWEEN 1e-9 AND 20 THEN gpa::DOUBLE END AS gpa
FROM ({_COURSES})
"""
_MEMBERS = f"""
SELECT doc_id, p[1]::INT AS number, p[2] AS class, p[3] AS name, p[4] AS gender, pos
FROM (SELECT doc_id, string_split(l, ' ') AS p, pos
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM ({_ROSTERS})) WHERE pos > 2)
"""
# The commonest class; where genders are missing a lone member's class is no commoner than the words of the heading.
_ROSTER_CLASS = f"SELECT doc_id, CASE WHEN count(*) > 1 OR doc_id % 5 IN (0, 1, 2) THEN any_value(class) WHEN doc_id % 5 = 3 THEN '班级成员表' ELSE '班级' END AS class FROM ({_MEMBERS}) GROUP BY doc_id"
_LEAVE_PARTS = f"""
SELECT doc_id, text, regexp_extract(text, '姓名：(\\S+)', 1) AS name, regexp_extract(text, '学号：([0-9]+)', 1) AS sid, regexp_extract(text, '班级：(\\S+)', 1) AS class,
       regexp_extract(text, '开始日期：(\\S+)', 1) AS day, regexp_extract(text, '手机号：_([0-9]+)', 1) AS phone, regexp_extract(text, '金额：([0-9]+)元', 1) AS amount
FROM ({_LEAVE})
"""
_BOXES = f"SELECT doc_id, line_no, line AS text, 0.5 + (length(line) % 64) / 128.0::DOUBLE AS confidence FROM ({_LINES})"
_OCR = f"""
SELECT d.doc_id, coalesce(b.text, '') AS text, coalesce(b.confidence, 0) AS confidence, coalesce(b.n, 0) AS total_boxes
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS text, round_even(avg(confidence::DOUBLE), 4) AS confidence, count(*) AS n FROM ({_BOXES}) GROUP BY doc_id) b USING (doc_id)
"""
_GRID = f"""
SELECT doc_id, pos - 1 AS row, list_transform(regexp_extract_all(r, '<td>(.*?)</td>', 1), lambda x: regexp_replace(x, '\\s+', '', 'g')) AS cells
FROM (SELECT doc_id, unnest(regexp_extract_all(html, '<tr>.*?</tr>')) AS r, generate_subscripts(regexp_extract_all(html, '<tr>.*?</tr>'), 1) AS pos FROM ({_TABLES}))
"""


def _matches(kind: str, rule: int, pattern: str, group: int, docs: str) -> str:
    return f"SELECT doc_id, {rule} AS rule, generate_subscripts(m, 1) AS ord, '{kind}' AS type, unnest(m) AS text FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', {group}) AS m FROM ({docs}))"


_KEYWORD = " UNION ALL ".join(
    f"SELECT doc_id, '{t}' AS doc_type, 0.15 + 0.05 * least({_hits(some)}, 5) AS score FROM f WHERE {_hits(some)} >= {least}"
    + "".join(f" AND contains(text, '{w}')" for w in every)
    + "".join(f" AND NOT contains(text, '{w}')" for w in none)
    for t, some, every, none, least in packs.KEYWORD_RULES
)
_PRIMARY = " ".join(f"WHEN document_type = '{t}' THEN '{p}'" for t, p in packs.PRIMARY_CLASS.items())

ORACLES: dict[str, str] = {
    "leave_form_records": f"SELECT doc_id, k.document_type AS doc_type, k.confidence, sid AS student_id, phone FROM ({_LEAVE_PARTS}) JOIN ({_free(_LEAVE)}) k USING (doc_id)",
    "a2_validate_requests": "SELECT doc_id::VARCHAR AS file_id, CASE WHEN length(text) > 50000 THEN 'text too long' WHEN text = '' THEN 'text or file is required' ELSE '' END AS message FROM documents",
    "a3_validate_files": """SELECT path, length, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'bmp', 'tiff', 'tif', 'webp', 'pdf') AND length <= 10485760 AS ok
FROM (SELECT url || ['.jpg', '.PDF', '.exe', ''][page_id % 4 + 1] AS path, page_id * 100000 AS length FROM pages)""",
    "a4_decode_payload": "SELECT page_id, sha256(html) AS payload_sha256, '.pdf' AS suffix FROM pages",
    "a5_to_data_url": """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'data:x' ELSE 'data:' || CASE WHEN page_id % 2 = 0 THEN 'image/jpeg' ELSE 'image/png' END || ';base64,' || url END AS data_url FROM pages""",
    "a10_success_envelope": """SELECT doc_id, '{"code":200,"message":"success","data":{"key":"' || md5(substr(text, 1, 2000)) || '"}}' AS value FROM documents""",
    "b1_boxes_to_bbox": "SELECT l_orderkey, trunc(min(l_linenumber * 10.5))::INT AS x0, trunc(min(l_quantity))::INT AS y0, trunc(max(l_linenumber * 10.5))::INT AS x1, trunc(max(l_quantity))::INT AS y1 FROM lineitem GROUP BY 1",
    "b2_assemble_text": f"SELECT doc_id, md5(text) AS text_md5, confidence, total_boxes FROM ({_OCR})",
    "b3_tile_windows": """SELECT doc_id, tile, lo, hi, vertical FROM (
SELECT doc_id, tile, greatest(tile * step - pad, 0)::BIGINT AS lo, (CASE WHEN tile = 2 THEN side ELSE least((tile + 1) * step + pad, side) END)::BIGINT AS hi, height >= 2000 AS vertical
FROM (SELECT o_orderkey AS doc_id, floor(o_totalprice)::BIGINT AS height, greatest(floor(o_totalprice)::BIGINT, 2000) AS side, greatest(floor(o_totalprice)::BIGINT, 2000) // 3 AS step,
             floor((greatest(floor(o_totalprice)::BIGINT, 2000) // 3) * 0.05::DOUBLE)::BIGINT AS pad, unnest([0, 1, 2]) AS tile FROM orders)) WHERE hi - lo >= 16""",
    "b4_long_page_flag": "SELECT o_orderkey, greatest(h, 1000) / greatest(least(h, 1000), 1)::DOUBLE >= 2.2 OR greatest(h, 1000) > 2600 AS long_page FROM (SELECT o_orderkey, floor(o_totalprice / 100) AS h FROM orders)",
    "b5_weak_text_flag": f"SELECT doc_id, length({_TRIM.format('text')}) < 25 OR confidence < 0.35 OR total_boxes <= 4 AS weak FROM ({_OCR})",
    "b7_strip_html": f"SELECT page_id, md5({_TRIM.format('t')}) AS plain_md5 FROM (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s{{2,}}', ' ', 'g') AS t FROM pages)",
    "c1_split_lines": f"SELECT doc_id, line_no, md5(line) AS line_md5 FROM ({_LINES})",
    "c3_segment_document": f"""SELECT doc_id, coalesce(least(n, 3), 0) AS n_header, coalesce(m, 0) AS n_meta, coalesce(t, 0) AS n_table, coalesce(n - t, 0) AS n_body FROM documents LEFT JOIN (
SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(line, '日期|时间|编号|盖章|证明')) AS m, count(*) FILTER ({_SEPS} >= 3 OR {_DIGITS} > 0.35) AS t FROM ({_LINES}) GROUP BY doc_id) USING (doc_id)""",
    "c5_split_text_sections": f"""SELECT doc_id, md5(coalesce(b, '')) AS body_md5, md5(coalesce(t, '')) AS table_md5 FROM documents LEFT JOIN (
SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT x) AS b, string_agg(line, chr(10) ORDER BY line_no) FILTER (x) AS t
FROM (SELECT *, {_DIGITS} >= 0.35 OR {_SEPS} >= 3 OR regexp_matches(line, '学分|绩点|成绩|课程') AS x FROM ({_LINES})) GROUP BY doc_id) USING (doc_id)""",
    "d1_html_table_to_grid": f"SELECT doc_id, row, array_to_string(cells, '|') AS cells FROM ({_GRID})",
    "d2_plain_table_to_grid": f"SELECT doc_id, line_no - 1 AS row, array_to_string([semester, course_code, course_seq, name, kind, q, score, gpa], '|') AS cells FROM ({_COURSES})",
    "d3_transcript_from_grid": f"SELECT doc_id, row, CASE WHEN regexp_matches(cells[1], '[0-9]{{4}}') THEN cells[1] END AS semester, cells[2] AS course_name, cells[1] AS credit, CASE WHEN length(cells[2]) <= 3 THEN cells[2] ELSE cells[3] END AS score, NULL::VARCHAR AS grade FROM ({_GRID})",
    "d5_courses_from_lines": f"SELECT * FROM ({_COURSE_ROWS})",
    "d7_clean_courses": f"SELECT doc_id, count(*) AS n, sum(credit) AS credits FROM ({_COURSE_ROWS}) GROUP BY doc_id",
    "d11_roster_rows": f"SELECT doc_id, number, class, name, gender FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, class, name, gender ORDER BY pos) AS r FROM ({_MEMBERS})) WHERE r = 1",
    "d12_roster_sample": f"SELECT doc_id, class, CASE WHEN doc_id % 5 = 2 THEN name[1] ELSE name END AS name, gender FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM ({_MEMBERS})) WHERE r = 1 AND doc_id % 5 IN (0, 2)",
    "d13_roster_class": f"SELECT doc_id, class FROM ({_ROSTER_CLASS})",
    "e1_emails": " UNION ALL ".join(f"SELECT doc_id, type, ord, text FROM ({_matches(t, r, p, 0, 'SELECT doc_id, text FROM documents')})" for t, r, p in (("PHONE", 19, "1[3-9][0-9]{9}"), ("EMAIL", 20, r"[A-Za-z0-9_.+\-]+@[A-Za-z0-9\-]+\.[A-Za-z0-9\-.]+"))),
    "e3_date_ranges": """SELECT o_orderkey AS doc_id, 'LEAVE_START_DATE' AS type, strftime(o_orderdate, '%Y-%m-%d') AS text FROM orders
UNION ALL SELECT o_orderkey, 'LEAVE_END_DATE', strftime(o_orderdate::DATE + 3, '%Y-%m-%d') FROM orders""",
    "e4_normalize_entities": f"SELECT doc_id, 'STUDENT_ID' AS type, sid AS text, 1 AS n FROM ({_LEAVE_PARTS}) UNION ALL SELECT doc_id, 'PHONE', phone, 1 FROM ({_LEAVE_PARTS})",
    "e5_clean_entities": f"SELECT doc_id, 0 AS rule, 1 AS ord, name AS text FROM ({_LEAVE_PARTS})",
    "e9_entity_slots": f"""SELECT doc_id, 'student_id' AS field_name, 'STUDENT_ID' AS field_type, sid AS field_value, 0.85 AS confidence FROM ({_LEAVE_PARTS})
UNION ALL SELECT doc_id, 'phone', 'PHONE', phone, 0.85 FROM ({_LEAVE_PARTS}) UNION ALL SELECT doc_id, 'reason', 'TEXT', '论文调研', 0.8 FROM ({_LEAVE_PARTS})
UNION ALL SELECT doc_id, 'start_date', 'DATE', day, 0.75 FROM ({_LEAVE_PARTS})""",
    "f1_extract_fields": f"""SELECT doc_id, 'student_id' AS field_name, sid AS field_value, 0.9 AS confidence, true AS is_valid FROM ({_LEAVE_PARTS})
UNION ALL SELECT doc_id, 'amount', amount, CASE WHEN amount::DOUBLE > 200000 THEN 0.45 ELSE 0.9 END, amount::DOUBLE <= 200000 FROM ({_LEAVE_PARTS})
UNION ALL SELECT doc_id, 'reason', '论文调研', 0.9, true FROM ({_LEAVE_PARTS}) UNION ALL SELECT doc_id, 'absent', NULL, 0, false FROM ({_LEAVE_PARTS})""",
    "f2_ner_fallback": f"SELECT doc_id, 'who' AS field_name, name AS field_value, 0.85 AS confidence FROM ({_LEAVE_PARTS})",
    "f4_summarize_fields": f"SELECT doc_id, 4 AS total_fields, 3 AS extracted_fields, round_even((0.9 + 0.9 + CASE WHEN amount::DOUBLE > 200000 THEN 0.45 ELSE 0.9 END) / 3.0, 4) AS confidence, 'success' AS status FROM ({_LEAVE_PARTS})",
    "f6_infer_roster_fields": f"""WITH s AS (SELECT *, doc_id % 5 AS kind FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN doc_id % 5 = 0 THEN CASE number WHEN 0 THEN 1000000 ELSE number END ELSE pos END, pos) AS r FROM ({_MEMBERS}))
             JOIN (SELECT doc_id, class AS most FROM ({_ROSTER_CLASS})) USING (doc_id) WHERE r = 1 AND doc_id % 5 <> 4)
SELECT doc_id, 0 AS field_ord, 'class' AS field_name, 'CLASS' AS field_type, CASE WHEN kind IN (0, 2) THEN class ELSE most END AS field_value, CASE WHEN kind IN (0, 2) THEN 0.85 ELSE 0.9 END AS confidence, -1 AS start, CASE WHEN kind IN (0, 2) THEN 13 ELSE 15 END AS n_context FROM s
UNION ALL SELECT doc_id, 1, 'name', 'PERSON', CASE kind WHEN 0 THEN name WHEN 2 THEN name[1] ELSE '性别' END, CASE WHEN kind IN (0, 2) THEN 0.85 ELSE 0.9 END, CASE WHEN kind IN (1, 3) THEN 12 ELSE -1 END,
       CASE WHEN kind IN (0, 2) THEN 13 ELSE least(length(worn), 37) END FROM s JOIN (SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN regexp_replace(text, ' [一-龥]{{3}} ([男女])', ' \\1', 'g') ELSE regexp_replace(text, ' [男女]', ' ', 'g') END AS worn FROM ({_ROSTERS})) USING (doc_id)
UNION ALL SELECT doc_id, 2, 'gender', 'TEXT', CASE WHEN kind IN (0, 2) THEN gender END, CASE WHEN kind IN (0, 2) THEN 0.85 ELSE 0 END, -1, CASE WHEN kind IN (0, 2) THEN 13 ELSE 0 END FROM s""",
    "g1_classify_free": _free(_FORMS),
    "g3_keyword_rules": f"WITH f AS ({_FORMS}) SELECT doc_id, doc_type, round(max(score)::DOUBLE, 6) AS score FROM ({_KEYWORD}) GROUP BY doc_id, doc_type",
    "g7_primary_type": f"SELECT doc_id, document_type AS doc_type, CASE {_PRIMARY} ELSE 'other' END AS primary_type FROM ({_free(_FORMS)})",
    "h7_build_blocks": f"SELECT doc_id, name, sid AS student_id, NULL::DOUBLE AS loan_amount FROM ({_LEAVE_PARTS})",
    "i_scalars": f"""SELECT doc_id, day, substr(day, 1, 8) || '01' AS strict_day, phone, sid AS student_id, amount::DOUBLE AS money, round_even((doc_id % 120) / 12.0::DOUBLE, 2) AS years,
       md5(substr(text, 1, 2000)) AS key, substr(text, 1, 10) || '... (+' || (length(text) - 10)::VARCHAR || ' chars)' AS preview, false AS label, class FROM ({_LEAVE_PARTS})""",
    "i11_parse_semester": f"SELECT doc_id, line_no, substr(semester, 1, 9) AS academic_year, substr(semester, 11, 1) AS term, course_code::DOUBLE AS code FROM ({_COURSE_ROWS})",
    "i12_cache_key": "SELECT doc_id, md5(substr(text, 1, 2000)) AS key, md5(CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '... (+' || (length(text) - 200)::VARCHAR || ' chars)' ELSE text END) AS preview_md5 FROM documents",
    "k3_parse_model_replies": """SELECT conv_id * 1000 + turn AS doc_id, CASE WHEN turn % 2 = 0 THEN '通知' ELSE 'generic_document' END AS document_type, CASE WHEN turn % 2 = 0 THEN 0.5 ELSE 0 END AS confidence,
CASE WHEN turn % 2 = 0 THEN md5(text) END AS summary FROM conversations""",
    "k4_needs_model": f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'none' WHEN length({_TRIM.format('text')}) < 25 OR confidence < 0.35 OR total_boxes <= 4 THEN 'image' WHEN doc_id % 2 = 0 THEN 'text' ELSE 'none' END AS route FROM ({_OCR})""",
}


def _lines_of(docs: str) -> str:
    return f"""SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS line_no
FROM (SELECT doc_id, {_TRIM.format("l")} AS line, pos
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM ({docs}))) WHERE line <> ''"""


def _rules(kind: str) -> list[int]:
    return [k for k, r in enumerate(packs.ENTITY_RULES) if r[0] == kind]


def _spans(rows: list[tuple[str, int, str, str]]) -> str:
    """Values behind their caption: the same digits may stand in an id or a phone before it."""
    return " UNION ALL ".join(
        f"SELECT doc_id, {rule} AS rule, 1 AS ord, '{kind}' AS type, {value} AS text, strpos(text, '{said}' || {value}) - 1 + {len(said)} AS start, strpos(text, '{said}' || {value}) - 1 + {len(said)} + length({value}) AS \"end\" FROM p"
        for kind, rule, said, value in rows
    )


_TABULAR = f"({_SEPS} >= 3 OR {_DIGITS} > 0.35)"
_BONUS = {"在校证明": 1, "学籍信息卡": 1, "请假条": 1}
_WEIGHTED = ", ".join(
    f"{{'s': ({_hits(w)} + {'CASE doc_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 0 END' if t in _BONUS else '0'}) * {'2.2' if t == '请假条' else 'CASE doc_id % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 1.8 ELSE 1 END' if t == '班级成员表' else '1'}::DOUBLE, 'o': {-k}, 't': '{t}'}}"
    for k, (t, w) in enumerate(packs.TYPE_KEYWORDS.items())
)
ORACLES |= {
    "c4_infer_doc_pattern": f"""WITH f AS ({_FORMS}), l AS ({_lines_of('SELECT * FROM f')})
SELECT doc_id, document_type AS doc_type, bool_or({_TABULAR}) AS has_table,
       coalesce(string_agg(line, '|' ORDER BY line_no) FILTER (line_no < 3 AND regexp_matches(line, '通知|证明|成绩|请假')), '') AS header_keywords,
       coalesce(string_agg(line, '|' ORDER BY line_no) FILTER (regexp_matches(line, '日期|时间|编号|盖章|证明') AND regexp_matches(line, '编号|日期|盖章')), '') AS meta_keywords
FROM l JOIN ({_free('SELECT * FROM f')}) USING (doc_id) GROUP BY doc_id, document_type""",
    "e1_extract_entities": f"WITH p AS ({_LEAVE_PARTS}) "
    + _spans(
        [("STUDENT_ID", r, "学号：", "sid") for r in _rules("STUDENT_ID")[:2]]
        + [("PHONE", r, "手机号：_", "phone") for r in _rules("PHONE")]
        + [("LEAVE_START_DATE", _rules("LEAVE_START_DATE")[0], "开始日期：", "day"), ("LEAVE_REASON", _rules("LEAVE_REASON")[0], "原因：", "'论文调研'"), ("SCHOLARSHIP_AMOUNT", _rules("SCHOLARSHIP_AMOUNT")[0], "金额：", "amount")]
    ),
    "e1_context": f"WITH p AS ({_LEAVE_PARTS}) "
    + " UNION ALL ".join(f"SELECT doc_id, {r} AS rule, 1 AS ord, substr(text, strpos(text, phone) - 10, length(phone) + 20) AS context FROM p" for r in _rules("PHONE")),
    "g2_classify_weighted": f"""SELECT doc_id, b.t AS document_type, round_even(b.s / total::DOUBLE, 4) AS confidence
FROM (SELECT doc_id, list_sort(c)[-1] AS b, list_sum(list_transform(c, lambda x: x.s)) AS total FROM (SELECT doc_id, list_value({_WEIGHTED}) AS c FROM ({_FORMS})))""",
    "g8_select_template": f"""SELECT doc_id, CASE WHEN c >= a AND c >= b AND c > 0 AND c > a AND c > b THEN 'transcript_v1' WHEN b > a THEN 'roster_v1' ELSE 'leave_v1' END AS template_id, round(least(greatest(a, b, c) / 15.0::DOUBLE, 1), 6) AS score
FROM (SELECT doc_id, (document_type = '请假条')::INT * 5 + {_hits(['请假', '手机号'])} AS a, (document_type = '班级成员表')::INT * 5 + {_hits(['序号', '性别'])} AS b, (document_type = '成绩单')::INT * 5 + {_hits(['成绩', '必修'])} AS c
      FROM ({_FORMS}) JOIN ({_free(_FORMS)}) USING (doc_id)) WHERE greatest(a, b, c) > 0""",
    "k1_build_model_input": f"""WITH f AS ({_LEAVE}), t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS lines FROM ({_lines_of('SELECT * FROM f')}) WHERE {_TABULAR} GROUP BY doc_id)
SELECT doc_id, md5('【清洗文本】' || chr(10) || text || coalesce(chr(10) || chr(10) || '【表格行】' || chr(10) || lines, '') || chr(10) || chr(10) || '【文档类型提示】' || chr(10) || '{{"document_type":"请假条"}}' || chr(10) || chr(10) || '【NORMALIZE_GUIDE】' || chr(10) || 'guide') AS input_md5
FROM f LEFT JOIN t USING (doc_id)""",
    "c7_assess_quality": """WITH s AS (
  SELECT doc_id, text, greatest(length(text), 1)::DOUBLE AS n, string_split(text, chr(10)) AS l,
         length(text) - length(regexp_replace(text, '[�?*]', '', 'g')) AS messy,
         length(regexp_replace(regexp_replace(text, '[^\\p{C}\\p{Z}]', '', 'g'), ' ', '', 'g')) AS noise
  FROM documents),
m AS (
  SELECT *, len(l) AS many, len(list_filter(l, lambda x: length(trim(x)) <= 2)) AS short,
         len(list_filter(l, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) > length(x) * 0.5)) AS digits FROM s),
q AS (SELECT *, 1 - least(1, messy / n * 5 + noise / n * 3 + 0.1::DOUBLE * short / greatest(many, 1)) AS score FROM m)
SELECT doc_id, CASE WHEN score >= 0.75 THEN 'good' WHEN score >= 0.5 THEN 'medium' WHEN score >= 0.3 THEN 'bad' ELSE 'critical' END AS level,
       array_to_string(list_sort(list_filter([CASE WHEN messy / n > 0.02 OR noise / n > 0.02 THEN '噪声字符过多' END, CASE WHEN digits > many * 0.5 THEN '表格未被解析' END,
         CASE WHEN short > many * 0.4 THEN '文本缺失' END, CASE WHEN regexp_matches(text, '[�?]') THEN '乱码' END], lambda x: x IS NOT NULL)), '|') AS problems
FROM q""",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _first_of(text: str, patterns, flags: str = "") -> str:
    """The first pattern's group 1 that is found, null without any."""
    tries = [f"CASE WHEN regexp_matches({text}, {_quoted(flags + p)}) THEN regexp_extract({text}, {_quoted(flags + p)}, 1) END" for p in patterns]
    return f"coalesce({', '.join(tries)})"


_CARDS, _LOANS = fixture("cards"), fixture("loans")
_STUDIES = f"SELECT doc_id * 2 AS doc_id, text FROM ({_LEAVE}) UNION ALL SELECT doc_id * 2 + 1, text FROM ({_CARDS})"
_PREFIX = "'^(?:姓名|学号|班级|专业班级|学院|院系|专业|电话|手机号|地址|家庭地址)[:：]\\s*'"


def _cleaned(value: str) -> str:
    inner = f"regexp_replace(trim(replace(trim({value}), '_', '')), {_PREFIX}, '')"
    return f"CASE WHEN {inner} NOT IN ('', ':', '：') THEN {inner} END"


def _day(value: str) -> str:
    """Year, month and day as yyyy-MM-dd, else null."""
    p = "'([0-9]{4})[年/.-]([0-9]{1,2})[月/.-]([0-9]{1,2})'"
    parts = [f"regexp_extract({value}, {p}, {k})" for k in (1, 2, 3)]
    return f"CASE WHEN regexp_matches({value}, {p}) THEN {parts[0]} || '-' || lpad({parts[1]}, 2, '0') || '-' || lpad({parts[2]}, 2, '0') END"


def _proof(kind: str, patterns) -> str:
    value = _first_of("text", patterns, "(?i)")
    return f"coalesce({_day(value)}, {value})" if kind == "DATE" else _cleaned(value)


def _proofs(docs: str) -> str:
    """Every proof field of every document, recomputed from its text."""
    listed = ", ".join(f"{{'o': {k}, 'n': '{n}', 'k': '{kind}', 'v': {_proof(kind, patterns)}, 'c': {c}::DOUBLE}}" for k, (n, kind, c, patterns) in enumerate(PROOF_FIELDS))
    return f"SELECT doc_id, f.o AS field_ord, f.n AS field_name, f.k AS field_type, f.v AS field_value, f.c AS confidence FROM (SELECT doc_id, unnest([{listed}]) AS f FROM ({docs}))"


def _expected(docs: str) -> str:
    """``(doc_id, document_type, names)``: the fields that a document's type is expected to have."""
    cases = " ".join(f"WHEN '{t}' THEN [{', '.join(repr(f[0]) for f in specs)}]" for t, specs in EXPECTED.items())
    return f"SELECT doc_id, document_type, CASE document_type {cases} ELSE [{', '.join(repr(f[0]) for f in EXPECTED_OTHERWISE)}] END AS names FROM ({_free(docs)})"


_STUDENT_ID = "CASE WHEN length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 6 AND 20 THEN regexp_replace(v, '[^0-9]', '', 'g') END"
_BY_KIND = f"CASE WHEN k = 'STUDENT_ID' THEN {_STUDENT_ID} WHEN k = 'DATE' THEN coalesce({_day('v')}, v) ELSE v END"
_TILES = ORACLES["b3_tile_windows"]
_SHARES = f"""SELECT doc_id, list_transform(c, lambda x: {{'t': x.t, 'k': -x.o, 's': CASE WHEN total > 0 THEN round_even(x.s / total::DOUBLE, 4) ELSE 0 END}}) AS c
FROM (SELECT doc_id, c, list_sum(list_transform(c, lambda x: x.s)) AS total FROM ({{scored}}))"""
_ANALYSIS = f"SELECT doc_id, u.t AS doc_type, u.s * 0.8::DOUBLE AS score, 2000 + u.k AS rank FROM (SELECT doc_id, unnest(c) AS u FROM ({_SHARES.replace('{scored}', _FREE.replace('{docs}', _FORMS))}))"
_NLP = f"SELECT doc_id, u.t AS doc_type, u.s * 0.9::DOUBLE AS score, 1000 + u.k AS rank FROM (SELECT doc_id, unnest(c) AS u FROM ({_SHARES.replace('{scored}', f'SELECT doc_id, list_value({_WEIGHTED}) AS c FROM ({_FORMS})')}))"
_FIRED = " UNION ALL ".join(
    f"SELECT doc_id, '{t}' AS doc_type, 0.15::DOUBLE + 0.05::DOUBLE * least({_hits(some)}, 5) AS score, 9200 + {k} AS rank FROM f WHERE {_hits(some)} >= {least}"
    + "".join(f" AND contains(text, '{w}')" for w in every)
    + "".join(f" AND NOT contains(text, '{w}')" for w in none)
    for k, (t, some, every, none, least) in enumerate(packs.KEYWORD_RULES)
)
_TRIPLE = "(?:[A-Za-z0-9一-龥]{2,12}(?:班级)?\\s*[一-龥]{2,4}\\s*(?:男|女))|(?:[一-龥]{2,4}\\s*(?:男|女)\\s*[A-Za-z0-9一-龥]{2,12}(?:班级)?)"
_BOOST = f"""SELECT doc_id, '班级成员表' AS doc_type, CASE WHEN n >= 5 THEN 0.99 ELSE 0.9 END::DOUBLE AS score
FROM (SELECT doc_id, text, len(regexp_extract_all(text, '{_TRIPLE}')) AS n FROM ({_FORMS}))
WHERE n >= 3 AND ((contains(text, '序号') AND contains(text, '班级') AND contains(text, '姓名')) OR (contains(text, '班级') AND contains(text, '性别')))"""
_PRIORITY = f"CASE WHEN doc_type IN ({', '.join(map(repr, packs.HIGH_PRIORITY))}) THEN 3 WHEN doc_type IN ({', '.join(map(repr, packs.MID_PRIORITY))}) THEN 2 ELSE 1 END"
_QUALITY = ORACLES["c7_assess_quality"]
_WORDS = f"SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS word_no FROM ({_CARDS})"
_BARE = "regexp_replace(w, '[：:]', '', 'g')"
_LABEL_LIKE = f"""({_BARE} <> '' AND ({_BARE} IN ('贷款信息', '贷款合同编号', '合同编号', '用款期限', '本次用款金额', '回执验证码', '验证码', '姓名及手机', '家长姓名及手机', '本人手机号', '微信号', 'QQ号', 'E-mail')
  OR (length({_BARE}) <= 6 AND NOT regexp_matches({_BARE}, '[0-9]') AND regexp_matches({_BARE}, '姓名|学院|专业|班级|账号|手机|联系方式'))))"""
_EARLIER = "regexp_matches(text, '开始日期：199[0-4]')"
_SURE = f"SELECT doc_id, count(*) AS n FROM ({_proofs(_LEAVE)}) WHERE field_value IS NOT NULL AND confidence >= 0.7 GROUP BY doc_id"

def _candidate(name: str, kind: str, words) -> tuple[str, str]:
    """Value and confidence of one candidate of a leave form, whose only entities are a person, an id, a phone and a date."""
    by_word = _first_of("text", [rf"{w}[:：]?\s*(\S[^\n\r]*)" for w in words], "(?i)")
    by_entity = {"PERSON": "name", "STUDENT_ID": "sid", "PHONE": "phone", "DATE": "day"}.get(kind, "NULL")
    by_shape = _first_of("text", [r"(?:班级|班)[:：]?\s*([A-Za-z0-9一-龥-]{2,20})"]) if kind == "CLASS" else "NULL"
    proof = next(((_proof(k, p), c) for n, k, c, p in PROOF_FIELDS if n == name), ("NULL::VARCHAR", 0))
    value = f"coalesce({proof[0]}, trim({by_word}), {by_entity}, {by_shape})"
    sure = f"CASE WHEN {proof[0]} IS NOT NULL THEN {proof[1]} WHEN {by_word} IS NOT NULL THEN 0.9 WHEN {by_entity} IS NOT NULL THEN 0.8 WHEN {by_shape} IS NOT NULL THEN 0.8 ELSE 0 END"
    return value, sure


def _inferred() -> str:
    known = {n for n, _, _ in INFERRED}
    rows = [(k, n, kind, *_candidate(n, kind, words)) for k, (n, kind, words) in enumerate(INFERRED)]
    rows += [(len(INFERRED) + k, n, kind, _proof(kind, p), str(c)) for k, (n, kind, c, p) in enumerate([f for f in PROOF_FIELDS if f[0] not in known])]
    listed = ", ".join(f"{{'o': {k}, 'n': '{n}', 'k': '{kind}', 'v': {v}, 'c': ({c})::DOUBLE}}" for k, n, kind, v, c in rows)
    return f"SELECT doc_id, f.o AS field_ord, f.n AS field_name, f.k AS field_type, f.v AS field_value, f.c AS confidence FROM (SELECT doc_id, unnest([{listed}]) AS f FROM ({_LEAVE_PARTS}))"


def _loan_rows() -> str:
    made = []
    for k, (n, c, patterns) in enumerate(LOAN_FIELDS):
        value = f"trim({_first_of('text', patterns)})"
        if n == "address":
            continue  # its pattern looks ahead; the rendered loans have no such line
        if n == "issue_date":
            value = _day(value)
        if n == "loan_amount":
            value = f"({value})::DOUBLE::VARCHAR"
        made.append(f"{{'n': '{n}', 'v': {value}, 'c': {c}::DOUBLE}}")
    return f"SELECT doc_id, f.n AS field_name, f.v AS field_value, f.c AS confidence FROM (SELECT doc_id, unnest([{', '.join(made)}]) AS f FROM ({_LOANS})) WHERE f.v IS NOT NULL"


_ALL_LABELS = (*card.LABELS, *card.CODE_LABELS)
_LABEL_AT = " UNION ALL ".join(
    f"SELECT doc_id, text, '{x}' AS label, {k} AS label_no, unnest(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, {len(x)}) = '{x}')) - 1 AS start FROM c WHERE contains(text, '{x}')" for k, x in enumerate(_ALL_LABELS)
)
_COLUMNS = ", ".join(f"max(field_value) FILTER (field_name = '{n}') AS {n}" if n in {f[0] for f in PROOF_FIELDS} else f"NULL::VARCHAR AS {n}" for n in FLAT_NAMES)
assert not {a for names in ALIASES.values() for a in names} & {f[0] for f in PROOF_FIELDS}

ORACLES |= {
    "a6_ensure_ids": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR END AS given, CASE WHEN doc_id % 2 = 0 THEN length(doc_id::VARCHAR) ELSE 36 END AS size FROM documents",
    "a8_required_to_fields": f"SELECT doc_id, array_to_string(names, '|') AS names FROM ({_expected(_FORMS)})",
    "a9_default_template": f"""WITH f AS ({_FORMS}), p AS (SELECT doc_id, regexp_extract(text, '姓名[:：]\\s*([^\\s]+)', 1) AS n, regexp_extract(text, '学号[:：]\\s*([0-9A-Za-z]+)', 1) AS s,
  coalesce(nullif(regexp_extract(text, '绩点[:：]?\\s*([0-9.]+)', 1), ''), '') AS g, regexp_extract(text, '总学分[:：]?\\s*([0-9.]+)', 1) AS t, regexp_extract(text, '统计时间[:：]?\\s*([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS d FROM f)
SELECT doc_id, u.n AS field_name, nullif(u.v, '') AS field_value, CASE WHEN u.v = '' THEN 0 ELSE 0.9 END AS confidence
FROM (SELECT doc_id, unnest([{{'n': 'student_name', 'v': n}}, {{'n': 'student_id', 'v': s}}, {{'n': 'average_gpa', 'v': g}}, {{'n': 'total_credit', 'v': t}}, {{'n': 'stat_date', 'v': d}}]) AS u FROM p)""",
    "a11_error_envelope": """SELECT '{"code":400,"message":"' || CASE WHEN page_id % 3 = 0 AND length(html) > 50000 THEN 'text too long' ELSE 'text or file is required' END || '"' || CASE WHEN page_id % 2 = 0 THEN ',"detail":"' || page_id::VARCHAR || '"' ELSE '' END || '}' AS value, count(*) AS n
FROM pages WHERE page_id % 3 <> 0 OR coalesce(html, '') = '' OR length(html) > 50000 GROUP BY 1""",
    "b3_merge_tiles": f"""WITH t AS ({_TILES}), b AS (
  SELECT l_orderkey AS doc_id, l_linenumber % 3 AS tile, l_suppkey AS x, l_partkey % 50 AS y, round(l_discount * 100) / 128.0::DOUBLE AS c FROM lineitem)
SELECT doc_id, sum(x + dx) AS sum_x0, sum(y + dy) AS sum_y0, sum(x + dx + 10) AS sum_x1, sum(y + dy + 20) AS sum_y1, round_even(avg(c::DOUBLE), 4) AS confidence, count(*) AS total_boxes
FROM (SELECT b.*, CASE WHEN vertical THEN 0 ELSE lo END AS dx, CASE WHEN vertical THEN lo ELSE 0 END AS dy FROM b JOIN t USING (doc_id, tile)) GROUP BY doc_id""",
    "b6_pick_best_variant": """WITH v AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS variant, max(floor(l_quantity)::INT) AS n, max(l_discount::DOUBLE) AS c, max(l_suppkey % 7) AS b FROM lineitem GROUP BY 1, 2),
r AS (SELECT doc_id, list_reduce(list({'v': variant, 'n': n, 'c': c, 'b': b} ORDER BY variant),
        lambda o, x: CASE WHEN x.n > 0 AND (x.n > o.n * 1.1::DOUBLE OR x.b > o.b OR x.c > o.c + 0.05::DOUBLE) THEN x ELSE o END) AS w FROM v GROUP BY doc_id)
SELECT doc_id, w.v AS variant, w.n AS n, w.b AS total_boxes FROM r""",
    "b8_fallback_text": f"""WITH p AS (SELECT page_id AS doc_id, {_TRIM.format("regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s{2,}', ' ', 'g')")} AS plain FROM pages),
x AS (SELECT doc_id, 0 AS kind, line_no, text FROM ({_BOXES}) UNION ALL SELECT doc_id, 1, 0, plain FROM p WHERE plain <> ''),
j AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY kind, line_no, text) AS pieces FROM x GROUP BY doc_id),
t AS (SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 IN (0, 1) THEN nullif(text, '') END, nullif(pieces, '')) AS text FROM documents d LEFT JOIN j USING (doc_id))
SELECT doc_id, md5(text) AS text_md5, text IS NULL AS rejected FROM t""",
    "c2_reconstruct_text": f"SELECT doc_id, CASE WHEN contains(d.text, chr(10)) AND l.joined IS NOT NULL THEN md5(l.joined) ELSE md5(d.text) END AS text_md5 FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS joined FROM ({_LINES}) GROUP BY doc_id) l USING (doc_id)",
    "c6_clean_text": f"SELECT doc_id, md5({_TRIM.format('t')}) AS clean_md5 FROM (SELECT doc_id, regexp_replace(replace(regexp_replace(text, '{'|'.join(NOISE)}', '', 'g'), chr(12288), ' '), '\\s{{2,}}', ' ', 'g') AS t FROM documents)",
    "c8_suggest_repair": f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN length({_TRIM.format('text')}) < 10 THEN '文本过短，建议重新拍照/提高分辨率' END,
  CASE WHEN level IN ('bad', 'critical') THEN 'OCR 质量较差：建议开启图像增强/去噪/倾斜矫正' END, CASE WHEN document_type = '未知' THEN '未能稳定判别文档类型：建议保证标题区域清晰' END], lambda x: x IS NOT NULL), '|') AS suggestions
FROM documents JOIN ({_QUALITY}) USING (doc_id) JOIN ({_free('SELECT doc_id, text FROM documents')}) USING (doc_id)""",
    "c10_fail_analysis": f"""WITH w AS (SELECT doc_id, unnest(names) AS field_name FROM ({_expected(_FORMS)})), g AS (SELECT doc_id, field_name FROM ({_proofs(_FORMS)}) WHERE field_value IS NOT NULL)
SELECT doc_id, string_agg(field_name, '|' ORDER BY field_name) AS missing FROM w ANTI JOIN g USING (doc_id, field_name) GROUP BY doc_id""",
    "c11_template_from_expected": f"SELECT doc_id, 'auto-' || document_type AS template_id, len(names) AS n_fields FROM ({_expected(_FORMS)})",
    "d8_noisy_courses": f"""SELECT doc_id, n, bad, n = 0 OR bad >= greatest(1, floor(n / 2)) AS noisy FROM (
SELECT m.doc_id, count(course_name) AS n, count(*) FILTER (length(trim(course_name)) <= 2 OR length(regexp_replace(course_name, '[^0-9]', '', 'g')) > length(course_name) * 0.5) AS bad
FROM ({_MARKS}) m LEFT JOIN ({_COURSE_ROWS}) c USING (doc_id) GROUP BY m.doc_id)""",
    "d9_courses_from_transcript": """SELECT l_orderkey AS doc_id, l_linenumber AS line_no, '2024-2025' AS academic_year, '2024-2025-' || (l_linenumber % 2 + 1) AS semester, l_partkey::VARCHAR AS course_code, NULL::VARCHAR AS course_seq,
  l_returnflag AS course_name, l_quantity::DOUBLE AS credit, CASE WHEN l_linenumber % 3 = 1 THEN l_suppkey::DOUBLE WHEN l_linenumber % 2 = 1 THEN l_quantity::DOUBLE ELSE l_partkey::DOUBLE END AS score, 3.5::DOUBLE AS gpa FROM lineitem""",
    "d10_resolve_courses": f"""WITH k AS (SELECT doc_id, count(*) AS k FROM ({_COURSE_ROWS}) GROUP BY doc_id), t AS (SELECT l_orderkey AS doc_id, count(*) AS t FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey),
n AS (SELECT doc_id, k, k + coalesce(t, 0) AS n, coalesce(t, 0) AS bad FROM k LEFT JOIN t USING (doc_id)),
o AS (SELECT *, CASE WHEN n >= 3 AND bad < greatest(1, floor(n / 2)) THEN 'keep' WHEN doc_id % 2 = 0 THEN 'replace' ELSE 'clear' END AS outcome FROM n)
SELECT doc_id, outcome, CASE outcome WHEN 'keep' THEN n WHEN 'replace' THEN k ELSE 0 END AS n, CASE outcome WHEN 'replace' THEN k ELSE 0 END AS from_model FROM o""",
    "e2_roster_entities": f"""WITH m AS (SELECT *, lead(number::VARCHAR) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM ({_MEMBERS})),
n AS (SELECT doc_id, count(*) + count(*) FILTER (length(after) >= 2) AS n FROM m GROUP BY doc_id)
SELECT doc_id, unnest(['CLASS', 'PERSON', 'GENDER']) AS type, n FROM n""",
    "e7_label_predicates": f"""SELECT doc_id, word_no, {_LABEL_LIKE} AS label,
  length(w) <= 20 AND regexp_matches(w, '姓名|性别|出生|民族|学校|学院|分院|系所|专业|层次|学制|学历|学习形式|学籍状态|入学|毕业|验证码|验证网址|课程|成绩|学年|学期|学分') AS key,
  w = '' OR {_LABEL_LIKE} OR regexp_matches(w, '^.*(姓名|手机|手机号|联系方式|微信|QQ|邮箱|E-?mail)[:：]?$') OR (regexp_matches(w, '(姓名|学号|班级|学院|专业|电话|手机号|地址)[:：]') AND length(w) <= 20) AS bad,
  w IN ({', '.join(map(_quoted, HEADERS))}) AS header FROM ({_WORDS})""",
    "e8_value_cleaners": f"SELECT doc_id, word_no, w AS value, CASE WHEN w NOT IN ('', ':', '：') THEN w END AS kv_value FROM ({_WORDS})",
    "e10_extract_relations": "SELECT 0 AS doc_id, '' AS head, '' AS relation, '' AS tail WHERE false",
    "e11_sample_details": f"SELECT doc_id, field_name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY field_ord) AS r FROM ({_proofs(_STUDIES)}) WHERE field_value IS NOT NULL) WHERE r <= 4",
    "f5_infer_fields": _inferred(),
    "f7_proof_fields": f"SELECT doc_id, field_name, field_value, confidence FROM ({_proofs(_STUDIES)}) WHERE field_value IS NOT NULL",
    "f8_loan_contract_fields": _loan_rows(),
    "f10_label_segments": f"""WITH c AS ({_CARDS}), h AS ({_LABEL_AT}),
n AS (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY start, label_no) AS next FROM h)
SELECT doc_id, label, trim(substr(text, start + length(label) + 1, greatest(coalesce(next, length(text)) - start - length(label), 0))) AS segment FROM n
WHERE trim(substr(text, start + length(label) + 1, greatest(coalesce(next, length(text)) - start - length(label), 0))) <> ''""",
    "g4_roster_boost": _BOOST,
    "g5_fuse_scores": f"""WITH f AS ({_FORMS}), e AS ({_ANALYSIS} UNION ALL SELECT doc_id, document_type, confidence * 0.8::DOUBLE, 1999 FROM ({_free('SELECT * FROM f')}) UNION ALL
  SELECT doc_id, doc_type, max(score), min(rank) FROM ({_FIRED}) GROUP BY doc_id, doc_type)
SELECT doc_id, doc_type, round(max(score), 6) AS score, min(rank) AS type_ord FROM e GROUP BY doc_id, doc_type HAVING max(score) > 0""",
    "g6_pick_type": f"""WITH f AS ({_FORMS}), e AS ({_NLP} UNION ALL {_ANALYSIS} UNION ALL SELECT doc_id, document_type, confidence * 0.8::DOUBLE, 1999 FROM ({_free('SELECT * FROM f')})
  UNION ALL SELECT doc_id, document_type, confidence * 0.9::DOUBLE, 999 FROM ({{weighted}})
  UNION ALL SELECT doc_id, doc_type, max(score), min(rank) FROM ({_FIRED}) GROUP BY doc_id, doc_type UNION ALL SELECT doc_id, doc_type, score, 9300 FROM ({_BOOST})),
x AS (SELECT doc_id, doc_type, max(score) AS score, min(rank) AS rank FROM e GROUP BY doc_id, doc_type HAVING max(score) > 0)
SELECT doc_id, doc_type AS document_type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score * 10 + {_PRIORITY} DESC, rank) AS r FROM x) WHERE r = 1""".replace("{weighted}", ORACLES["g2_classify_weighted"]),
    "g9_merge_classification": f"""WITH b AS (SELECT *, doc_id % 3 = 0 AS i, doc_id % 5 <> 0 AS t, (doc_id % 100) / 100.0::DOUBLE AS c FROM ({_free(_FORMS)})),
m AS (SELECT *, CASE WHEN i AND (NOT t OR c <= 0.5) THEN '合同' WHEN t THEN '通知' END AS model FROM b)
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '成绩单' ELSE coalesce(model, document_type) END AS document_type, CASE model WHEN '合同' THEN 0.5 WHEN '通知' THEN c ELSE confidence END AS confidence,
  CASE WHEN doc_id % 7 = 0 THEN 0.1 WHEN model = '通知' THEN 0.5 WHEN model IS NULL THEN hits_notice END AS notice, CASE WHEN model = '合同' THEN 0.5 WHEN model IS NULL THEN hits_contract END AS contract
FROM m JOIN (SELECT doc_id, {_share_of('通知')} AS hits_notice, {_share_of('合同')} AS hits_contract FROM ({_FORMS})) USING (doc_id)""",
    "h1_merge_fields": f"""WITH e AS (SELECT doc_id, count(*) AS n, count(field_value) AS got, sum(confidence) FILTER (field_value IS NOT NULL) AS c FROM ({_proofs(_LEAVE)}) WHERE field_name <> 'student_id' GROUP BY doc_id)
SELECT doc_id, 4 + n AS n, 3 + got AS extracted_fields, round_even((0.9 + 0.9 + CASE WHEN amount::DOUBLE > 200000 THEN 0.45 ELSE 0.9 END + coalesce(c, 0)) / (3 + got)::DOUBLE, 4) AS confidence, 'success' AS status
FROM ({_LEAVE_PARTS}) JOIN e USING (doc_id)""",
    "h2_fix_fields": f"""SELECT doc_id, n AS field_name, {_BY_KIND} AS field_value, c AS confidence FROM (SELECT doc_id, field_name AS n, field_type AS k, field_value AS v, confidence AS c FROM ({_proofs(_STUDIES)})
  WHERE regexp_replace(field_value, '\\s', '', 'g') NOT IN ({', '.join(map(_quoted, HEADERS))})) WHERE {_BY_KIND} IS NOT NULL""",
    "h3_normalize_fields": f"""SELECT doc_id, n AS field_name, x AS field_value, CASE WHEN x IS NULL THEN 0 ELSE c END AS confidence, CASE WHEN x IS NULL THEN 'missing' ELSE 'ok' END AS status
FROM (SELECT doc_id, n, c, nullif({_BY_KIND}, '') AS x FROM (SELECT doc_id, field_name AS n, field_type AS k, field_value AS v, confidence AS c FROM ({_proofs(_STUDIES)})))""",
    "h4_flatten_fields": f"SELECT doc_id, {_COLUMNS} FROM ({_proofs(_STUDIES)}) GROUP BY doc_id",
    "h4_flatten_aliases": """SELECT o_orderkey AS doc_id, '后' AS name_1, CASE WHEN o_orderkey % 4 = 1 THEN '后' ELSE '前' END AS name,
  CASE o_orderkey % 4 WHEN 0 THEN '5' ELSE '7' END AS loan_amount, CASE o_orderkey % 4 WHEN 3 THEN '乙行' ELSE '甲行' END AS bank_name, NULL::VARCHAR AS loan_years FROM orders""".replace("'后' AS name_1, ", ""),
    "a7_load_templates": """SELECT 'nation_' || lpad(n_nationkey::VARCHAR, 2, '0') AS template_id, '请假条' AS document_type, 3 AS n_words,
  'class=班级[:：](软升' || lpad(n_nationkey::VARCHAR, 3, '0') || ')|amount=金额：([0-9]+)|student_id=学号[:：](?:20)([0-9]+)|bad=' AS fields FROM nation""",
    "g8_template_table": f"""SELECT doc_id, 'nation_' || right(class, 2) AS template_id, round(2 / 15.0::DOUBLE, 6) AS score FROM ({_LEAVE_PARTS})""",
    "f1_template_table": f"""WITH p AS (SELECT doc_id, text, class, amount, sid[3:] AS short FROM ({_LEAVE_PARTS})),
f AS (SELECT doc_id, 0 AS field_ord, 'class' AS field_name, class AS field_value, 0.9 AS confidence, '验证通过' AS message, instr(text, '班级：') - 1 AS start FROM p
UNION ALL SELECT doc_id, 1, 'amount', amount, CASE WHEN amount::DOUBLE > 200000 THEN 0.45 ELSE 0.9 END, CASE WHEN amount::DOUBLE > 200000 THEN 'Value above maximum (200000.0)' ELSE '验证通过' END, instr(text, '金额：') - 1 FROM p
UNION ALL SELECT doc_id, 2, 'student_id', short, CASE WHEN length(short) < 8 THEN 0.45 ELSE 0.9 END, CASE WHEN length(short) < 8 THEN 'Value too short (min: 8)' ELSE '验证通过' END, instr(text, '学号：') - 1 FROM p
UNION ALL SELECT doc_id, 3, 'bad', NULL, 0, 'Value not found', -1 FROM p)
SELECT * FROM f""",
    "i4_identities": """SELECT c_custkey, i || 'x' AS id_number, i || 'X' AS as_id_number, p AS as_phone, CASE WHEN length(c_custkey::VARCHAR) >= 6 THEN c_custkey::VARCHAR END AS as_student_id, '证号 ' || i || 'x' AS as_text
FROM (SELECT c_custkey, lpad(c_custkey::VARCHAR, 17, '3') AS i, '13' || lpad(c_custkey::VARCHAR, 9, '0') AS p FROM customer)""",
    "i10_numbers": "SELECT o_orderkey, floor(o_totalprice)::DOUBLE AS whole, NULL::DOUBLE AS not_whole, floor(o_totalprice)::DOUBLE + 0.25 AS first FROM orders",
    "j1_cache_lookup": f"SELECT f.doc_id, CASE WHEN {_EARLIER} THEN coalesce(n, 0) ELSE 0 END AS n_details FROM ({_LEAVE}) f LEFT JOIN ({_SURE}) USING (doc_id)",
    "j2_cache_upsert": f"""WITH e AS (SELECT md5(substr(text, 1, 2000)) AS key, doc_id, (NOT {_EARLIER})::INT AS age, n FROM ({_LEAVE}) JOIN ({_SURE}) USING (doc_id)),
p AS (SELECT key, age, doc_id AS place, n FROM e ORDER BY age DESC, place DESC LIMIT 100)
SELECT key, row_number() OVER (ORDER BY age, place) AS seq, n AS n_details FROM p""",
    "k5_apply_corrections": f"SELECT doc_id, CASE WHEN confidence < 0.7 THEN md5(md5(text)) ELSE md5(text) END AS text_md5, CASE WHEN confidence < 0.7 THEN 'llm' ELSE 'ocr' END AS source FROM ({_OCR})",
}

ORACLES["h6_post_process_contract"] = f"""WITH p AS (SELECT doc_id, text, regexp_extract(text, '贷款合同编号 ([0-9]+)', 1) AS contract, regexp_extract(text, '本次用款金额 ([0-9.]+)', 1)::DOUBLE AS amount,
  round_even(regexp_extract(text, '用款期限 ([0-9]+)', 1)::DOUBLE / 12, 2) AS years, regexp_extract(text, '(?:学生)[:：]?\\s*([^\\s]{{2,10}})', 1) AS name FROM ({_LOANS}))
SELECT doc_id, name, NULL::VARCHAR AS certificate_id, contract AS account_number, '安徽农村商业银行' AS bank_name, amount::VARCHAR AS loan_amount, years::VARCHAR AS loan_years,
  '类型 ' || document_type || '，借款人 ' || name || '，金额 ' || printf('%.1f', amount) || ' 元，期限 ' || printf('%.1f', years) || ' 年' AS summary
FROM p JOIN ({_free(_LOANS)}) USING (doc_id)"""

ORACLES["d4_format_tables"] = f"""WITH g AS (SELECT * FROM ({_GRID})), t AS (SELECT * FROM ({ORACLES['d3_transcript_from_grid']}))
SELECT doc_id, 'auto_table_1' AS name, row, '{{"col1":"' || cells[1] || '","col2":"' || cells[2] || '","col3":"' || cells[3] || '"}}' AS record FROM g
UNION ALL SELECT doc_id, 'transcript', row, '{{"semester":' || coalesce('"' || semester || '"', 'null') || ',"course_name":"' || course_name || '","credit":"' || credit::DOUBLE || '","score":"' || score::DOUBLE || '","grade":null}}' FROM t"""
ORACLES["f11_student_card"] = f"""WITH p AS (SELECT doc_id, text, regexp_extract(text, '系所 (\\S+)', 1) AS department, regexp_extract(text, '验证码 ([0-9]{{8,12}})', 1) AS code FROM ({_CARDS}))
SELECT doc_id, regexp_extract(text, '姓名 (\\S+)', 1) AS name, regexp_extract(text, '性别 (男|女)', 1) AS gender, regexp_extract(text, '民族 (\\S+)', 1) AS nation, NULL::VARCHAR AS id_number, code AS student_id,
  regexp_extract(text, '(\\S+)丨', 1) AS major, regexp_extract(text, '班级 (\\S+)', 1) AS class_name, department AS college, department, regexp_extract(text, '学校名称 (\\S+)', 1) AS school_name,
  regexp_extract(text, '学历类别 (\\S+)', 1) AS education_type, regexp_extract(text, '丨(\\S+)', 1) AS study_mode, {_day("regexp_extract(text, '入学日期 ([0-9]{4}年[0-9]{1,2}月[0-9]{1,2})', 1)")} AS enroll_date,
  regexp_extract(text, '学制 (\\S+)', 1) AS schooling_length, regexp_extract(text, '学号 ([0-9]+)', 1) AS verify_code FROM p"""


def _text(value: str) -> str:
    """A literal with line breaks, for SQL."""
    return " || chr(10) || ".join(_quoted(part) for part in value.split("\n"))


_LISTED = "- student_id (STUDENT_ID): \n- amount (NUMBER): \n- reason (TEXT): \n- absent (TEXT): \n文本：\n"
ORACLES |= {
    "c2_raw_tables": f"SELECT doc_id, row, array_to_string(cells, '|') AS cells FROM ({_GRID})",
    "k2_build_field_prompt": f"SELECT doc_id, md5({_text(FIELD_PROMPT + _LISTED)} || text) AS prompt_md5 FROM ({_LEAVE})",
    "k2_correction_prompt": f"SELECT doc_id, md5({_text(CORRECTION_PROMPT)} || text) AS prompt_md5 FROM documents",
    "k2_classification_prompt": f"SELECT doc_id, md5({_text(CLASS_PROMPT)} || text) AS prompt_md5 FROM documents",
}

_NUM = "coalesce(TRY_CAST(CASE WHEN regexp_full_match(replace({t}, ',', ''), '-?[0-9]+(\\.[0-9]+)?') THEN replace({t}, ',', '') END AS DOUBLE), TRY_CAST(nullif(regexp_extract({t}, '-?[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE))"
ORACLES["d6_courses_from_tokens"] = f"""WITH RECURSIVE t AS (
  SELECT doc_id, p, list_transform(p, lambda x: {_NUM.format(t='x')}) AS v, len(p) AS n
  FROM (SELECT doc_id, string_split(replace(replace(text, chr(10), ' '), '必修', '必修' || repeat(' — 选', (doc_id % 20)::INT)), ' ') AS p FROM ({_MARKS}))
),
h AS (SELECT *, list_filter(range(0, n), lambda i: regexp_matches(p[i + 1], '20[0-9]{{2}}[-/]20[0-9]{{2}}-?[12一二]')) AS heads, list_filter(range(0, n), lambda i: v[i + 1] > 0 AND v[i + 1] <= 20) AS pays FROM t),
walk AS (
  SELECT doc_id, 0 AS resume, -1::BIGINT AS start, -1::BIGINT AS paid FROM t
  UNION ALL
  SELECT doc_id, CASE WHEN named THEN pay + 2 ELSE head + 1 END, head, CASE WHEN named THEN pay ELSE -1 END
  FROM (
    SELECT doc_id, head, pay, len(list_filter(p[head + 4 : pay], lambda x: regexp_matches(x, '[一-鿿A-Za-z]') AND length(x) >= 2)) > 0 AS named
    FROM (
      SELECT h.doc_id, p, pays, n, head, list_filter(pays, lambda k: k >= head + 3)[1] AS pay
      FROM (SELECT w.doc_id, list_filter(heads, lambda i: i >= w.resume)[1] AS head FROM walk w JOIN h USING (doc_id)) s JOIN h USING (doc_id)
      WHERE head IS NOT NULL AND head + 5 < n
    ) WHERE pay IS NOT NULL
  )
),
c AS (SELECT w.*, p, v, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS line_no FROM walk w JOIN h USING (doc_id) WHERE paid >= 0)
SELECT doc_id, line_no, regexp_extract(p[start + 1], '(20[0-9]{{2}}-20[0-9]{{2}}-[12])', 1) AS semester, p[start + 2] AS course_code, p[start + 3] AS course_seq,
  array_to_string(list_filter(p[start + 4 : paid], lambda x: regexp_matches(x, '[一-鿿A-Za-z]') AND length(x) >= 2), '') AS course_name,
  v[paid + 1] AS credit, v[paid + 2] AS score, list_filter(v[paid + 3 : paid + 6], lambda x: x >= 0 AND x <= 5)[1] AS gpa
FROM c"""
_FORM_LINES = f"SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS line_no FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM ({_FORMS})) WHERE line <> ''"
ORACLES["c12_analyze_text"] = f"""WITH l AS (SELECT doc_id, count(*) FILTER ({_TABULAR}) AS t, count(*) FILTER (NOT {_TABULAR}) AS b FROM ({_FORM_LINES}) GROUP BY doc_id),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE number WHEN 0 THEN 1000000 ELSE number END, pos) AS r, count(*) OVER (PARTITION BY doc_id) AS n
  FROM (SELECT * FROM ({_MEMBERS}) QUALIFY row_number() OVER (PARTITION BY doc_id, class, name, gender ORDER BY pos) = 1))
SELECT k.doc_id, k.document_type, t AS n_table_lines, b AS n_body_lines, coalesce(n, 0) AS n_members, coalesce(n, 0) AS n_grid, len(e.names) AS n_expected, len(e.names) AS n_template,
  m.name AS first_member, m.number::VARCHAR || '|' || m.class || '|' || m.name || '|' || m.gender AS first_cells
FROM ({_free(_FORMS)}) k JOIN l USING (doc_id) JOIN ({_expected(_FORMS)}) e ON e.doc_id = k.doc_id LEFT JOIN m ON m.doc_id * 4 + 1 = k.doc_id AND m.r = 1"""
ORACLES["h5_map_loan_contract"] = f"""WITH l AS (SELECT doc_id, text, doc_id AS n, lpad(doc_id::VARCHAR, 12, '7') AS contract FROM ({fixture('loans')}))
SELECT doc_id, NULL::VARCHAR AS name, CASE WHEN n % 4 = 0 THEN lpad(n::VARCHAR, 17, '3') || 'X' ELSE lpad(n::VARCHAR, 17, '4') || 'x' END AS id_number, CASE WHEN n % 3 < 2 THEN '马鞍山师范学院' END AS school_name,
  CASE WHEN n % 2 = 1 THEN '计算机学院' WHEN n % 3 < 2 THEN '马鞍山师范学院' END AS college, CASE WHEN n % 7 = 0 THEN '会计学' ELSE '软件工程' END AS major, CASE WHEN n % 2 = 0 THEN '安徽省马鞍山市' END AS address,
  '安徽农村商业银行官庄支行' AS bank_name, CASE WHEN n % 5 = 1 THEN lpad(n::VARCHAR, 9, '8') WHEN n % 5 > 2 THEN lpad(n::VARCHAR, 12, '6') ELSE contract END AS account_number,
  regexp_extract(text, '本次用款金额 ([0-9.]+)', 1)::DOUBLE AS loan_amount, NULL::DOUBLE AS loan_years, CASE WHEN n % 5 > 2 THEN lpad(n::VARCHAR, 12, '6') ELSE contract END AS verify_code FROM l"""
ORACLES["h8_finalize"] = f"""WITH l AS (SELECT doc_id AS n, text, doc_id % 5 = 0 AS blank, CASE WHEN amount::DOUBLE > 200000 THEN 0.75 ELSE 0.9 END AS c FROM ({_LEAVE_PARTS}))
SELECT n AS doc_id, CASE WHEN n % 6 = 0 THEN '成绩单' ELSE '请假条' END AS document_type, CASE WHEN blank THEN 'failed' ELSE 'partial' END AS status, 4 AS n_details, CASE WHEN blank THEN 0 ELSE c END AS confidence_overall,
  '类型 ' || CASE WHEN n % 6 = 0 THEN '成绩单' ELSE '请假条' END || '，字段 ' || CASE WHEN blank THEN '0/4，置信度 0.00' ELSE '3/4，置信度 ' || printf('%.2f', c) END || CASE WHEN n % 3 <> 0 THEN '' WHEN blank THEN '，原因：无，原因：无' ELSE '，原因：无' END AS summary,
  array_to_string(list_filter([CASE WHEN n % 3 = 0 THEN '字段提取失败原因：无' END, CASE WHEN n % 2 = 0 THEN 'OCR 问题：甲；乙' END, CASE WHEN n % 6 = 0 THEN '未恢复课程表，可能 OCR 表格被拆散或缺失表格模型' END,
    CASE WHEN n % 4 = 0 THEN '课程列表疑似噪声，LLM 兜底未返回有效课程，已清空' END], lambda x: x IS NOT NULL), '|') AS notes,
  n::VARCHAR AS file_id, 'good' AS ocr_quality, 'nlp' AS source, CASE WHEN blank THEN 3 ELSE length(text) END AS n_text FROM l"""
ORACLES["h9_process"] = f"""SELECT p.doc_id, p.document_type, CASE p.doc_id % 4 WHEN 1 THEN 'success' ELSE 'partial' END AS status, CASE WHEN p.doc_id % 4 = 0 THEN l.sid END AS student_id, coalesce(c.n, 0) AS n_courses
FROM ({ORACLES["g6_pick_type"]}) p LEFT JOIN ({_LEAVE_PARTS}) l ON l.doc_id * 4 = p.doc_id LEFT JOIN (SELECT doc_id * 4 + 2 AS doc_id, count(*) AS n FROM ({_COURSE_ROWS}) GROUP BY 1) c ON c.doc_id = p.doc_id"""
ORACLES["a1_read_requests"] = "SELECT doc_id::VARCHAR AS file_id, md5(text) AS text_md5, doc_id % 2 = 0 AS llm_only, CASE WHEN doc_id % 2 = 0 THEN doc_id / 4.0::DOUBLE ELSE -1 END AS threshold, '' AS file_path FROM documents"
ORACLES["a10_write_responses"] = f"""SELECT value, count(*) AS n FROM ({ORACLES["a10_success_envelope"]}) GROUP BY value"""
ORACLES["a11_write_rejects"] = ORACLES["a11_error_envelope"]
ORACLES["s1_process_stream"] = f"""SELECT doc_id // 4 AS doc_id, document_type, status, student_id FROM ({ORACLES["h9_process"]}) WHERE doc_id % 4 = 0"""
# Earlier forms are read first and keep the lower places.
ORACLES["s2_stream_cache"] = ORACLES["j2_cache_upsert"]
