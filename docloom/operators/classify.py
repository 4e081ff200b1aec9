"""Document types: keyword scores, rules, fusion, choice and templates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import packs
from docloom.operators.lines import kept, let, step

UNKNOWN = "未知"


def _tests(words: list[str], text: str) -> list[str]:
    """A SQL test for each word. Packs hold hundreds: one parsed string for all is made far faster than as many Column calls."""
    quoted = [w.replace("\\", "\\\\").replace("'", "\\'") for w in words]
    return [f"contains({text}, '{w}')" for w in quoted]


def _sum(tests: list[str]) -> Column:
    return F.expr(" + ".join(f"CAST({t} AS INT)" for t in tests) or "0")


def _hits(words: list[str], text: str = "text") -> Column:
    return _sum(_tests(words, text))


def _any(words: list[str], text: str = "text") -> Column:
    return F.expr(" OR ".join(_tests(words, text)) or "false")


def _all(words: list[str], text: str = "text") -> Column:
    return F.expr(" AND ".join(_tests(words, text)) or "true")


def _told(words: list[str], text: str = "text") -> Column:
    """The text with all runs of characters that no word holds as one line break: a word is in it exactly where it is in the text."""
    held = {c for w in words for c in w}
    # One range for the common ideographs: hundreds of single characters would be tried one by one.
    others = "".join(sorted(re.escape(c) for c in held if not "一" <= c <= "龥" and c != "\n"))
    return F.regexp_replace(text, f"[^一-龥{others}]+", "\n")


def _gates(words: list[str]) -> dict[str, str]:
    """For words that share two characters in a row, those two: a text without them holds none of the words."""
    left, gates = sorted({w for w in words if len(w) >= 2}), {}
    while True:
        shared = Counter(pair for w in left for pair in {w[i : i + 2] for i in range(len(w) - 1)})
        pair, n = min(shared.items(), key=lambda x: (-x[1], x[0]), default=("", 0))
        if n < 2:
            return gates
        gates |= {w: pair for w in left if pair in w}
        left = [w for w in left if w not in gates]


def _marked(docs: DataFrame, words: list[str]) -> tuple[DataFrame, Callable[[list[str]], list[str]]]:
    """``docs`` with what tests of words need, each made once behind a generator, and the maker of SQL tests."""
    gates = _gates(words)
    pairs = sorted(set(gates.values()))
    opened = F.struct(*[F.expr(t).alias(f"g{k}") for k, t in enumerate(_tests(pairs, "__told"))])
    rows = docs.select("*", kept(_told(words)).alias("__told")).select("*", kept(opened).alias("__g"))
    return rows, _gated(gates, pairs, "__g.g")


def _gated(gates: dict[str, str], pairs: list[str], names: str) -> Callable[[list[str]], list[str]]:
    """The maker of SQL tests of words on ``__told``, behind the columns of their gates."""

    def tests(asked: list[str]) -> list[str]:
        plain = dict(zip(asked, _tests(asked, "__told")))
        gate = {w: f"{names}{pairs.index(gates[w])}" for w in asked if w in gates}
        return [gate[w] if gates.get(w) == w else f"({gate[w]} AND {t})" if w in gate else t for w, t in plain.items()]

    return tests


#: Types scored by one step: more of them outgrow what the JVM compiles as one method.
_STEP = 6


def _judged(docs: DataFrame, scores: dict[str, Column], carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` reduced to ``carried`` with the best type, its share and every type's share; ``scores`` by type, of equal ones the first wins."""
    kinds, names = list(scores), [f"__s{k}" for k in range(len(scores))]
    rows = docs
    for at in range(0, len(kinds), _STEP):
        # Behind generators of one row, so that each step is made once and stays a step of its own.
        made = F.struct(*[scores[t].alias(n) for t, n in zip(kinds[at : at + _STEP], names[at : at + _STEP])])
        rows = rows.select("*", kept(made).alias(f"__p{at}"))
    rows = rows.select(*carried, *[F.col(f"__p{k - k % _STEP}.{n}").alias(n) for k, n in enumerate(names)])
    total = reduce(Column.__add__, [F.col(n) for n in names])
    rows = rows.select("*", kept(F.struct(total.alias("total"), F.greatest(*names).alias("most"))).alias("__t"))
    most, total = F.col("__t.most"), F.col("__t.total")
    best = F.coalesce(*[F.when(F.col(n) == most, F.lit(t)) for t, n in zip(kinds, names)])
    # Most scores are zero: only the others need to be rounded.
    shares = [F.when((total > 0) & (F.col(n) > 0), F.bround(F.col(n) / total, 4)).otherwise(0.0) for n in names]
    return rows.select(
        *carried,
        F.when(most > 0, best).otherwise(UNKNOWN).alias("document_type"),
        F.when(most > 0, F.bround(most / F.greatest(total, F.lit(1e-300)), 4)).otherwise(0.0).alias("confidence"),
        F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*shares)).alias("probabilities"),
    )


def classified(docs: DataFrame) -> DataFrame:
    """``docs`` with ``document_type, confidence, probabilities`` of :func:`classify_free`, made within the row."""
    rows, tests = _marked(docs, [w for words in packs.TYPE_KEYWORDS.values() for w in words])
    return _judged(rows, {t: _sum(tests(words)).cast("double") for t, words in packs.TYPE_KEYWORDS.items()}, tuple(docs.columns))


def classify_free(docs: DataFrame) -> DataFrame:
    """``(doc_id, document_type, confidence, probabilities)`` by the number of a type's keywords in the text."""
    return classified(docs.select("doc_id", "text")).drop("text")


def classify_weighted(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Keyword scores with bonuses for entity types and weights for leave forms and rosters."""
    kinds = entities.groupBy("doc_id").agg(F.collect_set("type").alias("__kinds"))
    joined = docs.join(kinds, "doc_id", "left")

    def has(kind: str, bonus: int) -> Column:
        return F.when(F.coalesce(F.array_contains("__kinds", kind), F.lit(False)), bonus).otherwise(0)

    joined, tests = _marked(joined, [*[w for words in packs.TYPE_KEYWORDS.values() for w in words], *packs.LEAVE_WORDS, *packs.ROSTER_WORDS])
    leave, roster = F.expr(" OR ".join(tests(packs.LEAVE_WORDS))), F.expr(" AND ".join(tests(packs.ROSTER_WORDS)))
    found = {}
    for kind, words in packs.TYPE_KEYWORDS.items():
        score = _sum(tests(words))
        if kind in ("成绩单", "课程表"):
            score = score + has("COURSE", 2) + has("SCORE", 2)
        if kind in ("在校证明", "学籍信息卡", "请假条"):
            score = score + has("PERSON", 2) + has("STUDENT_ID", 2) + has("PHONE", 1)
        weight = F.lit(2.2) if kind == "请假条" else F.when(leave, 0.1).when(roster, 1.8).otherwise(1.0) if kind == "班级成员表" else F.lit(1.0)
        found[kind] = (score * weight).cast("double")
    return _judged(joined, found)


def keyword_rules(docs: DataFrame) -> DataFrame:
    """``(doc_id, doc_type, score)``: 0.15 and 0.05 for each of up to five hits of the rules that hold; the best by type."""
    fired = []
    for k, (kind, some, every, none, least) in enumerate(packs.KEYWORD_RULES):
        hits = _hits(some)
        holds = ~_any(none) & _all(every) & (hits >= least)
        fired.append(F.when(holds, F.struct(F.lit(kind).alias("doc_type"), F.lit(k).alias("ord"), (0.15 + 0.05 * F.least(hits, F.lit(5))).alias("score"))))
    rows = docs.select("doc_id", kept(F.array_compact(F.array(*fired))).alias("f")).select("doc_id", F.inline("f"))
    return rows.groupBy("doc_id", "doc_type").agg(F.max("score").alias("score"), F.min("ord").alias("ord"))


_CLASS, _NAME = "[A-Za-z0-9一-龥]{2,12}", "[一-龥]{2,4}"
ROSTER_TRIPLE = rf"(?U)(?:{_CLASS}(?:班级)?\s*{_NAME}\s*(?:男|女))|(?:{_NAME}\s*(?:男|女)\s*{_CLASS}(?:班级)?)"


def roster_boost(docs: DataFrame) -> DataFrame:
    """``(doc_id, doc_type, score)``: 0.99 from five class-name-gender triples on, 0.9 from three, under roster headings."""
    text = F.col("text")
    n = F.regexp_count(text, F.lit(ROSTER_TRIPLE))
    heading = _all(["序号", "班级", "姓名"]) | _all(["班级", "性别"])
    # Counted once, and only where there is a heading and a gender.
    score = F.get(F.transform(F.array(n), lambda k: F.when(k >= 5, 0.99).when(k >= 3, 0.9)), F.lit(0))
    return docs.where(heading & _any(["男", "女"])).select("doc_id", F.lit("班级成员表").alias("doc_type"), score.alias("score")).where("score IS NOT NULL")


#: How much each source of scores counts.
SOURCE_WEIGHTS = {"llm": 1.0, "nlp": 0.9, "analysis": 0.8}


def long_scores(classified: DataFrame, source: str) -> DataFrame:
    """``(doc_id, source, doc_type, type_ord, score)`` of a classification, its winner's confidence included."""
    def row(kind: Column, at: Column, score: Column) -> Column:
        return F.struct(F.lit(source).alias("source"), kind.alias("doc_type"), at.cast("int").alias("type_ord"), score.alias("score"))

    # One generator for both: a union would make the classification twice.
    every = F.transform(F.map_entries("probabilities"), lambda e, i: row(e["key"], i, e["value"]))
    best = F.array(row(F.col("document_type"), F.lit(-1), F.col("confidence")))
    return classified.select("doc_id", kept(F.concat(F.coalesce(every, F.filter(best, lambda _: F.lit(False))), best)).alias("s")).select("doc_id", F.inline("s"))


def fuse_scores(*scores: DataFrame) -> DataFrame:
    """``(doc_id, doc_type, score, type_ord)``: by type the largest weighted score of any source."""
    every = reduce(DataFrame.unionByName, scores)
    weight = F.coalesce(*[F.when(F.col("source") == k, w) for k, w in SOURCE_WEIGHTS.items()], F.lit(1.0))
    rank = F.coalesce(*[F.when(F.col("source") == k, n) for n, k in enumerate(SOURCE_WEIGHTS)], F.lit(9)) * 1000
    return every.groupBy("doc_id", "doc_type").agg(F.max(F.col("score") * weight).alias("score"), F.min(rank + F.col("type_ord")).alias("type_ord"))


def pick_type(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc_id, doc_type)``: the most of ten times the score plus the type's priority; first wins; none: by keyword, else 其他."""
    priority = F.when(F.col("doc_type").isin(*packs.HIGH_PRIORITY), 3).when(F.col("doc_type").isin(*packs.MID_PRIORITY), 2).otherwise(1)
    best = candidates.groupBy("doc_id").agg(F.max_by("doc_type", F.struct(F.col("score") * 10 + priority, -F.col("type_ord"))).alias("__best"))
    # What the text says is read ahead of the join, so that texts do not go over the wire.
    return docs.select("doc_id", _by_keyword("text").alias("__else")).join(best, "doc_id", "left").select("doc_id", F.coalesce("__best", "__else", F.lit("其他")).alias("doc_type"))


def _by_keyword(text: str) -> Column:
    return (
        F.when(_any(["成绩单", "学业成绩表", "成绩列表"], text), "成绩单")
        .when(_any(["课程表", "课表"], text), "课程表")
        .when(_any(["班级"], text) & _any(["姓名", "序号"], text), "班级成员表")
        .when(_any(["学籍卡", "学籍信息卡"], text), "学籍卡")
        .when(_any(["在校证明", "在读证明"], text), "在校证明")
        .when(_any(["生源地助学贷款", "贷款合同编号"], text), "生源地助学贷款合同")
    )


def typed(docs: DataFrame, has: dict[str, str], carried: list[str] | None = None) -> DataFrame:
    """``docs`` with ``free_type`` of :func:`classify_free` and ``document_type, confidence, probabilities``, made within the row.

    The latter are what the keywords, the entities (``has`` names a column for PERSON, STUDENT_ID and PHONE each: whether the text holds
    one), the rules and the roster's shape give by :func:`classify_weighted`, :func:`fuse_scores`, :func:`pick_type` and :func:`merge_classification`
    without a model. Keywords are counted once for all of them. ``carried``: the columns of ``docs`` that are wanted on, and ``__told``,
    which holds every word of common ideographs that the text holds.
    """
    same = docs.columns if carried is None else carried
    kinds = list(packs.TYPE_KEYWORDS)
    words = [*[w for ws in packs.TYPE_KEYWORDS.values() for w in ws], *packs.LEAVE_WORDS, *packs.ROSTER_WORDS, *[w for _, *lists, _ in packs.KEYWORD_RULES for ws in lists for w in ws]]
    gates = _gates(words)
    pairs = sorted(set(gates.values()))
    tests = _gated(gates, pairs, "__g")
    heads = [["序号", "班级", "姓名"], ["班级", "性别"]]
    base = [*docs.columns, "__told"]
    rows = step(docs, {"__told": _told(words)})
    rows = step(rows, {f"__g{k}": F.expr(t) for k, t in enumerate(_tests(pairs, "__told"))})
    counts = {f"__n{k}": _sum(tests(packs.TYPE_KEYWORDS[t])) for k, t in enumerate(kinds)}
    # What a rule asks for without choice is few words: most texts lack them and need no more of the rule.
    counts |= {f"__h{k}": F.when(F.expr(" AND ".join(tests(every)) or "true"), _sum(tests(some))) for k, (_, some, every, _, _) in enumerate(packs.KEYWORD_RULES)}
    heading = reduce(Column.__or__, [_all(words, "__told") for words in heads])
    triples = F.when(heading & _any(["男", "女"], "__told"), F.regexp_count("text", F.lit(ROSTER_TRIPLE)))
    rows = step(rows, counts | {"__leave": F.expr(" OR ".join(tests(packs.LEAVE_WORDS))), "__roster": F.expr(" AND ".join(tests(packs.ROSTER_WORDS))), "__triples": triples})

    def bonus(kind: str, n: int) -> Column:
        return F.when(F.col(has[kind]), n).otherwise(0)

    weighted = {}
    for k, kind in enumerate(kinds):
        score = F.col(f"__n{k}")
        if kind in ("在校证明", "学籍信息卡", "请假条"):
            score = score + bonus("PERSON", 2) + bonus("STUDENT_ID", 2) + bonus("PHONE", 1)
        weight = F.lit(2.2) if kind == "请假条" else F.when(F.col("__leave"), 0.1).when(F.col("__roster"), 1.8).otherwise(1.0) if kind == "班级成员表" else F.lit(1.0)
        weighted[f"__w{k}"] = (score * weight).cast("double")
    fired = {}
    for k, (_, _, _, none, least) in enumerate(packs.KEYWORD_RULES):
        hits = F.col(f"__h{k}")
        others = F.expr(" AND ".join(f"NOT ({t})" for t in tests(none)) or "true")
        fired[f"__r{k}"] = F.when((hits >= least) & others, 0.15 + 0.05 * F.least(hits, F.lit(5)))
    rows = step(rows, weighted | fired, [*base, *[f"__n{k}" for k in range(len(kinds))], "__triples"])
    n, w = ([F.col(f"__{c}{k}").cast("double") for k in range(len(kinds))] for c in "nw")
    totals = {"__nt": reduce(Column.__add__, n), "__nm": F.greatest(*n), "__wt": reduce(Column.__add__, w), "__wm": F.greatest(*w)}
    totals["__boost"] = F.when(F.col("__triples") >= 5, 0.99).when(F.col("__triples") >= 3, 0.9)
    rows = step(rows, totals)

    def share(score: Column, total: str) -> Column:
        return F.when((F.col(total) > 0) & (score > 0), F.bround(score / F.col(total), 4)).otherwise(0.0)

    def best(scores: list[Column], most: str) -> Column:
        return F.when(F.col(most) > 0, F.coalesce(*[F.when(s == F.col(most), F.lit(t)) for t, s in zip(kinds, scores)])).otherwise(UNKNOWN)

    # By type the largest weighted score of any source, as fuse_scores has it; a type of rules alone comes after all others.
    rules = {}
    for k, (kind, *_) in enumerate(packs.KEYWORD_RULES):
        rules.setdefault(kind, []).append(k)
    every = [*kinds, *(t for t in rules if t not in kinds)]
    scores = {}
    for k, kind in enumerate(every):
        sources = [F.col(f"__r{r}") * 1.0 for r in rules.get(kind, [])] + ([F.col("__boost") * 1.0] if kind == "班级成员表" else [])
        if kind in packs.TYPE_KEYWORDS:
            sources += [share(w[k], "__wt") * SOURCE_WEIGHTS["nlp"], share(n[k], "__nt") * SOURCE_WEIGHTS["analysis"]]
        scores[f"__s{k}"] = F.greatest(*sources) if len(sources) > 1 else sources[0]
    sure = F.when(F.col("__wm") > 0, F.bround(F.col("__wm") / F.greatest(F.col("__wt"), F.lit(1e-300)), 4)).otherwise(0.0)
    rows = step(rows, scores | {"free_type": best(n, "__nm"), "__nlp": best(w, "__wm"), "confidence": sure}, base)

    def candidate(k: int, kind: str) -> Column:
        s = F.col(f"__s{k}")
        priority = 3 if kind in packs.HIGH_PRIORITY else 2 if kind in packs.MID_PRIORITY else 1
        rank = 1000 * list(SOURCE_WEIGHTS).index("nlp")
        place = F.when(F.col("__nlp") == kind, rank - 1).otherwise(rank + k) if kind in packs.TYPE_KEYWORDS else F.lit(9200 + min(rules[kind]))
        return F.when(s > 0, F.struct((s * 10 + priority).alias("points"), (-place).alias("first"), F.lit(kind).alias("doc_type"), s.alias("score")))

    found = F.array_compact(F.array(*[candidate(k, kind) for k, kind in enumerate(every)]))
    # Shares of types that are no candidates are zero.
    shown = [F.when(F.col(f"__s{k}") > 0, F.col(f"__s{k}")).otherwise(0.0) for k in range(len(kinds))]
    rows = step(rows, {"__c": found, "__shares": F.array(*shown)}, [*base, "free_type", "confidence"])
    known = F.array(*map(F.lit, kinds))
    made = let(F.filter("__c", lambda c: ~c["doc_type"].isin(*kinds)), lambda more: F.map_from_arrays(F.concat(known, more["doc_type"]), F.concat(F.col("__shares"), more["score"])))
    chosen = F.coalesce(F.array_max("__c")["doc_type"], _by_keyword("__told"), F.lit("其他"))
    return step(rows, {"document_type": chosen, "probabilities": made}, [*same, "free_type", "confidence"])


def primary_type(df: DataFrame) -> DataFrame:
    """``df`` with ``primary_type`` of its ``doc_type``."""
    table = df.sparkSession.createDataFrame(list(packs.PRIMARY_CLASS.items()), "doc_type string, primary_type string")
    return df.join(F.broadcast(table), "doc_type", "left").withColumn("primary_type", F.coalesce("primary_type", F.lit("other")))


def select_template(docs: DataFrame, templates: list[dict] | DataFrame) -> DataFrame:
    """``(doc_id, template_id, score)``: five points for the type, one a keyword, of fifteen; the first best, none at zero.

    ``templates`` is a caller's pack of some dozens of dicts, compiled to one expression, or a table of a pack's rows in order
    of ``ord`` (else of id), sent along as one array. Either way each document is judged within its row.
    """
    if isinstance(templates, DataFrame):
        return _select_from_table(docs, templates)
    # Lower-cased once, behind a generator.
    docs = docs.select("doc_id", "document_type", kept(F.lower("text")).alias("__low"))
    scored = []
    for k, t in enumerate(templates):
        points = F.when(F.col("document_type") == t["document_type"], 5).otherwise(0) + _hits([w.lower() for w in t.get("match_keywords") or []], "__low")
        scored.append(F.struct(F.least(points, F.lit(15)).alias("points"), F.lit(-k).alias("o"), F.lit(t["template_id"]).alias("template_id")))
    best = docs.select("doc_id", F.array_max(F.array(*scored)).alias("b")).where("b.points > 0")
    return best.select("doc_id", F.col("b.template_id").alias("template_id"), F.least(F.col("b.points") / 15, F.lit(1.0)).alias("score"))


#: Templates that one array may hold.
MOST_TEMPLATES = 20_000


def _select_from_table(docs: DataFrame, templates: DataFrame) -> DataFrame:
    order = "ord" if "ord" in templates.columns else "template_id"
    words = F.transform(F.coalesce("match_keywords", F.array().cast("array<string>")), F.lower)
    pack = templates.select(F.struct(F.col(order).alias("at"), "template_id", "document_type", F.filter(words, lambda w: w != "").alias("words")).alias("t"))
    if pack.count() > MOST_TEMPLATES:
        raise ValueError(f"a pack holds {MOST_TEMPLATES} templates at most")
    packed = pack.agg(F.array_sort(F.collect_list("t")).alias("__pack"))
    rows = docs.select("doc_id", "document_type", F.lower("text").alias("__low")).join(F.broadcast(packed))

    def points(t: Column) -> Column:
        hits = F.size(F.filter(t["words"], lambda w: F.contains(F.col("__low"), w)))
        return F.when((F.col("document_type") != "") & (t["document_type"] == F.col("document_type")), 5).otherwise(0) + hits

    # All from fifteen points on count alike: the first of them is taken.
    capped = F.transform("__pack", lambda t, k: F.struct(F.least(points(t), F.lit(15)).alias("points"), (-k).alias("o"), t["template_id"].alias("template_id")))
    best = rows.select("doc_id", F.array_max(capped).alias("b")).where("b.points > 0")
    return best.select("doc_id", F.col("b.template_id").alias("template_id"), (F.col("b.points") / 15).alias("score"))


def _narrowed(nlp: DataFrame) -> DataFrame:
    """A classification whose shares are numbers alone where they are those of all types in order; any other map stays one."""
    same = F.map_keys("probabilities") == F.array(*map(F.lit, packs.TYPE_KEYWORDS))
    return nlp.select("doc_id", "document_type", "confidence", F.when(same, F.map_values("probabilities")).alias("__shares"), F.when(~same, F.col("probabilities")).alias("__map"))


def _widened() -> Column:
    return F.coalesce("__map", F.map_from_arrays(F.array(*map(F.lit, packs.TYPE_KEYWORDS)), F.col("__shares")))


def merge_classification(nlp: DataFrame, *models: DataFrame, picked: DataFrame | None = None) -> DataFrame:
    """``(doc_id, document_type, confidence, probabilities)``: the surest model's class where any gave one, however sure, else the keywords'.

    ``models`` come in order (image, then text); of equal confidence the first counts. ``picked(doc_id, doc_type, candidates)``, the
    outcome of the fused scores, then sets the type and overlays its candidates on the shares; documents without a class take both from it.
    """
    answers = None
    for k, m in enumerate(models):
        part = m.where("document_type IS NOT NULL").select("doc_id", F.struct(F.coalesce("confidence", F.lit(0.0)).alias("sure"), F.lit(-k).alias("first"), "document_type", "confidence", "probabilities").alias("m"))
        answers = part if answers is None else answers.unionByName(part)
    said = None if answers is None else answers.groupBy("doc_id").agg(F.max_by("m", F.struct("m.sure", "m.first")).alias("m"))
    if picked is not None:
        chosen = picked.select("doc_id", F.col("doc_type").alias("__t"), F.col("candidates").alias("__c"))
        said = chosen if said is None else said.join(chosen, "doc_id", "full_outer")
    # The widest side comes last, and goes over the wire once and without the names of its types.
    joined = _narrowed(nlp) if said is None else _narrowed(nlp).join(said, "doc_id", "full_outer")
    joined = joined.withColumn("probabilities", _widened())
    if answers is not None:
        own = [F.when(F.col("m").isNotNull(), F.col(f"m.{c}")).otherwise(F.col(c)).alias(c) for c in ("document_type", "confidence", "probabilities")]
        joined = joined.select("doc_id", *own, *([] if picked is None else ["__t", "__c"]))
    if picked is None:
        return joined.select("doc_id", "document_type", "confidence", "probabilities")
    rows = joined
    over = F.coalesce("__c", F.create_map().cast("map<string,double>"))
    kept = F.map_filter(F.coalesce("probabilities", F.create_map().cast("map<string,double>")), lambda k, _: ~F.map_contains_key(over, k))
    return rows.select(
        "doc_id",
        F.coalesce("__t", "document_type").alias("document_type"),
        F.when(F.col("document_type").isNull(), F.coalesce(F.try_element_at("__c", F.col("__t")), F.lit(0.0))).otherwise(F.col("confidence")).alias("confidence"),
        F.map_concat(kept, over).alias("probabilities"),
    )
