import re

from pyspark.sql import functions as F

from docloom.llm import quality_rules


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams: dict = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


TEXTS = [None, "", " \n ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "x x\tx x\x0bx y", "é # b\né # b\n\né # b ", "one two three " * 40, " ".join(f"w{k}" for k in range(60)), "|<>&$% *#" * 10, "long " + "y" * 100_000 + " tail " * 60]


def test_statistics(spark):
    rows = [(i, t, "h", 1) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "h", 1), (None, "a b c", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = sorted([tuple(r) for r in quality_rules.apply_quality_rules(docs).select("doc_id", *names).collect()], key=str)
    assert got == sorted([(i, *brute(t)) for i, t, _, _ in rows], key=str)


def test_bad_hosts_are_rejected(spark):
    good = " ".join(f"w{k}" for k in range(80))
    rows = [(i, good, f"host{i % 20}") for i in range(400)]
    rows += [(1000 + i, "short" if i % 10 else good, "bad") for i in range(200)] + [(2000, good, None)]
    got = quality_rules.apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    kept = {r["doc_id"] for r in got.collect() if r["kept"]}
    assert kept == {i for i, t, s in rows if s != "bad"}


def test_each_rule_alone_rejects_a_host(spark):
    """Hosts whose documents pass the base rules and fail one host rule each."""
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    again = "the same three words over again "
    kinds = {
        "good": lambda i: own(i, 80),
        "symbols": lambda i: own(i, 80).replace("w", "#$"),
        # Half of its lines repeat, one word each, so that no window of three words is found often.
        "lines": lambda i: own(i, 300) + "\n" + "\n".join(f"{a}\n{own(i * 100 + k, 4)}" for k, a in enumerate(["x", "y", "z", "v"] * 4)),
        "repeats": lambda i: own(i, 60) + " " + again * 4 + own(i + 1000, 10),
    }
    rows = [(n * 100 + i, make(i), name) for n, (name, make) in enumerate(kinds.items()) for i in range(60)]
    rows += [(5000 + i, kinds["good"](i), f"h{i % 9}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    stats = quality_rules.text_statistics(docs).where("NOT base_failed")
    fails = {r["source"]: [bool(r[n]) for n in quality_rules.RULES] for r in stats.groupBy("source").agg(*[F.expr(f"avg(int({rule})) > 0.5").alias(n) for n, rule in quality_rules.RULES.items()]).collect()}
    for name in kinds:
        assert fails[name] == [rule == name for rule in quality_rules.RULES]
    kept = {r["source"] for r in quality_rules.apply_quality_rules(docs).where("kept").collect()}
    assert kept == {"good"} | {f"h{i}" for i in range(9)}


def test_empty(spark):
    assert quality_rules.apply_quality_rules(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
