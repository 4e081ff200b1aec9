"""Toxicity and quality on the given tables: held-out accuracy, and odd rows."""

import zlib

import numpy as np
import pytest

from docloom.llm import quality_model, toxicity

BIG = "/root/testdata/sf0.1"


def auc(pairs):
    good = [s for s, y in pairs if y]
    bad = [s for s, y in pairs if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


# Of the 120 toxic rows held out at this scale, 8 have no word that marks the ones to learn from.
@pytest.mark.parametrize("query,label,least", [(toxicity.op4_toxicity, "toxic", 0.93), (quality_model.op7_quality_classifier, "quality", 0.98)])
def test_held_out_accuracy(spark, query, label, least):
    rows = query(spark, BIG).collect()
    assert len(rows) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    for r in rows[:200]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert auc([(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]) > least


def test_odd_rows(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(1, None, 0.5), (1, None, 0.5), (2, "", 0.5), (3, " \n", 0.5), (None, "word " * 100_000, 0.5), (4, "x" * 300_000, 0.5)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score double")
    tox = toxicity.score(odd, toxicity.fit(docs, labels)).collect()
    good = quality_model.score(odd, quality_model.fit(docs, labels)).collect()
    assert len(tox) == len(good) == len(rows)
    for found in (tox, good):
        blank = {r["score"] for r in found if r["doc_id"] in (1, 2, 3)}
        assert len(blank) == 1 and 0 <= min(r["score"] for r in found) and max(r["score"] for r in found) <= 1


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, none)).count() == 2
    assert quality_model.score(docs, quality_model.fit(docs, none)).count() == 2
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(nothing, toxicity.fit(nothing, none)).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "good words here") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 1) for i in held], "doc_id long, quality int, toxic int")
    assert "base" in toxicity.fit(docs, labels) and "base" in quality_model.fit(docs, labels)


def test_floods_of_null_ids_copies_and_repeats_stay_bounded(spark, sf, monkeypatch):
    """Rows without id, copies of one text and repeats of one labelled id: the sample keeps one row of each."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    some = labels.where("quality = 1").head()["doc_id"]
    flood = spark.range(100_000).selectExpr(f"IF(id % 2 = 0, NULL, {some}) AS doc_id", "'the same words again' AS text")
    taken = []
    fitted = quality_model.non_negative_fit
    monkeypatch.setattr(quality_model, "non_negative_fit", lambda good, mixed, prior: taken.append((len(good), len(mixed))) or fitted(good, mixed, prior))
    model = quality_model.fit(docs.unionAll(flood), labels)
    assert "w" in model and all(g <= quality_model.MOST_GOOD and m <= docs.count() + 1 for g, m in taken)


def test_labels_do_not_turn_the_scorer_round(spark):
    """Positives that look alike, and zeros spread beyond them on the scorer's good side: its slope stays positive."""
    docs = [(i, "fine words in a line " * (2 + i % 3)) for i in range(120)] + [(1000 + i, "#### $$$ " * 30) for i in range(120)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(table, labels)
    got = {r["doc_id"]: r["score"] for r in quality_model.score(table, model).collect()}
    assert min(got[i] for i in range(120)) > max(got[i] for i in range(1000, 1120))


def test_non_negative_risk_separates():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (800, 2)), rng.normal(-1.5, 1, (400, 2))
    add = lambda x: np.hstack([np.ones((len(x), 1)), x])
    mixed = add(np.vstack([good[400:], bad]))
    first = quality_model.non_negative_fit(add(good[:400]), mixed, 0.5)
    prior = quality_model.estimate_prior(add(good[:400]) @ first, mixed @ first)
    assert 0.4 < prior < 0.65
    w = quality_model.non_negative_fit(add(good[:400]), mixed, prior)
    assert (add(good[400:]) @ w > 0).mean() > 0.95 and (add(bad) @ w < 0).mean() > 0.95
