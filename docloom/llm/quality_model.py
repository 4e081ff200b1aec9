"""Operator 7: quality classifier by positive-unlabelled learning.

A linear scorer over cheap whole-text features is fitted on trusted positives (label 1, a bounded sample)
and unlabelled text (a bounded sample of distinct texts). Features are centred and scaled by sums over all rows. The class
prior is the least ratio of upper tails, all rows over positives, of a first fit; the fit itself minimises
the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).

A rising logistic curve calibrated on the labelled sample turns scores into probabilities. Features are
counts of characters, word shapes and repeats; id, language, source and labels are none of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import checkpointed, held_out, read
from docloom.llm.labelled import training_labels
from docloom.llm.toxicity import fit_logistic

#: Bounds of the sample: labelled rows by label, unlabelled texts (about; never more than twice as many).
MOST_GOOD, MOST_BAD, UNLABELLED = 5000, 3000, 8000
THRESHOLD = 0.7
_PAIRS = 128

_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"!?", b"|", b"#*$%&<>", b"()[]{}\"'", b"@/:_-+=", b";")):
    _CLASS[list(_chars)] = _k + 1
_CLASS[128:] = 14
_N_CLASSES = 16
N_FEATURES = _N_CLASSES + 12 + _PAIRS


def features(text: str | None) -> np.ndarray:
    """Shares and rates of a whole text; all zeros but the first for a text without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    out = np.zeros(N_FEATURES, np.float32)
    if not words:
        out[0] = 1.0
        return out
    octets = np.frombuffer(data, np.uint8)
    kinds = _CLASS[octets]
    out[1:_N_CLASSES] = np.bincount(kinds, minlength=_N_CLASSES)[1:] / len(octets)
    n = len(words)
    blank = np.concatenate(([True], (kinds == 4) | (kinds == 5), [True]))
    starts, ends = np.nonzero(blank[:-1] & ~blank[1:])[0], np.nonzero(~blank[:-1] & blank[1:])[0]
    lengths = ends - starts
    # Hashes only tell a text's words apart; no value of theirs enters the result.
    keys = np.fromiter(map(hash, words), np.int64, n)
    triples = keys[:-2] * 3 + keys[1:-1] * 5 + keys[2:] * 7
    shout = (np.add.reduceat(kinds == 1, starts) == 0) & (np.add.reduceat(kinds == 2, starts) > 0)
    last = kinds[ends - 1]
    lines = [x for x in data.split(b"\n") if x.strip()]
    extra = out[_N_CLASSES : _N_CLASSES + 12]
    extra[0] = (keys[1:] == keys[:-1]).sum() / n
    extra[1] = len(np.unique(keys)) / n
    extra[2] = lengths.mean() / 10
    extra[3] = min(lengths.std() / 10, 3)
    extra[4] = np.log1p(n) / 10
    extra[5] = shout.mean()
    extra[6] = len(set(lines)) / max(1, len(lines))
    extra[7] = min(n / max(1, len(lines)) / 100, 3)
    extra[8] = (lengths > 25).mean()
    extra[9] = (last == 10).mean()
    extra[10] = ((last == 6) | (last == 8)).mean()
    extra[11] = len(np.unique(triples)) / max(1, n - 2)
    if len(kinds) > 1:
        pairs = np.bincount(kinds[:-1].astype(np.int64) * 8 % _PAIRS + kinds[1:] % 8, minlength=_PAIRS)[:_PAIRS]
        out[_N_CLASSES + 12 :] = np.sqrt(pairs / len(kinds))
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def non_negative_fit(good: np.ndarray, mixed: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights minimising the non-negative unbiased risk with sigmoid loss, by Adam."""
    w = np.zeros(good.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p, u = _sigmoid(good @ w), _sigmoid(mixed @ w)
        dp, du = p * (1 - p), u * (1 - u)  # slope of the sigmoid loss
        negative = u.mean() - prior * p.mean()
        toward = -prior * (good * dp[:, None]).mean(0)
        away = (mixed * du[:, None]).mean(0) - prior * (good * dp[:, None]).mean(0)
        # Below zero the negative part overfits: only it is stepped back, as the estimator asks.
        grad = toward + away if negative >= 0 else -away
        grad = grad + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


_TAILS = np.linspace(0.05, 0.95, 19)


def least_ratio(good: np.ndarray, mixed: np.ndarray) -> float:
    """The class prior from the shares of positives and of all rows in the same upper tails."""
    return float(min(max(((mixed + 1e-3) / (good + 1e-3)).min(), 0.02), 0.98))


def estimate_prior(good: np.ndarray, mixed: np.ndarray) -> float:
    """Least ratio of upper tails, unlabelled over positive, over the thresholds that 5-95 % of positives pass."""
    cuts = np.quantile(good, _TAILS)
    return least_ratio(*((x[:, None] >= cuts).mean(0) for x in (good, mixed)))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(float)


def featured(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``__t`` (a hash of the text) and ``__x`` (its features): computed once, kept by a checkpoint."""
    base = docs.drop("__t", "__x").withColumn("__t", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn("__of", F.col(text))
    if not keep_text:
        base = base.drop(text)
    names, at = [c for c in base.columns if c != "__of"], base.columns.index("__of")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [features(t.as_py()).tobytes() for t in part.column(at)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(found, pa.binary())], names=[*names, "__x"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "__of")
    return checkpointed(base.mapInArrow(run, f"{fields}, __x binary"))


def _sums(rows: DataFrame, of, width: int) -> np.ndarray:
    """Column sums over all rows of what ``of`` makes of a feature matrix; a task hands on one row a column."""

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch.column(0))).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], names=["k", "v"])

    found = {r["k"]: r["s"] for r in rows.select("__x").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("s")).collect()}
    return np.array([found.get(k, 0.0) for k in range(width)])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> dict:
    """A model (plain numbers); without positives or unlabelled rows, a constant.

    ``docs`` may be :func:`featured` already. Of rows that share a labelled id one is learnt from, and of equal
    unlabelled texts one; a null id has no label.
    """
    rows = docs if "__x" in docs.columns else featured(docs.select(doc_id, text), text, keep_text=False)
    n = rows.count()
    own = F.col(doc_id).cast("long").alias("__id")
    picked = training_labels(labels, label, {1: MOST_GOOD, 0: MOST_BAD}, doc_id).withColumnRenamed("doc_id", "__id")
    known = rows.select(own, "__t", "__x").join(F.broadcast(picked), "__id").groupBy("__id", "label").agg(F.min_by("__x", "__t").alias("x"))
    known = sorted((r["__id"], r["label"], bytes(r["x"])) for r in known.collect())
    loose = rows.where(F.pmod(F.xxhash64(F.lit(1), "__t"), F.lit(max(1, n // UNLABELLED))) == 0)
    loose = loose.groupBy("__t").agg(F.first("__x").alias("x")).orderBy("__t").limit(2 * UNLABELLED).collect()
    if not loose or not any(v == 1 for _, v, _ in known):
        return {"base": 0.5}
    sums = _sums(rows, lambda x: np.hstack([x, x * x]), 2 * N_FEATURES) / n
    centre = sums[:N_FEATURES]
    scale = np.maximum(np.sqrt(np.maximum(sums[N_FEATURES:] - centre * centre, 0)), 1e-3)

    def design(x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), np.clip((x - centre) / scale, -5, 5)])

    def matrix(found) -> np.ndarray:
        return np.frombuffer(b"".join(found), np.float32).reshape(-1, N_FEATURES).astype(float)

    good, mixed = design(matrix(x for _, v, x in known if v == 1)), design(matrix(bytes(r["x"]) for r in loose))
    first = non_negative_fit(good, mixed, 0.5)
    cuts = np.quantile(good @ first, _TAILS)
    passed = _sums(rows, lambda x: (design(x) @ first)[:, None] >= cuts, len(cuts)) / n
    prior = least_ratio(((good @ first)[:, None] >= cuts).mean(0), passed)
    w = non_negative_fit(good, mixed, prior)
    marks = np.array([v for _, v, _ in known], dtype=float)
    if not marks.all():
        raw = design(matrix(x for _, _, x in known)) @ w
        unit = max(raw.std(), 1e-6)
        now = marks.mean()
        a = fit_logistic(np.column_stack([np.ones(len(raw)), raw / unit]), marks)
        if a[1] < 0.01:
            # The labels may not turn the scorer round: its order stays, flattened.
            a = np.array([np.log(now / (1 - now)) - 0.01 * raw.mean() / unit, 0.01])
        w = w * (a[1] / unit)
        share = labels.where(F.col(label).isNotNull() & ~held_out(doc_id)).agg(F.avg(F.col(label).cast("double")).alias("p")).head()["p"]
        w[0] += a[0] + np.log(max(share, 1e-4) / max(1 - share, 1e-4)) - np.log(now / (1 - now))
    return {"centre": centre, "scale": scale, "w": w, "prior": prior}


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` added: the probability that the whole text is good.

    Null, empty and blank texts share one score (that of a text without words). Repeated rows get equal scores. A column
    ``score`` is replaced. ``docs`` may be :func:`featured` already. Empty table: empty result.
    """
    base = docs.drop("score")
    base = base if "__x" in base.columns else featured(base, text)
    names = [c for c in base.columns if c not in ("__t", "__x")]
    at = base.columns.index("__x")

    def run(batches):
        for batch in batches:
            if "w" in model:
                z = np.clip((_matrix(batch.column(at)) - model["centre"]) / model["scale"], -5, 5)
                # Summed row by row: equal texts score equally wherever they stand in a batch.
                scores = _sigmoid((z * model["w"][1:]).sum(1) + model["w"][0])
            else:
                scores = np.full(batch.num_rows, model["base"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores, pa.float64())], names=[*names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name in names)
    return base.mapInArrow(run, f"{fields}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    rows = featured(docs)
    return score(rows, fit(rows, labels)).where(F.col("score") >= threshold).select(*docs.columns)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    rows = featured(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    model = fit(rows, read(spark, sf_dir, "labels"))
    return score(rows, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
