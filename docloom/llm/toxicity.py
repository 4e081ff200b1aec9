"""Operator 4: toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded sample of labelled documents. Both hold the sample's
commonest ordinary words; the toxic one also holds the words that mark toxic documents (they occur in
far more contexts there than in ordinary ones). A text is cut into windows of a few words; the
distance of a window is how many bytes shorter it gets with the toxic dictionary. Windows over a first threshold
are looked at again word by word, with and without the marks, to tell whole marks from chance fragments.
A logistic curve, calibrated on labelled documents that the dictionaries have not seen,
turns a document's largest distances into a score. Whole texts are scored, window after window.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import held_out, read
from docloom.llm.labelled import training_labels

#: Labelled documents that may be fitted on, by label, and the longest of them (characters).
MOST_TOXIC, MOST_ORDINARY, LONGEST = 2000, 4000, 100_000
WINDOW = 8
#: Bytes gained from which a window is looked at word by word.
SUSPECT = 2
#: Share of a word that marks must save for it to count as one.
FULL = 0.45
COMMON_WORDS = 15_000
THRESHOLD = 0.3
_EDGE = b".,;:!?%$#&*()\"'"
_LONG_WORD = 64
#: Bytes of the shortest and the longest stem.
_SHORTEST, _LONGEST_STEM = 4, 12


def _words(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words; very long ones are cut so that windows stay short."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if any(len(w) > _LONG_WORD for w in words):
        words = [w[k : k + _LONG_WORD] for w in words for k in range(0, len(w), _LONG_WORD)]
    return words


def _compressor(content: bytes, min_match: int, level: int = 1):
    parameters = zstandard.ZstdCompressionParameters.from_level(
        level, source_size=100, dict_size=len(content), min_match=min_match, window_log=18, hash_log=15,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress


class CompressionDistance:
    """Distances to a pair of dictionaries; made anew from their bytes in each task."""

    N_FEATURES = 6

    def __init__(self, common: bytes, marks: bytes):
        pad = b" " * 8
        self.toxic, self.ordinary = _compressor(common + b"  " + marks + b" ", 6), _compressor(common + pad, 6)
        # Marks stand doubled here, as words are compressed doubled: one alone is too short to gain by.
        doubled = b"".join(b" " + w + b"  " + w + b" " for w in marks.split())
        self.marked, self.blank = _compressor(pad + doubled + pad, 4, 13), _compressor(pad + pad, 4, 13)
        self.seen: dict[bytes, float] = {}

    def _word(self, word: bytes) -> float:
        """The share of a word that its marks save; about 1 for a mark, less for a fragment of one."""
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            twice = b" " + word + b"  " + word + b" "
            found = self.seen[word] = (len(self.blank(twice)) - len(self.marked(twice))) / (len(word) + 1)
        return found

    def features(self, text: str | None) -> list[float]:
        words, toxic, ordinary = _words(text), self.toxic, self.ordinary
        first = second = suspects = hits = 0
        best, n = 0.0, 0
        for at in range(0, len(words), WINDOW):
            window = b" " + b"  ".join(words[at : at + WINDOW]) + b" "
            gain = len(ordinary(window)) - len(toxic(window))
            n += 1
            if gain > first:
                first, second = gain, first
            elif gain > second:
                second = gain
            if gain >= SUSPECT:
                suspects += 1
                for word in words[at : at + WINDOW]:
                    share = self._word(word.strip(_EDGE) or word)
                    if share > best:
                        best = share
                    hits += share >= FULL
        return [first, second, best, min(hits, 5), math.log1p(suspects), math.log1p(n)]


def _counts(texts: list[str]) -> tuple[Counter, Counter]:
    """In how many contexts (pairs of neighbours) words, and their prefixes, occur: copies of a text count once."""
    contexts = set()
    for text in texts:
        words = [w.strip(_EDGE) or w for w in _words(text)]
        contexts.update(zip([b"", *words[:-1]], words, [*words[1:], b""]))
    words = Counter(w for _, w, _ in contexts)
    prefixes: Counter = Counter()
    for word, n in words.items():
        for size in range(_SHORTEST, min(len(word), _LONGEST_STEM) + 1):
            prefixes[word[:size]] += n
    return words, prefixes


def learn_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """``(common words, marks of toxic documents)``, rarer ones first, as dictionary contents.

    Marks are words, and stems of words, that occur in far more contexts in toxic documents than in ordinary ones. A
    stem is the longest that keeps most of the contexts of the shortest prefix that qualifies.
    """
    (in_toxic, toxic_stems), (in_ordinary, ordinary_stems) = _counts(toxic), _counts(ordinary)
    least = max(3, math.ceil(0.015 * len(toxic)))

    def lift(n: int, m: int) -> float:
        return math.log((n + 0.5) / (len(toxic) + 1)) - math.log((m + 0.5) / (len(ordinary) + 1))

    bar = min(4.5, math.log((least + 0.5) / (len(toxic) + 1) * (len(ordinary) + 1) / 0.5) - 0.1)
    marks = {w: n for w, n in in_toxic.items() if n >= least and len(w) > 2 and lift(n, in_ordinary[w]) > bar}
    by_size = sorted((p for p, n in toxic_stems.items() if n >= 2 * least and lift(n, ordinary_stems[p]) > bar), key=len)
    longer: dict[bytes, list] = {}
    for p in toxic_stems:
        longer.setdefault(p[:-1], []).append(p)
    taken: set[bytes] = set()
    for prefix in by_size:
        if any(prefix[:k] in taken for k in range(_SHORTEST, len(prefix) + 1)):
            continue
        taken.add(prefix)
        stem = prefix
        while best := max(longer.get(stem, []), key=lambda p: toxic_stems[p], default=None):
            if toxic_stems[best] < 0.7 * toxic_stems[prefix]:
                break
            stem = best
        marks[stem] = toxic_stems[stem]
    usual = [w for w, _ in in_ordinary.most_common(COMMON_WORDS)]
    return b" ".join(reversed(usual)), b"  ".join(sorted(marks, key=lambda w: (marks[w], w)))


def _design(features) -> np.ndarray:
    x = np.asarray(features, dtype=float).reshape(-1, CompressionDistance.N_FEATURES)
    first, best = x[:, :1], x[:, 2:3]
    return np.hstack([np.ones((len(x), 1)), x, best >= FULL, best >= 0.8, first * best / 10])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """A model (plain bytes and numbers) from the bounded labelled sample.

    Without labelled documents of both kinds the model is their smoothed share, a constant.
    """
    picked = training_labels(labels, label, {1: MOST_TOXIC, 0: MOST_ORDINARY})
    sample = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = sample.where(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST).dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: (r["doc_id"] * 2654435761) % 2**32)
    by = {v: [r["text"] or "" for r in rows if r["label"] == v] for v in (0, 1)}
    base = (len(by[1]) + 0.5) / (len(rows) + 1.0) if rows else 0.0
    if min(len(by[0]), len(by[1])) < 4:
        return {"base": min(base, 1.0)}
    cut = {v: max(2, len(t) * 7 // 10) for v, t in by.items()}
    common, marks = learn_dictionaries(by[1][: cut[1]], by[0][: cut[0]])
    distance = CompressionDistance(common, marks)
    kept = [(distance.features(t), v) for v in (0, 1) for t in by[v][cut[v] :]]
    x, y = _design([f for f, _ in kept]), np.array([v for _, v in kept], dtype=float)
    centre, scale = x.mean(0), x.std(0) + 1e-9
    centre[0], scale[0] = 0.0, 1.0
    weights = fit_logistic((x - centre) / scale, y)
    # The sample holds more toxic rows than the labels do; the intercept is moved back to their share.
    shares = labels.where(F.col(label).isNotNull() & ~held_out(doc_id)).agg(F.avg(F.col(label).cast("double")).alias("p")).head()["p"] or base
    now, then = y.mean(), min(max(shares, 1e-4), 1 - 1e-4)
    weights[0] += math.log(then / (1 - then)) - math.log(now / (1 - now)) if 0 < now < 1 else 0.0
    return {"common": common, "marks": marks, "centre": centre, "scale": scale, "weights": weights}


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)``, one row for each row of ``docs``; null and empty texts are scored as texts without windows.

    Equal texts score equally, whatever their rows; repeated rows each have a row. Empty table: empty result. Other
    columns are left out, whatever their names.
    """

    def run(batches):
        distance = CompressionDistance(model["common"], model["marks"]) if "weights" in model else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if distance is None:
                    scores = np.full(part.num_rows, float(model["base"]))
                else:
                    x = _design([distance.features(t) for t in part.column(1).to_pylist()])
                    # Summed row by row: equal texts score equally wherever they stand in a batch.
                    z = ((x - model["centre"]) / model["scale"] * model["weights"]).sum(1)
                    scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
