import random
import re

import corpus_pipeline
from docloom.llm import near_text


def brute_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_groups(texts):
    sets, up = [brute_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def test_stage_links_at_similarity_four_fifths(spark, sf, monkeypatch):
    monkeypatch.setattr(near_text, "SLICE", 8)
    monkeypatch.setattr(near_text, "SAMPLE", 1)
    rng = random.Random(4)
    texts = []
    for family in range(30):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([6, 9, 40, 300]))]
        for _ in range(8 if family else 60):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 99)}"
            texts.append(" ".join(words))
    passage = " ".join(f"common{k}" for k in range(20))
    texts += [passage + " " + " ".join(f"v{rng.randint(0, 5000)}" for _ in range(30)) for _ in range(40)]
    texts += [None, "", " \n", "One  two", "one TWO", "x x x x x x x x"]
    rng.shuffle(texts)
    rows = [(None if k % 5 == 0 else k, t, "s") for k, t in enumerate(texts)]
    roots, least = brute_groups(texts), {}
    for (i, _, _), r in zip(rows, roots):
        least[r] = min(least.get(r, 10**9), 10**9 if i is None else i)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted([r["doc_id"] for r in got.collect()], key=str) == sorted([None if i == 10**9 else i for i in least.values()], key=str)


def test_repeated_and_empty(spark, sf):
    schema = "doc_id long, text string"
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e f"), (None, "g h"), (None, "g h")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), sf)
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a b c"), (1, "d e f"), (None, "g h")]
    assert corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([], schema), sf).count() == 0
