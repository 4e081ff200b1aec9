import random
import re

import xxhash

from docloom.llm import simhash


def brute_fingerprint(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits=4):
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    values = sorted(set(fps))
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= bits:
                up[root(a)] = root(b)
    return {f: root(f) for f in values}


def test_fingerprints():
    rng = random.Random(1)
    words = ["Alpha", "beta", "Élan", "γ", "x\x1cy", "a b"]
    texts = [None, "", " \t\n", "One", "a b c", "a b c d", "A\x0bB\x0cc  D"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_masks_cover_all_near_pairs():
    rng = random.Random(2)
    for blocks in (6, 7, 8):
        masks = simhash.block_masks(blocks)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not diff & m for m in masks)


def test_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 8)
    monkeypatch.setattr(simhash, "LAYOUT_SAMPLE", 1)
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(120)) for _ in range(20)]
    rows = []
    for i in range(240):
        words = rng.choice(base[:12] if i % 3 else base[:1]).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 9)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(5000, None), (5001, ""), (5002, " "), rows[3], (None, rows[4][1]), (None, "alone here now ok")]
    # An id with two texts, and a text without id that lies between two that are too far apart.
    rows += [(1000, base[15]), (1000, base[16])]
    chain = base[17].split()
    for i in (6000, None, 6001, None, 6002):
        rows.append((i, " ".join(chain)))
        while (brute_fingerprint(rows[-1][1]) ^ brute_fingerprint(" ".join(chain))).bit_count() < 3:
            chain[rng.randrange(len(chain))] = f"c{rng.randint(0, 99)}"
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = sorted([(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect()], key=str)
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps)
    least = {}
    for f, (i, _) in zip(fps, rows):
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    want = sorted([(i, f, least.get(roots.get(f))) for f, (i, _) in zip(fps, rows)], key=str)
    assert got == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    roots = brute_components(fps.values())
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(least.get(roots[f], i), i)
    want = sorted((i, f"{f:016x}", least[roots[f]]) for i, f in fps.items())
    assert sorted(tuple(r) for r in simhash.op5_simhash(spark, sf).collect()) == want
