import random
import zlib

import numpy as np
import pytest

from docloom.llm import packing

TEXTS = [None, "", " ", "Hello, World! don't", "été ÉTÉ x́ İstanbul ΣΑΣ", "a<|endoftext|>b", "\x1cq w", "１２３ 45", "tail\xa0nbsp　ideo", "snake_case __ !?'s", "'re 'RE it's", "<| odd"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    return lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]


def test_words_encode_as_whole_texts(plain, monkeypatch):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "Béta,", "x1y2", "%%%", "thtion", "ungß."]) + str(rng.randint(0, 50)) for _ in range(50)) for _ in range(30)]
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    tokenizer = packing.WordTokenizer(packing.tokenizer_path())
    # Every Latin letter alone, in a word and with marks around it, and every ASCII character.
    letters = [chr(c) for c in [*range(0x20, 0x7F), *range(0xA0, 0x250)]]
    texts += [" ".join(letters), " ".join(f"a{x}b" for x in letters), " ".join(f"({x}x{x}.)" for x in letters), "".join(map(chr, range(128)))]
    texts += [f"\x00a\x01b {x}\x7f\x85c" for x in letters[::40]]
    for text in texts:
        assert [*np.frombuffer(tokenizer.encode(text or ""), "<u4").tolist(), 1] == plain(text)


def test_fullest_combination_is_best():
    rng = random.Random(6)
    for _ in range(60):
        lengths = [rng.randint(1, 30) for _ in range(8)]
        room = rng.randint(5, 70)
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums if s + x <= room}
        found = packing.fullest_combination([(x, lengths.count(x)) for x in sorted(set(lengths), reverse=True)], room)
        assert sum(found) == max(sums)
        assert all(found.count(x) <= lengths.count(x) for x in found)


def test_packed_sequences(spark, plain, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 7)
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([1, 5, 20, 60, 300])))) for i in range(120)]
    rows += [(200 + k, t) for k, t in enumerate(TEXTS)] + [(None, "x y"), rows[3], rows[3]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").repartition(5)
    got = packing.pack(docs, capacity=64).collect()
    want = []
    for i, t in rows:
        ids = np.array(plain(t), dtype="<u4")
        want += [(i, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    bins: dict = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r["length"] for r in got) // 64) + 2


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
