import hashlib
import random
import re
import zlib

import pytest

from docloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, words int"


def brute(rows, rebuild=True):
    turns: dict = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    cut = lambda c: int(c - int(c / 20) * 20)
    h = lambda c: zlib.crc32(str(c).encode()) % 4
    whole = {c: turns.get(c - cut(c), [])[: h(c)] + v[h(c) :] for c, v in turns.items()} if rebuild else turns
    members: dict = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for path, convs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(path))))
        kids = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in under if p)
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), kids(path), sum(not kids(p) for p in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    got = prefix_trie.conversation_trie(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), **more)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted([tuple(r) for r in got.collect()], key=str)


def made(n, seed, words=("a", "b b", "c d e", ""), deep=6):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(words)) for c in range(n) for t in range(rng.choice([1, 2, 3, deep]))]


@pytest.mark.parametrize("sample", [1, 20])
def test_against_brute_force(spark, monkeypatch, sample):
    monkeypatch.setattr(prefix_trie, "SAMPLE_A_SHARD", sample)
    for seed in (1, 2):
        rows = made(90, seed)
        assert run(spark, rows) == brute(rows)
        assert run(spark, rows, rebuilt=None) == brute(rows, False)


def test_a_hot_conversation_and_short_splitters(spark, monkeypatch):
    """A third of all conversations are the same: splitters by id share them out; pieces of their ids stay in order."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = made(60, 3) + [(1000 + c, t, "user", f"turn {t}") for c in range(40) for t in range(5)]
    assert run(spark, rows, rebuilt=None) == brute(rows, False)
    monkeypatch.setattr(prefix_trie, "SPLITTER_TURNS", 2)
    assert run(spark, rows, rebuilt=None) == brute(rows, False)


def test_odd_rows(spark):
    """Null turns first, null and empty roles and texts alike, tied turns by role and text, repeated rows, no id, turnless, negative ids."""
    rows = [(20, None, None, "first"), (20, 1, "user", None), (20, 1, "user", ""), (20, 1, "bot", "b"), (20, 1, "bot", "a a"), (20, 2, "user", "x"), (20, 2, "user", "x")]
    rows += [(None, 1, "user", "nobody"), (21, 0, None, "first"), (22, 0, "user", "own"), (39, 5, "", "first"), (39, 6, "user", "")]
    rows += [(45, 0, "user", "gone"), (47, 0, "user", "gone"), (51, 0, "user", "gone"), (52, 0, "user", "gone"), (-5, 0, "user", "minus"), (-21, 0, "user", "minus")]
    rows += [(80 + k, None, None, None) for k in range(4)]
    assert run(spark, rows) == brute(rows)
    assert any(r[1] == 0 and r[3] == len({x[0] for x in rows} - {None}) for r in run(spark, rows))
    assert run(spark, []) == [] and run(spark, [(None, 1, "user", "x")]) == []


def test_long_conversation_and_one_turn_number_each(spark):
    rows = [(1, t, "user", "w " * (t % 3)) for t in range(400)] + [(2, t, "user", "w " * (t % 3)) for t in range(399, -1, -1)] + [(3, 0, "user", "x" * 200_000)]
    got = run(spark, rows, rebuilt=None)
    assert len(got) == 402 and max(r[1] for r in got) == 400 and [r for r in got if r[1] == 0][0][3:6] == (3, 2, 2)
    assert [r[7] for r in got if r[1] == 400] == [hashlib.sha256(b"1,2").hexdigest()]


def test_every_node_that_a_splitter_cuts_is_in_the_skeleton():
    rng = random.Random(4)
    key = lambda k: bytes([k]) * prefix_trie.KEY
    paths = sorted({(b"".join(key(rng.randrange(3)) for _ in range(rng.randrange(5))), c) for c in range(200)})
    splitters = prefix_trie.chosen_splitters([(p, c, len(p) // 16) for p, c in paths], 7)
    skeleton = prefix_trie.Skeleton(splitters)
    assert 3 <= len(splitters) <= 6 and splitters == sorted(splitters)
    shard = lambda x: sum(s <= x for s in splitters)
    for p, _ in paths:
        for k in range(0, len(p) + 1, 16):
            if len({shard(x) for x in paths if x[0][:k] == p[:k]}) > 1:
                at = 0
                for s in range(0, k, 16):
                    at = skeleton.child[at, p[s : s + 16]]
