import re

import pytest

from docloom.llm import mixing


def targets(sizes):
    """Water filling by rounds: the rest is shared by weight until no source is above its cap."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    open_, out, rest = set(names), {}, float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > 3 * sizes[s]]
        if not over:
            out |= {s: rest * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            open_.remove(s)
        rest -= sum(out[s] for s in over)
    return out


def check(rows, got):
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = targets(sizes), {}
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 2 * mixing.BLOCK + 1e-6, (s, t, want[s])


def rows_of(n):
    rows = [(i, " ".join(["w"] * (i * 37 % 400)), ["a", "b", "c", "d", "é", None, "hot", "hot", "hot"][i % 9]) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", "empty"), (None, "x y z", "a"), (None, "x y z", "a"), rows[7], rows[7], (n + 2, "w " * 9000, "b")]


def test_targets_and_quotas(spark, monkeypatch):
    rows = rows_of(300)
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, size int")
    check(rows, mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "SHARD_WORDS", 2000)
    once = mixing.mix(docs).collect()
    check(rows, once)
    assert sorted(map(str, once)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_applied_mix_has_the_words_taken(spark):
    rows = rows_of(90)
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    words: dict = {}
    for r in out.collect():
        assert r["n_chars"] == len(r["text"] or "")
        words[r["source"]] = words.get(r["source"], 0) + len((r["text"] or "").split())
    taken: dict = {}
    for r in mixing.mix(docs).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert words == {s: n for s, n in taken.items() if n}


def test_nothing_to_mix(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], kind)).count() == 0
    row = mixing.mix(spark.createDataFrame([(1, None, None)], kind)).head()
    assert (row["size"], row["target"], row["taken"]) == (0, 0.0, 0)


def test_seats_are_sainte_lague(spark):
    want = [5.2, 3.1, 0.0, 11.7, 2.49, 2.51]
    frame = spark.createDataFrame([(0, k, w, 25) for k, w in enumerate(want)], "g int, __tie int, w double, n long")
    got = {r["__tie"]: r["quota"] for r in mixing._seats(frame, ["g"], "w", "n").collect()}
    seats = [0] * len(want)
    for _ in range(25):
        best = max(range(len(want)), key=lambda k: (want[k] / (2 * seats[k] + 1), -k))
        seats[best] += 1
    assert got == dict(enumerate(seats))
