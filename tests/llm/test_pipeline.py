"""Each stage on its predecessor's rows, held against brute force; and the whole run."""

import re
from collections import Counter

import corpus_pipeline
from test_line_dedup import brute as brute_lines
from test_near_text import brute_groups

from docloom.llm import packing


def word_ids(text):
    from tokenizers import Tokenizer

    word_ids.tokenizer = getattr(word_ids, "tokenizer", None) or Tokenizer.from_file(packing.tokenizer_path())
    return [*word_ids.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def sum_lengths(rows):
    found = Counter()
    for r in rows:
        found[r["sequence_id"]] += r["length"]
    return found


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        after = docs.collect()
        if number < 4:
            assert docs.columns == columns
        if number == 0:
            kept = {r["doc_id"] for r in after}
            assert len(after) == len(kept) and {tuple(r) for r in after} <= {tuple(r) for r in before}
            good = [i for i, q in quality.items() if q == 1]
            assert sum(i in kept for i in good) > 0.85 * len(good)
        if number == 1:
            want = {i: t for i, _, _, t in brute_lines([(r["doc_id"], r["text"]) for r in before], 10)}
            assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after} == {i: (t, len(t)) for i, t in want.items()}
        if number == 2:
            # The stage's own contract: five words and a similarity of 0.8, one text of each group.
            least: dict = {}
            for r, group in zip(before, brute_groups([r["text"] for r in before])):
                least[group] = min(least.get(group, r["doc_id"]), r["doc_id"])
            assert sorted(r["doc_id"] for r in after) == sorted(least.values())
        if number == 3:
            sizes = {r["doc_id"]: len(re.findall(r"\S+", r["text"])) for r in before}
            taken: dict = {}
            for r in after:
                taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(r["text"].split())
            assert all(n <= 3 * sizes[i] for i, n in taken.items())
            assert abs(sum(taken.values()) - sum(sizes.values())) <= 16 * 25
        if number == 4:
            # Every text, as often as the mix has it, is there piece by piece, and no sequence is over its size.
            sizes = Counter((r["doc_id"], n) for r in before for n in [-(-len(word_ids(r["text"])) // 4096)])
            assert Counter(r["doc_id"] for r in after if r["piece"] == 0) == Counter(r["doc_id"] for r in before)
            assert len(after) == sum(n * times for (_, n), times in sizes.items())
            assert max(sum_lengths(after).values()) <= 4096
        before = after


def test_run_gives_the_last_stage(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0 and rows.count() > 0


def test_stages_on_odd_and_no_rows(spark, sf):
    """Nulls in every column, empty and repeated rows, and no rows at all, through each stage on its own."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b\nc", None, None, 5), (2, "other text", "en", "s", 10), (3, " \n ", "en", "s", 3)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            found = stage(spark, docs, sf)
            assert number == 4 or found.columns == docs.columns
            assert len(found.collect()) <= 3 * len(rows)
