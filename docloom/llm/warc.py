r"""Operator 2: WARC archives, written by Spark and read back by boundary-chain verification.

Writing: a record is its header, a blank line and its block, and ends in two line ends; Spark's text sink
with that separator makes exactly such files on any file system it knows. Of equal payloads the
smallest page id is written in full, the others as ``revisit`` records.

Reading: the text source cut at the magic ``WARC/1.1\r\n`` deals byte ranges of the archives over tasks, so a record's
payload that holds the magic is cut too. Lengths summed over the ranges of a file give each cut its
offset. Each cut is a candidate record; its header names its successor's offset. Within a range the
candidates' chains are followed to where they leave it; between ranges, pointers are doubled from the start
of the file until no new range is reached. Only candidates on the chain are records. A record
of several cuts is put together again, by file and offset where it crosses ranges.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import bounded, checkpointed, is_small, read, shared_folder

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Payloads shorter than this are always written in full.
REVISIT_FROM = 100
#: Records in one archive file, at most.
FILE_RECORDS = 50_000
DATE = "1970-01-01T00:00:00Z"


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def assign_records(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, digest, payload_bytes, first)``: ``first`` is the page that a revisit refers to, else null."""
    whole = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", whole.alias("payload"))
    base = base.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    long_ones = base.where(F.col("payload_bytes") >= REVISIT_FROM)
    shared = checkpointed(long_ones.groupBy(F.col("digest").alias("__d")).agg(F.min("page_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1"))
    joined = base.join(bounded(shared), F.col("digest") == F.col("__d"), "left")
    again = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return joined.select("page_id", "url", "payload", "digest", "payload_bytes", F.when(again, F.col("__first")).alias("first"))


def write_warc(pages: DataFrame, path: str) -> None:
    """One record for each row of ``pages(page_id, url, html)`` into archive files below ``path``.

    Null html: an empty payload. Null url: no target header. Line ends in a url are percent-encoded.
    Repeated rows are repeated records; rows without an id have the record id ``null``. Other columns are left out,
    whatever their names; an empty table gives no records.
    """
    rows = assign_records(pages)
    again = F.col("first").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n")
    )
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = rows.withColumn("block", block)
    record = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))),
        _header("WARC-Date", F.lit(DATE)),
        F.coalesce(_header("WARC-Target-URI", url), F.lit("")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.coalesce(_header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))), F.lit("")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, part, ord, value, size)``: what lies between magics, in file order within a byte range."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("ord"),
        "value",
        F.octet_length("value").cast("long").alias("size"),
    )


def _with_ranges(cuts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cuts with what is known of their byte range, the cuts of a range still together and in order."""
    small = is_small(ranges)
    named = ranges.withColumnsRenamed({"file": "__f", "part": "__p"})
    named = F.broadcast(named) if small else named.hint("merge")
    joined = cuts.join(named, (F.col("file") == F.col("__f")) & (F.col("part") == F.col("__p"))).drop("__f", "__p")
    # A broadcast keeps the order; beyond its bound the ranges are shuffled and sorted back.
    return joined if small else joined.sortWithinPartitions("file", "part", "ord")


def _candidates(batches):
    """Per candidate: (file, part, start, leaves): where the chain from it leaves its byte range, and its last record there."""
    rows: list[tuple] = []
    where = None

    def flush():
        leaves: dict[int, tuple[int, int]] = {}
        for start, after in reversed(rows):
            leaves[start] = leaves.get(after, (after, start))
        if leaves:
            starts = list(leaves)
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([where[0]] * n), pa.array([where[1]] * n, pa.int64()), pa.array(starts, pa.int64()), pa.array([leaves[s][0] for s in starts], pa.int64()), pa.array([leaves[s][1] for s in starts], pa.int64())],
                names=["file", "part", "start", "leaves", "last"],
            )

    at = 0
    for batch in batches:
        for file, part, base, size, head, length in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, part) != where:
                if where:
                    yield from flush()
                where, rows, at = (file, part), [], base
            start = at - len(MAGIC)
            if start >= 0 and length is not None:
                rows.append((start, at + head + len(END) + length + len(END)))
            at += size + len(MAGIC)
    if where:
        yield from flush()


def _reached(candidates: DataFrame) -> DataFrame:
    """``(file, part, start, last)``: where the chain from the start of each file enters its byte ranges."""
    jumps = candidates.select("file", "start", "leaves")
    reached = checkpointed(candidates.where("start = 0").select("file", "start"))
    n = reached.count()
    while n:
        onward = reached.join(jumps, ["file", "start"]).select("file", F.col("leaves").alias("start"))
        onward = onward.join(jumps.select("file", "start"), ["file", "start"], "left_semi")
        grown = checkpointed(reached.unionAll(onward).distinct())
        now = grown.count()
        reached = grown
        if now == n:
            break
        n = now
        twice = jumps.select("file", "start", "leaves").join(
            jumps.select("file", F.col("start").alias("leaves"), F.col("leaves").alias("beyond")), ["file", "leaves"], "left"
        )
        jumps = checkpointed(twice.select("file", "start", F.coalesce("beyond", "leaves").alias("leaves")))
    return candidates.join(reached, ["file", "start"], "left_semi")


def _records(batches):
    """Whole records, and fragments of those that cross byte ranges: (file, start, ord, whole, data)."""
    magic = MAGIC.encode()
    where, at, due, open_at, held, held_from = None, 0, None, None, [], 0
    ready: list[tuple] = []

    def out():
        columns = list(zip(*ready))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        ready.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["file", "start", "ord", "whole", "data"])

    def leave():
        if held and open_at is not None:
            ready.append((where[0], open_at, held_from, False, b"".join(held)))

    for batch in batches:
        for file, part, base, entry, opened, value in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, part) != where:
                if where:
                    leave()
                where, at, due, open_at, held, held_from = (file, part), base, entry, opened, [], base - len(magic)
            start = at - len(magic)
            at += len(value) + len(magic)
            if start == due:
                leave()  # a record opened in an earlier range ends here
                open_at, held, held_from = start, [], start
                head = value.find(END.encode())
                length = _content_length(value[: max(head, 0)])
                due = start + len(magic) + head + len(END) + length + len(END) if head >= 0 and length is not None else None
            if open_at is None:
                continue
            held.append(magic + value if start >= 0 else value)
            if due is not None and at - len(magic) >= due and open_at == held_from:
                ready.append((file, open_at, 0, True, b"".join(held)[: due - open_at]))
                open_at, held = None, []
        if ready:
            yield out()
    if where:
        leave()
    if ready:
        yield out()


def _content_length(head: bytes) -> int | None:
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def _parsed(batches):
    """(file, start, headers, http_headers, payload) of whole records; torn ones are left out."""
    end = END.encode()
    for batch in batches:
        rows = []
        for file, start, data in zip(*(c.to_pylist() for c in batch.columns)):
            head, _, rest = data.partition(end)
            length = _content_length(head)
            if length is None or len(rest) < length:
                continue
            block = rest[:length]
            http, payload = b"", block
            if b"application/http" in head.lower():
                http, _, payload = block.partition(end)
            rows.append((file, start, head[len(MAGIC) :].decode("utf-8", "replace"), http.decode("utf-8", "replace"), payload))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["file", "start", "headers", "http_headers", "payload"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, headers, http_headers, payload)``: the records on the chain from each file's start.

    A chain that breaks (a torn or foreign stretch) ends its file's records there; what lies beyond is
    not trusted. No files or empty files: empty result.
    """
    cuts = _cuts(spark, path)
    ranges = cuts.groupBy("file", "part").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = checkpointed(ranges.select("file", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base")))
    head = F.substring_index("value", END, 1)
    length = F.expr(r"try_cast(nullif(regexp_extract(head, '(?im)^Content-Length:[ \t]*([0-9]{1,18})[ \t]*\r?$', 1), '') as bigint)")
    sizes = _with_ranges(cuts.withColumn("head", head), bases)
    sizes = sizes.select("file", "part", "base", "size", F.octet_length("head").cast("long").alias("head_bytes"), length.alias("length"))
    candidates = checkpointed(sizes.mapInArrow(_candidates, "file string, part long, start long, leaves long, last long"))
    entries = _reached(candidates).groupBy("file", "part").agg(F.min("start").alias("entry"), F.max("last").alias("last"))
    known = bases.join(entries, ["file", "part"], "left")
    opened = F.last("last", ignorenulls=True).over(before)
    order = Window.partitionBy("file").orderBy("part")
    entered = (F.col("base") > 0) & ~F.col("entry").eqNullSafe(F.col("base") - len(MAGIC))
    known = known.select("file", "part", "base", "entry", opened.alias("opened"), entered.alias("entered"))
    known = checkpointed(known.withColumn("torn", F.col("entered") | F.coalesce(F.lead("entered").over(order), F.lit(False))))

    def walked(ranges: DataFrame) -> DataFrame:
        pieces = _with_ranges(cuts, ranges).select("file", "part", "base", "entry", "opened", F.col("value").cast("binary").alias("value"))
        return pieces.mapInArrow(_records, "file string, start long, ord long, whole boolean, data binary")

    schema = "file string, start long, headers string, http_headers string, payload binary"
    whole = walked(known).where("whole").select("file", "start", "data").mapInArrow(_parsed, schema)
    # Only byte ranges that a record crosses into or out of are read for fragments.
    torn = walked(known.where("torn")).where("NOT whole").groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("ord", "data"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["data"]))
    return whole.unionAll(torn.select("file", "start", joined.alias("data")).mapInArrow(_parsed, schema))


def page_records(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, url)`` of archives written here."""

    def header(name: str, pattern: str = r"(.*?)", column: str = "headers") -> Column:
        return F.expr(f"nullif(regexp_extract({column}, '(?im)^{name}:[ \\\\t]*{pattern}\\\\r?$', 1), '')")

    kind = header("WARC-Type")
    again = kind == "revisit"
    return records.select(
        header("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        F.when(again, header("Content-Length", "([0-9]+)", "http_headers").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(again, header("WARC-Payload-Digest", "sha256:([0-9a-f]+)")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        kind.alias("record_type"),
        header("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        header("WARC-Target-URI").alias("url"),
    )


def op2_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), path)
    return page_records(read_warc(spark, path)).drop("url")


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
