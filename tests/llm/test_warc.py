import hashlib

from docloom.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def check(spark, tmp_path, rows, part_bytes):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", part_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        records = warc.read_warc(spark, path)
        got = [tuple(r) for r in warc.page_records(records).collect()]
        payloads = [bytes(r["payload"]).decode() for r in records.select("payload").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    whole = [(i, u, (h or "").encode()) for i, u, h in rows]
    want, bodies = [], []
    for i, u, b in whole:
        ids = [j for j, _, c in whole if c == b and j is not None]
        again = len(b) >= 100 and ids and i != min(ids)
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", min(ids) if again else None, None if u is None else u.replace("\r", "%0D").replace("\n", "%0A")))
        bodies.append("" if again else b.decode())
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(payloads) == sorted(bodies)


def test_round_trip_with_magic_in_payloads(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>" + "é" * (k % 70)) for k in range(120)]
    rows += [(500, "http://a\r\nX: y", FAKE * 3), (501, None, "x" * 300 + FAKE), (502, "u", None), (503, "u", ""), (504, "u", "WARC/1.1\r\n"), (505, "u", "\r\n\r\nWARC/1.1\r\n\r\n")]
    rows += [(600 + k, "copy", "same " * 40) for k in range(5)] + [(601, "copy", "same " * 40), (None, "n", "same " * 40), (None, None, "short")]
    check(spark, tmp_path, rows, "134217728")


def test_records_over_many_byte_ranges(spark, tmp_path):
    rows = [(k, "u", ("<b>" + "y" * 900 + FAKE) * (1 + k % 4)) for k in range(40)] + [(99, "u", "z" * 20_000 + FAKE * 9 + "é" * 9000)]
    check(spark, tmp_path, rows, "700")


def test_torn_file_ends_at_the_tear(spark, tmp_path):
    folder = tmp_path / "torn"
    folder.mkdir()
    one = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (folder / "a.warc").write_bytes((one + "garbage" + one).encode())
    got = warc.read_warc(spark, str(folder)).collect()
    assert [(r["start"], bytes(r["payload"]) if not isinstance(r["payload"], str) else r["payload"].encode()) for r in got] == [(0, b"abc")]


def test_empty_file_and_clashing_columns(spark, tmp_path):
    """An empty file adds nothing; columns named like the operator's own do not reach the records."""
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "x", 7, "y")], "page_id long, url string, html string, payload string, payload_bytes long, first string")
    warc.write_warc(pages, str(tmp_path / "c"))
    (tmp_path / "c" / "b.warc").write_bytes(b"")
    (row,) = warc.page_records(warc.read_warc(spark, str(tmp_path / "c"))).collect()
    assert (row["page_id"], row["payload_bytes"], row["record_type"], row["refers_to"]) == (1, 8, "response", None)


def test_no_pages(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0
