import base64
import hashlib

from claimspark.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    first = {}
    for key, _, html in rows:
        payload = html or ""
        if key is not None and len(payload.encode()) >= least:
            first[payload] = min(first.get(payload, key), key)
    out = []
    for key, _, html in rows:
        payload = html or ""
        again = key is not None and payload in first and key > first[payload]
        out.append((key, len(payload.encode()), digest(html), "revisit" if again else "response", first[payload] if again else None))
    return sorted(out, key=str)


def read(spark, path):
    rows = warc.read_warc(spark, path).select(
        warc.page_id_of(warc.F.col("record_id")).alias("k"), "payload_bytes", "payload_digest", "warc_type", warc.page_id_of(warc.F.col("refers_to")).alias("r")
    )
    return sorted([tuple(r) for r in rows.collect()], key=str)


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: {}\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody"


def pages():
    rows = [(i, f"http://h/{i}", f"<p>page {i} äö</p>" * (i % 7)) for i in range(60)]
    rows += [(100, None, None), (101, "http://x/\r\nWARC/1.0\r\n", "WARC/1.0\r\n"), (None, "u", "<p>null id</p>")]
    rows += [(102, "u", "before " + FAKE.format(23) + "\r\n\r\n after"), (103, "u", FAKE.format(10**9)), (104, "u", FAKE.format(0) * 20)]
    rows += [(105, "u", "WARC/1.0\r\nContent-Length: x\r\n\r\n WARC/1.0\r\n\r\n"), (106, "u", "long " * 8_000 + "WARC/1.0\r\n" * 5), (107, "u", "WARC/1.0"), (108, "u", "\r\n\r\nWARC/1.0\r\n")]
    rows += [(200 + i, "copy", "<p>page 3 äö</p>" * 3) for i in range(40)] + [(3, "copy", "<p>page 3 äö</p>" * 3)]
    return rows


def test_round_trip(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, first int").repartition(3)
    warc.write_warc(df, f"{tmp_path}/a")
    assert read(spark, f"{tmp_path}/a") == expected(rows)
    for size in ("997b", "20001b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert read(spark, f"{tmp_path}/a") == expected(rows), size
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_payloads_come_back_whole(spark, tmp_path):
    rows = pages()
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), f"{tmp_path}/b", least_bytes=10**9)
    records = warc.read_warc(spark, f"{tmp_path}/b")
    assert records.filter("warc_type = 'revisit'").count() == 0
    whole = warc.read_bytes(spark, f"{tmp_path}/b", warc.scan_segments(spark, f"{tmp_path}/b"), records.select("file", "offset", "next_offset"))
    assert sorted(bytes(r.payload).decode() for r in whole.collect()) == sorted(h or "" for _, _, h in rows)


def test_a_cut_record_ends_the_chain(spark, tmp_path):
    good = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    (tmp_path / "c.warc").write_bytes(good + good + good[:-6])
    (tmp_path / "d.warc").write_bytes(b"no record" + good)
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r.offset for r in rows) == [0, len(good)] and all(r.file.endswith("c.warc") and r.payload_bytes == 2 for r in rows)


def test_empty_table(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/e")
    assert read(spark, f"{tmp_path}/e") == []
