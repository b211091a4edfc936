import base64
import hashlib
import random
from collections import Counter

from docloom.llm import warc

SCHEMA = "page_id long, url string, html string, type string, file int"


def brute(rows, least=0):
    out = []
    for page, url, html, *_ in rows:
        data = (html or "").encode()
        same = [(p is None, p or 0, u is None, u or "") for p, u, h, *_ in rows if (h or "") == (html or "")]
        first, own = min(same), (page is None, page or 0, url is None, url or "")
        again = own != first and len(data) >= least
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", (None if first[0] else first[1]) if again else None))
    return Counter(out)


def rows():
    rng = random.Random(2)
    nasty = f"{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bodies = ["", "<p>é漢</p>", nasty, "x" + nasty * 3 + "y", warc.MAGIC, warc.MAGIC * 4, "\r\n\r\n", "WARC/1.1\r", "a\r\n\r\nb", "q" * 300_000]
    out = [(i, f"http://h/{i}", rng.choice(bodies) if i % 3 else f"page {i}", "t", i) for i in range(400)]
    return out + [(400, None, None, None, None), (None, "u\r\nX: y", "", "t", 1), (401, "é", "only", "t", 1), (401, "é", "only", "t", 1)]


def test_round_trip(spark):
    for least in (0, 10):
        df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
        got = warc.round_trip(df, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert Counter(map(tuple, got)) == brute(rows(), least)


def test_many_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        data = [r for r in rows() if len(r[2] or "") < 1000] + [(1000 + i, "u", f"{warc.MAGIC}{i}" * 500, "t", 0) for i in range(5)]
        warc.archive(spark.createDataFrame(data, SCHEMA).coalesce(2), f"file://{tmp_path}/a")
        assert Counter(map(tuple, warc.digests(spark, f"file://{tmp_path}/a").collect())) == brute(data)
        r = warc.records(spark, f"file://{tmp_path}/a").where("uri = 'http://h/7'").first()
        assert r.record_id.startswith("<urn:page:7:") and bytes(r.payload).decode() == (data[7][2] if r.type == "response" else "")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_cut_off_archive_and_empty_table(spark, tmp_path):
    data = [(i, "u", f"p{i}", "t", 0) for i in range(20)]
    warc.archive(spark.createDataFrame(data, SCHEMA).coalesce(1), f"file://{tmp_path}/a")
    part = next((tmp_path / "a").glob("part-*"))
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.warc").write_bytes(part.read_bytes()[:-3])
    assert warc.digests(spark, f"file://{tmp_path}/b").count() == 19
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_headers_that_the_version_asks_for(spark, tmp_path):
    rows = [(1, "u", "same"), (2, "v", "same"), (1, "w", "other"), (1, "u", "third")]
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/a", date="2020-01-02T03:04:05Z")
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "a").glob("part-*")))
    records = [x for x in text.split(warc.MAGIC) if x]
    assert len(records) == 4 and all("\r\nWARC-Date: 2020-01-02T03:04:05Z\r\n" in x for x in records)
    ids = [x.split("WARC-Record-ID: ")[1].split("\r\n")[0] for x in records]
    assert len(set(ids)) == 4
    again = [x for x in records if x.startswith("WARC-Type: revisit")]
    assert len(again) == 1 and f"WARC-Profile: {warc.PROFILE}" in again[0] and again[0].split("WARC-Refers-To: ")[1].split("\r\n")[0] in ids
