import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from quillstone.llm import warc


def b32(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


PAGES = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b/\r\nq", "é\r\n\r\nWARC/1.1\r\n"), (4, "u", None), (5, "u", ""), (6, "u", "y" * 300_000), (None, "n", "alone"), (None, "n", "<p>x</p>"), (7, "u", "twin"), (7, "u", "twin")]


@pytest.mark.parametrize("compression,keep", [("gzip", "largest"), ("none", "smallest")])
def test_round_trip(spark, tmp_path, compression, keep):
    df = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_warc(df, path, keep=keep, compression=compression)
    got = warc.read_warc(spark, path).withColumn("page", warc.page_of_urn(F.col("record_id"))).withColumn("to", warc.page_of_urn(F.col("refers_to"))).collect()
    best = {"largest": max, "smallest": min}[keep]
    want = []
    for i, url, html in PAGES:
        html = html or ""
        ids = [p for p, _, h in PAGES if (h or "") == html and p is not None]
        first = best(ids) if ids else None
        to = first if first is not None and i != first and sum((h or "") == html for _, _, h in PAGES) > 1 else None
        want.append((i, len(html.encode()), b32(html), "revisit" if to is not None else "response", to, None if to is not None else html.encode(), url and url.replace("\r", "%0D").replace("\n", "%0A")))
    assert sorted(map(str, want)) == sorted(str((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.to, r.payload and bytes(r.payload) if r.payload is None else bytes(r.payload), r.target_uri)) for r in got)


def test_predicates_reach_the_reader_and_payloads_are_passed_over(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_warc(df, f"file://{tmp_path}/w", compression="none")
    records = warc.read_warc(spark, f"file://{tmp_path}/w", payload=False)
    assert records.where("record_type = 'revisit'").count() == 3
    assert records.where("payload is not null").count() == 0
    reader = warc.WarcReader({"path": str(tmp_path)}, records.schema)
    rest = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("offset",), 3)]))
    assert len(rest) == 1 and reader.wanted({"warc-type": "revisit"}) and not reader.wanted({"warc-type": "response"})


class Counting(io.BytesIO):
    got = 0

    def read(self, n=-1):
        out = super().read(n)
        self.got += len(out)
        return out


def record(kind, body, pad=""):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nX-Pad: {pad}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_members_are_seeked_over_unread():
    import random

    big = random.Random(1).randbytes(1 << 20)
    data = b"".join(warc.member(record(k, b)) for k, b in [("response", big), ("revisit", b""), ("response", b"small"), ("response", big)])
    assert gzip.decompress(data).count(b"WARC/1.1") == 4  # any other reader takes it too
    stream = Counting(data)
    got = list(warc.parse_members(stream, lambda h: h["warc-type"] == "revisit", True, "f"))
    assert len(got) == 1 and stream.got < 20_000
    whole = [p for _, _, p in warc.parse_members(io.BytesIO(data), lambda h: True, True, "f")]
    assert whole == [big, None, b"small", big]
    long = warc.member(record("response", b"x", pad=random.Random(2).randbytes(9000).hex()))  # headers beyond the first read
    foreign = gzip.compress(record("resource", b"abc"))
    mixed = [(h["warc-type"], p) for _, h, p in warc.parse_members(io.BytesIO(long + warc.member(record("a", b"1")) + foreign * 2), lambda h: True, True, "f")]
    assert mixed == [("response", b"x"), ("a", b"1"), ("resource", b"abc"), ("resource", b"abc")]
    for bad in (data[:5000], data[:3000] + b"\0" * 50 + data[3050:]):
        with pytest.raises(ValueError):
            list(warc.parse_members(io.BytesIO(bad), lambda h: True, True, "f"))


def test_files_partitions_columns_and_leftovers(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "z" * 50 + str(i)) for i in range(200)], "page_id long, url string, html string").repartition(2)
    path = tmp_path / "w"
    path.mkdir()
    (path / "part-of-a-lost-attempt.warc.gz").write_bytes(b"half a rec")
    warc.write_warc(df, f"file://{path}", max_file_bytes=4000)
    files = warc.list_files(str(path))
    assert len(files) > 4 and not (path / "part-of-a-lost-attempt.warc.gz").exists()
    got = warc.read_warc(spark, str(path), columns=["record_id", "payload_bytes"])
    assert got.columns == ["record_id", "payload_bytes"] and got.count() == 200
    reader = warc.WarcReader({"path": str(path), "partition_bytes": "9000"}, got.schema)
    assert 1 < len(reader.partitions()) < len(files) and sum(len(p.files) for p in reader.partitions()) == len(files)
    warc.write_warc(df.limit(3), f"file://{path}")  # appends
    assert warc.read_warc(spark, str(path)).where("record_type = 'response'").count() == 203
    one = warc.read_warc(spark, f"file://{files[0][0]}")
    assert 0 < one.count() < 200


def test_members_continuation_lines_and_damage():
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    stream = gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(record) + gzip.compress(record)))
    got = list(warc.parse_records(stream, lambda h: True, True, "f"))
    assert [(h["warc-target-uri"], p) for _, h, p in got] == [("a b", b"abc")] * 2
    for bad in (b"HELLO\r\n", record[:-6], record[:20]):
        with pytest.raises(ValueError):
            list(warc.parse_records(io.BytesIO(bad), lambda h: True, True, "f"))


def test_empty_table(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert warc.read_warc(spark, f"file://{tmp_path}/w").collect() == []
