import base64
import gzip
import hashlib
import os

from pyspark.sql import functions as F

from ridgeline.llm.common import scratch_path
from ridgeline.llm.warc import coalesce_ranges, decode_record, encode_record, read_archive, write_archive

SCHEMA = "page_id long, url string, html string, sha string, first long, offset long"


def rows():
    out = [(5, "http://a/5", "same"), (3, "http://a/3", "same"), (9, None, "same"), (1, "http://a/ x\r\ny", None), (2, "u", ""), (4, "é", "é" * 10)]
    out += [(6, "u6", "x" * 400_000), (7, "u7", "line\r\n\r\nWARC/1.1\r\n"), (8, "u8", "once"), (8, "u8", "once"), (None, "n", "same"), (None, "n", "alone")]
    return out + [(100 + i, f"http://h/{i}", f"page {i % 40}") for i in range(300)]


def want(data, least=0):
    first = {}
    for p, _, h in data:
        h = (h or "").encode()
        if p is not None:
            first[h] = min(p, first.get(h, p))
    out = []
    for p, _, h in data:
        h = (h or "").encode()
        f = first.get(h)
        revisit = len(h) >= least and f is not None and f != p
        digest = base64.b32encode(hashlib.sha1(h).digest()).decode()
        out.append((p, len(h), digest, "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in data], SCHEMA).repartition(4)
    for least in (0, 5):
        folder = scratch_path(spark, "warc")
        index = write_archive(df, folder, min_bytes=least, file_bytes=20_000)
        got = read_archive(index, folder)
        assert result(got) == want(data, least)
        texts = {r.page_id: r.payload for r in got.collect() if r.record_type == "response" and r.page_id}
        assert all(bytes(texts[p]) == (h or "").encode() for p, _, h in data if p in texts)
        # Every file is a plain sequence of gzip members, and the index tiles it.
        path = folder.removeprefix("file://")
        for f in os.listdir(path):
            parts = index.where(index.file == f).orderBy("offset").collect()
            raw = open(f"{path}/{f}", "rb").read()
            assert [p.offset for p in parts] == [0, *[p.offset + p.length for p in parts[:-1]]]
            assert parts[-1].offset + parts[-1].length == len(raw)
            assert gzip.decompress(raw).count(b"WARC-Record-ID: ") == len(parts)


def test_selected_records(spark):
    folder = scratch_path(spark, "warc")
    index = write_archive(spark.createDataFrame(rows(), "page_id long, url string, html string"), folder)
    some = read_archive(index.where("url LIKE 'http://h/1%'"), folder)
    assert some.count() == 111 and {r.url[:10] for r in some.collect()} == {"http://h/1"}
    assert read_archive(index.limit(0), folder).count() == 0


def test_empty(spark):
    folder = scratch_path(spark, "warc")
    index = write_archive(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert read_archive(index, folder).count() == 0


def test_ranges_and_records():
    assert coalesce_ranges([(0, 10), (10, 5), (40, 5), (1000, 1)], gap=30, most=100) == [(0, 45, 0, 3), (1000, 1, 3, 4)]
    assert coalesce_ranges([(70, 10), (80, 5)]) == [(70, 15, 0, 2)]
    assert coalesce_ranges([(0, 60), (60, 60)], gap=0, most=100) == [(0, 60, 0, 1), (60, 60, 1, 2)]
    fields, payload = decode_record(encode_record(1, "u", b"a\r\n\r\nb", "D", None, False))
    assert payload == b"a\r\n\r\nb" and fields["X-Page-Id"] == "1"


def test_one_payload_in_half_of_the_pages(spark):
    data = [(i, f"http://h/{i}", None if i % 2 else f"page {i}") for i in range(2000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(6)
    folder = scratch_path(spark, "warc")
    got = read_archive(write_archive(df, folder), folder, with_payload=False)
    assert result(got) == want(data)
    # The join with the stored first pages is one that Spark splits at a hot key:
    # both its sides come straight from a shuffle, without an aggregate between.
    first = df.select(F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("sha"))
    assert first.groupBy("sha").count().agg(F.max("count")).first()[0] == 1000
