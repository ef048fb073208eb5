import base64
import hashlib
import io
import re

import pytest
from pyspark.sql import functions as F

from panelweave.llm import warc

from .conftest import SF


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def brute(rows):
    groups = {}
    for i, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for i, html in rows:
        data = (html or "").encode()
        top = max((x for x in groups[data] if x is not None), default=None)
        twin = len(groups[data]) > 1 and i != top and top is not None
        out.append((i, len(data), digest(data), "revisit" if twin else "response", top if twin else None))
    return sorted(out, key=str)


def run(df, **kw):
    rows = warc.read_archives(warc.write_archives(df, **kw)).collect()
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


def test_pages(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    assert run(df) == brute([(r.page_id, r.html) for r in df.collect()])


@pytest.mark.parametrize("bits", [4, 24])
def test_edge(spark, bits):
    rows = [
        (1, "http://a b/ü?x", "<p>same</p>"),
        (2, None, "<p>same</p>"),
        (9, "http://c", "<p>same</p>"),
        (3, "", None),
        (4, "u", ""),
        (5, "u", "HTTP/1.0 200\r\n\r\n\r\nWARC/1.1\r\n"),
        (6, "u", "é" * 300000),
        (None, "u", "no id"),
        (7, "u", "no id"),
        (7, "u", "no id"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, record_type string").repartition(3)
    assert run(df, filter_bits=bits, file_bytes=2000) == brute([(r[0], r[2]) for r in rows])


def test_ids_dates_and_urls(spark):
    rows = [(1, "http://a/a b", "x", "19990102030405"), (2, "http://a/a%20b", "x", None), (3, "u", "y", "2001"), (3, "u", "y", "2001"), (4, None, "z", "20020304050607")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, at string").repartition(2)
    got = warc.read_archives(warc.write_archives(df, date=F.col("at"))).collect()
    assert len({r.record_id for r in got}) == len(rows)
    assert sorted((r.page_id, warc.url_of(r.target_uri) or "") for r in got) == sorted((r[0], r[1] or "") for r in rows)
    assert {r.page_id: r.warc_date for r in got} == {1: "1999-01-02T03:04:05Z", 2: "1970-01-01T00:00:00Z", 3: "2001-01-01T00:00:00Z", 4: "2002-03-04T05:06:07Z"}


def test_both_versions_and_a_cut_file(spark):
    df = spark.createDataFrame([(i, "u", f"text {i}") for i in range(6)], "page_id bigint, url string, html string").coalesce(1)
    manifest = warc.write_archives(df)
    path = manifest.first().path.removeprefix("file://")
    with open(path, "rb") as f:
        data = f.read()
    records = list(warc.read_warc(io.BytesIO(data)))
    assert {re.search(rb"from ARC (.)", r.block)[1] for r in records if r.headers["WARC-Type"] == "warcinfo"} == {b"1", b"2"}
    last = len(warc.gzip_member(warc.warc_bytes(records[-1])))
    with open(path, "wb") as f:
        f.write(data[:-last])  # a whole record less: every remaining member is sound
    with pytest.raises(Exception, match="5 records, not 6"):
        warc.read_archives(manifest).collect()


def test_empty(spark):
    assert run(spark.createDataFrame([], "page_id bigint, url string, html string")) == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_by_declared_length(version):
    bodies = [b"HTTP/1.0 200 OK\r\nX: 1\r\n\r\nURL IP-address\n\nhttp://x 1.2.3.4 2000 t 5\n", b"plain\n\n", b""]
    recs = [{"url": f"http://h/{i} with space", "ip": "1.2.3.4", "date": "19990203040506", "type": "text/html", "body": b} for i, b in enumerate(bodies)]
    data = warc.write_arc(recs, version, "f.arc", "19990203040506")
    got = list(warc.read_arc(io.BytesIO(data)))
    assert got[0].fields["URL"] == "filedesc://f.arc" and got[0].version == version
    assert [g.body for g in got[1:]] == bodies
    assert [g.fields["URL"] for g in got[1:]] == [r["url"] for r in recs]
    made = [warc.arc_to_warc(g) for g in got]
    assert [m.headers["WARC-Type"] for m in made] == ["warcinfo", "response", "resource", "resource"]
    assert made[1].headers["WARC-Payload-Digest"] == "sha1:" + digest(bodies[0].partition(b"\r\n\r\n")[2])
    assert made[1].headers["WARC-Date"] == "1999-02-03T04:05:06Z"
    assert len({m.headers["WARC-Record-ID"] for m in made}) == 4
    stream = b"".join(warc.gzip_member(warc.warc_bytes(m)) for m in made)
    back = list(warc.read_warc(io.BytesIO(stream)))
    assert [(b.headers, b.block) for b in back] == [(m.headers, m.block) for m in made]


def test_truncated_records_are_errors():
    data = warc.write_arc([{"url": "u", "date": "2000", "type": "t", "body": b"12345"}], 1, "f", "2000")
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(data[:-4])))
