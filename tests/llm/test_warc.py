import base64
import gzip
import hashlib
import random
from collections import defaultdict

import pytest

from veritally.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string"


def check(pages, got, least=0):
    by = defaultdict(list)
    for p in pages:
        by[(p[2] or "").encode()].append(p[0])
    found = {r.page_id: r for r in got}
    assert len(got) == len(pages)
    for payload, ids in by.items():
        for i in ids:
            r = found[i]
            top = i if len(payload) < least else max(ids)
            assert r.payload_bytes == len(payload)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
            assert (r.record_type, r.refers_to) == (("response", None) if i == top else ("revisit", top))


PAGES = [
    (1, "http://a b/", "x\r\n\r\nWARC/1.1\r\n\n", "a"),
    (2, None, None, "a"),
    (3, "u", "", "a"),
    (4, "é", "x\r\n\r\nWARC/1.1\r\n\n", None),
    (5, "http://q", "\x00\xff\n" * 3, "a"),
    (6, "q", "HTTP/1.1 1\n\nz", "a"),
    (7, "q", "long " * 200_000, "a"),
]


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, version):
    pages = PAGES + [(100 + i, f"http://h/{i}", random.Random(i % 7).choice(["same", f"own {i}"]) * 5, "a") for i in range(60)]
    check(pages, warc.archive_pages(spark.createDataFrame(pages, SCHEMA).repartition(5), version=version).collect())


def test_small_payloads_may_be_kept(spark):
    check(PAGES, warc.archive_pages(spark.createDataFrame(PAGES, SCHEMA), least_bytes=10).collect(), 10)


def test_repeated_rows_and_an_empty_table(spark):
    rows = spark.createDataFrame([PAGES[0], PAGES[0], PAGES[3]], SCHEMA)
    assert sorted((r.page_id, r.record_type) for r in warc.archive_pages(rows).collect()) == [(1, "revisit"), (1, "revisit"), (4, "response")]
    # The row that holds the largest page twice: one response, the other revisits it.
    twice = warc.archive_pages(spark.createDataFrame([PAGES[0], PAGES[3], PAGES[3], PAGES[3]], SCHEMA).repartition(3)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in twice if r.record_type == "revisit") == [(1, "revisit", 4), (4, "revisit", 4), (4, "revisit", 4)]
    assert [(r.page_id, r.refers_to) for r in twice if r.record_type == "response"] == [(4, None)] and len({r.record_id for r in twice}) == 4
    assert warc.archive_pages(rows.limit(0)).count() == 0


V1 = b"filedesc://a.arc 0.0.0.0 19970101000000 text/plain 70\n1 0 someone\nURL IP-address Archive-date Content-type Archive-length\n"
V1 = V1.replace(b" 70\n", b" %d\n" % (len(V1) - V1.index(b"\n") - 1)) + b"\n"


def records(data, name="x"):
    return list(warc.parse_arc(warc.Bytes(data, name)))


def test_headers_of_both_versions():
    body = b"HTTP/1.0 200 OK\r\n\r\nhttp://not.a.header 1 2 3 4\n"
    one = V1 + b"http://a/with space 1.2.3.4 19970203 text/html %d\n" % len(body) + body + b"\n" + b"dns:a 1.2.3.4 1997 text/dns 2\nab\n"
    a, b = records(one)
    assert (a["url"], a["arc_date"], a["block"]) == ("http://a/with space", "19970203", body)
    assert (b["url"], b["block"], b["version"]) == ("dns:a", b"ab", 1)
    opening = b"2 0 someone\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    two = b"filedesc://b 0.0.0.0 1997 text/plain 200 - - 0 b %d\n" % len(opening) + opening + b"\nhttp://a 1.1.1.1 1998 text/html 404 - - 12 b 3\nxyz\n"
    assert records(two)[0]["result_code"] == "404"
    for packed in (gzip.compress(two), gzip.compress(two[:40]) + gzip.compress(two[40:])):
        assert records(packed) == records(two)


def test_what_cannot_be_read_is_named():
    with pytest.raises(ValueError, match="bad.arc.*9 bytes"):
        records(V1 + b"http://a 1.1.1.1 1998 text/html 9\nxyz", "bad.arc")
    with pytest.raises(ValueError, match="filedesc"):
        records(b"http://a 1.1.1.1 1998 text/html 3\nxyz\n")


def test_dates_and_types(spark):
    assert warc.iso_date("19970203") == "1997-02-03T00:00:00Z" and warc.iso_date(None) == "1996-01-01T00:00:00Z"
    path = warc.scratch_path(spark, "arc")
    rows = spark.createDataFrame([("dns:a", "1.1.1.1", "1997", "text/dns", bytearray(b"ab"))], "url string, ip string, arc_date string, content_type string, block binary")
    warc.write_arc(rows, path, 1)
    out = warc.scratch_path(spark, "warc")
    warc.convert_archives(spark, path, out)
    (row,) = warc.read_warc(spark, out).collect()
    assert (row.record_type, row.target_uri, bytes(row.block), row.headers["Content-Type"]) == ("resource", "dns:a", b"ab", "text/dns")
