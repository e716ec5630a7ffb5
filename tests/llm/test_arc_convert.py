import io

import pytest

from quireline.llm import arc_convert as A
from quireline.llm import queries


def archive(version, records, date="19990203040506"):
    out = A.arc_version_block("a.arc", version, date)
    for url, body in records:
        out += A.arc_record(url, date, "text/html", body, version=version)
    return out


HTTP = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n"


@pytest.mark.parametrize("version", [1, 2])
def test_both_versions(version):
    bodies = [HTTP + b"\n\nfiledesc://x 1 2 3 4\n", b"", HTTP, b"plain \xff\x00", HTTP + b"p" * 1_000_000]
    records = [(f"http://h/{i} with blank", b) for i, b in enumerate(bodies)]
    got = list(A.arc_records(io.BytesIO(archive(version, records))))
    assert [b for _, b, _ in got] == bodies
    assert [n for _, _, n in got] == list(range(5))
    assert got[0][0]["URL"] == "http://h/0%20with%20blank"
    assert [*got[0][0]] == A.FIELDS[version]


def test_damage():
    whole = archive(1, [("http://h/", HTTP + b"text")])
    with pytest.raises(ValueError, match="cut off"):
        list(A.arc_records(io.BytesIO(whole[:-1])))
    with pytest.raises(ValueError, match="version block"):
        list(A.arc_records(io.BytesIO(whole[5:])))
    with pytest.raises(ValueError, match="header line"):
        list(A.arc_records(io.BytesIO(whole + b"\nnot a header\n")))
    assert list(A.arc_records(io.BytesIO(archive(1, [])))) == []


def test_conversion():
    head, body, number = next(A.arc_records(io.BytesIO(archive(2, [("http://h/", HTTP + b"text")]))))
    record = A.convert(head, body, "a.arc", number)
    ((fields, block),) = A.warc_records(io.BytesIO(record))
    assert (fields["WARC-Type"], fields["WARC-Date"], fields["WARC-Target-URI"], block) == ("response", "1999-02-03T04:05:06Z", "http://h/", body)
    assert fields["WARC-Payload-Digest"] == "sha1:" + A.sha1_base32(b"text")
    assert record == A.convert(head, body, "a.arc", number)
    refers = {"id": "<urn:uuid:x>", "url": "http://o/", "date": "2000-01-01T00:00:00Z", "row": 4}
    ((fields, block),) = A.warc_records(io.BytesIO(A.convert(head, body, "a.arc", number, refers)))
    assert (fields["WARC-Type"], fields["WARC-Refers-To"], block) == ("revisit", "<urn:uuid:x>", HTTP)
    ((fields, block),) = A.warc_records(io.BytesIO(A.convert(head | {"URL": "dns:h"}, b"answer", "a.arc", 1)))
    assert (fields["WARC-Type"], block) == ("resource", b"answer")


@pytest.mark.parametrize(("date", "want"), [("20010203040506", "2001-02-03T04:05:06Z"), ("2001", "2001-01-01T00:00:00Z"), ("", "1970-01-01T00:00:00Z")])
def test_dates(date, want):
    assert A.warc_date(date) == want


def test_tables(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://d e/", ""), (5, "x", "lone \r\n\r\n é"), (None, "n", "same"), (6, "http://l/", "l" * 2_000_000), (7, "u", "six"), (8, "u", "six!!"), (9, "u", "six"), (9, "u", "six")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS path", "'y' AS number").repartition(3)
    records = A.scan_arcs(A.write_arcs(pages))

    def read(least):
        got = A.read_warcs(A.convert_arcs(A.choose(records, least_bytes=least))).collect()
        return sorted(((r.page_id if r.page_id is not None else 0, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str)

    everything = [(0, "revisit", 2, 4), (1, "revisit", 2, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 12), (6, "response", None, 2_000_000), (7, "revisit", 9, 3), (8, "response", None, 5), (9, "response", None, 3), (9, "revisit", 9, 3)]
    assert read(0) == sorted(everything, key=str)
    assert [r[1] for r in read(4) if r[0] in (3, 4, 7, 9)] == ["response"] * 5
    digests = {r.page_id: r.payload_digest for r in records.collect()}
    assert digests[1] == A.sha1_base32(b"same") and digests[3] == A.sha1_base32(b"")


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert A.read_warcs(A.convert_arcs(A.choose(A.scan_arcs(A.write_arcs(none))))).count() == 0


def test_query(spark, sf):
    pages = {r.page_id: (r.html or "").encode() for r in queries.table(spark, sf, "pages").collect()}
    last = {}
    for page, html in sorted(pages.items()):
        last[html] = page
    got = queries.op5_arc_convert(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        html = pages[r.page_id]
        keeper = last[html]
        assert (r.payload_bytes, r.payload_digest) == (len(html), A.sha1_base32(html))
        assert (r.record_type, r.refers_to) == (("response", None) if keeper == r.page_id else ("revisit", keeper))
