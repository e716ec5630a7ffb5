"""PDF files built here: reading, hostile files, and updates read back."""

import random
import zlib

import pytest

from quireline.sources.formats import Item
from quireline.sources.pdf import filters
from quireline.sources.pdf.document import Document, PdfError
from quireline.sources.pdf.objects import Name, Parser, Real, Ref, text_bytes, text_of, written
from quireline.sources.pdf.update import tree_links, with_outline, write_file


def build(pages=4, *, stream=False, front=b"", outline=True, count=None, extra=b""):
    """A small PDF: classic table, or object stream and cross-reference stream."""
    kids = [Ref(10 + i) for i in range(pages)]
    objects = {1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 2: {"Type": Name("Pages"), "Kids": kids, "Count": pages if count is None else count}}
    for i in range(pages):
        objects[10 + i] = {"Type": Name("Page"), "Parent": Ref(2), "MediaBox": [0, 0, 100, Real("141.50")]}
    if outline:
        objects[1]["Outlines"] = Ref(3)
        objects[3] = {"First": Ref(4), "Last": Ref(5), "Count": 2}
        objects[4] = {"Title": b"Caf\xe9 (one)", "Parent": Ref(3), "Next": Ref(5), "Dest": [Ref(10), Name("Fit")]}
        objects[5] = {"Title": text_bytes("二"), "Parent": Ref(3), "Prev": Ref(4), "A": {"S": Name("GoTo"), "D": b"there"}}
        objects[1]["Dests"] = {"there": [Ref(11), Name("Fit")]}
    out, offsets = bytearray(front + b"%PDF-1.5\n%\xe2\xe3\n" + extra), {}
    shift = len(front)
    if not stream:
        for num, value in objects.items():
            offsets[num] = len(out) - shift
            out += b"%d 0 obj\n" % num + written(value) + b"\nendobj\n"
        start = len(out) - shift
        out += b"xref\n0 1\n0000000000 65535 f \n"
        for num in offsets:
            out += b"%d 1\n%010d 00000 n \n" % (num, offsets[num])
        out += b"trailer\n" + written({"Size": 100, "Root": Ref(1)}) + b"\n"
    else:
        heads, body = b"", b""
        for num, value in objects.items():
            heads += b"%d %d " % (num, len(body))
            body += written(value) + b" "
        packed = zlib.compress(heads + body)
        offsets[50] = len(out) - shift
        out += b"50 0 obj\n" + written({"Type": Name("ObjStm"), "N": len(objects), "First": len(heads), "Filter": Name("FlateDecode"), "Length": len(packed)}) + b"\nstream\n" + packed + b"\nendstream\nendobj\n"
        start = len(out) - shift
        rows = b"".join(bytes([2]) + (50).to_bytes(4, "big") + bytes([i]) for i in range(len(objects))) + bytes([1]) + offsets[50].to_bytes(4, "big") + b"\0"
        index = [x for num in objects for x in (num, 1)] + [50, 1]
        packed = zlib.compress(rows)
        out += b"51 0 obj\n" + written({"Type": Name("XRef"), "Size": 100, "Root": Ref(1), "W": [1, 4, 1], "Index": index, "Filter": Name("FlateDecode"), "Length": len(packed)}) + b"\nstream\n" + packed + b"\nendstream\nendobj\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


ITEMS = [Item("A & (b)", 0, 1), Item("第二节", 1, 2), Item("\U0001f600 deep", 2, 2), Item("Z", 0, 4)]


@pytest.mark.parametrize("options", [{}, {"stream": True}, {"front": b"junk\n"}, {"front": b"junk\n", "stream": True}])
def test_read_and_update(options):
    data = build(**options)
    doc = Document(data)
    assert (len(doc.pages), doc.rebuilt, doc.xref_kind) == (4, False, "stream" if options.get("stream") else "table")
    assert [(r.title, r.level, r.page_index) for r in doc.outline()] == [("Café (one)", 0, 0), ("二", 0, 1)]
    once = with_outline(data, ITEMS)
    assert once.startswith(data)
    assert [(r.title, r.level, r.page_index) for r in Document(once).outline()] == [(r.title, r.level, r.page - 1) for r in ITEMS]
    twice = with_outline(once, ITEMS[:2], offset=1)
    assert [(r.title, r.page_index) for r in Document(twice).outline()] == [("A & (b)", 1), ("第二节", 2)]
    assert Document(twice).revisions == 3
    assert Document(with_outline(twice, [])).outline() == []


def test_rebuilt_files():
    data = build()
    broken = data[: data.rindex(b"xref\n0")] + b"startxref\n999999\n%%EOF\n"
    doc = Document(broken)
    assert doc.rebuilt and len(doc.pages) == 4
    assert len(Document(with_outline(broken, ITEMS)).outline()) == 4
    with pytest.raises(PdfError, match="twice"):
        Document(broken.replace(b"%%EOF", b"10 0 obj\nnull\nendobj\n%%EOF"))


def test_updates_keep_trailer_keys_and_set_the_page_mode():
    base = build(outline=False)
    data = base.replace(b"/Root 1 0 R", b"/Root 1 0 R /Info 10 0 R /Own (kept)", 1)
    made = with_outline(data, [Item("One", 0, 1)])
    doc = Document(made)
    assert doc.trailer["Own"] == b"kept" and doc.trailer["Info"] == Ref(10) and doc.catalog["PageMode"] == "UseOutlines"
    without = Document(with_outline(made, []))
    assert "PageMode" not in without.catalog and "Outlines" not in without.catalog and without.trailer["Own"] == b"kept"


def test_updates_list_moved_objects_where_they_are():
    base = build(outline=False)
    at = base.index(b"12 0 obj")
    wrong = base.replace(b"%010d 00000 n" % at, b"%010d 00000 n" % (at + 3), 1)
    assert wrong != base and Document(wrong).pages and Document(wrong).repairs
    again = Document(with_outline(wrong, [Item("Third", 0, 3)]))
    assert len(again.pages) == 4 and not again.repairs and [r.page_index for r in again.outline()] == [2]


def test_refusals():
    for bad in (b"", b"%PDF-1.4", build(count=9), build().replace(b"11 0 R 12 0 R", b"10 0 R 12 0 R"), build().replace(b"11 0 R 12 0 R", b"99 0 R 12 0 R")):
        with pytest.raises(PdfError):
            Document(bad)
    with pytest.raises(PdfError):
        with_outline(build(), [Item("x", 0, 5)])
    with pytest.raises(PdfError):
        with_outline(build(), [Item("x", 1, 1)])
    encrypted = build().replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 1 0 R")
    with pytest.raises(PdfError, match="encrypted"):
        with_outline(encrypted, ITEMS)


def test_values_round_trip():
    for value in (None, True, -3, Real("1.500"), Name("a b#"), b"\x00(x)", Ref(3, 1), [1, [Name("x")], {"k": b"v"}], {"a": {"b": []}}):
        assert Parser(written(value) + b" ").value() == value
    assert Parser(b"(a\\(b\\051\\n\\\r\nc(d))").value() == b"a(b)\nc(d)"
    assert Parser(b"<</A 1/A 2>>").value() == {"A": 2}
    deep = Parser(b"[" * 5000 + b"]" * 5000)
    deep.value()
    assert deep.truncated
    assert text_of(text_bytes("é\U0001f600")) == "é\U0001f600" and text_of(b"\x80") == "•" and text_of(b"\xef\xbb\xbf\xc3\xa9") == "é"


def test_filters():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(999)) + b"a" * 500
    assert filters.flate(zlib.compress(data)) == filters.flate(zlib.compress(data)[2:-4]) == data
    assert filters.ascii_hex(data.hex().encode() + b">") == data
    import base64

    assert filters.ascii_85(base64.a85encode(data) + b"~>") == data
    assert filters.run_length(b"\x02abc\xfdx\x80") == b"abcxxxx"
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"
    with pytest.raises(filters.FilterError):
        filters.flate(zlib.compress(bytes(filters.STREAM_LIMIT + 9)))
    assert filters.unpredicted(b"\x02\x01\x02\x02\x01\x01", 12, 2) == b"\x01\x02\x02\x03"
    assert filters.unpredicted(b"\x01\x01\x01\x01\x04\x01\x01\x01", 15, 3) == b"\x01\x02\x03\x02\x03\x04"


def test_links():
    links = tree_links([0, 1, 2, 1, 0])
    assert [r["parent"] for r in links] == [None, 0, 1, 0, None]
    assert [r["count"] for r in links] == [3, 1, 0, 0, 0]
    assert [r["next"] for r in links] == [4, 3, None, None, None]
    assert (links[0]["first"], links[0]["last"]) == (1, 3)


def test_mutated_files_never_crash():
    rng, seeds = random.Random(7), [build(), build(stream=True), with_outline(build(), ITEMS)]
    for n in range(300):
        data = bytearray(seeds[n % 3])
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(data))
            data[at : at + rng.randrange(3)] = bytes(rng.randrange(256) for _ in range(rng.randrange(3)))
        try:
            out = with_outline(bytes(data), ITEMS)
        except ValueError:
            continue
        assert out.startswith(bytes(data))


def test_files_and_tables(spark, tmp_path):
    from quireline.sources.pdf import tables

    for i, data in enumerate([build(), build(stream=True), b"no pdf"]):
        (tmp_path / f"{i}.pdf").write_bytes(data)
    files = tables.read_files(spark, str(tmp_path))
    info = {r.path[-5]: r for r in tables.info(files).collect()}
    assert (info["0"].pages, info["1"].xref, info["2"].problem) == (4, "stream", "no PDF header")
    assert sorted((r.path[-5], r.pos, r.page_index) for r in tables.outlines(files).collect() if r.problem is None) == [(k, i, i) for k in "01" for i in (0, 1)]
    wanted = files.selectExpr("path", "content", "array(named_struct('title', 'T', 'level', 0, 'page', 2)) AS items", "1 AS offset")
    made = {r.path[-5]: r for r in tables.updated(wanted).collect()}
    assert Document(bytes(made["1"].content)).outline()[0].page_index == 2 and made["2"].problem
    write_file(str(tmp_path / "out.pdf"), bytes(made["0"].content), source=str(tmp_path / "0.pdf"))
    with pytest.raises(PdfError):
        write_file(str(tmp_path / "0.pdf"), b"x", source=str(tmp_path / "0.pdf"))


def test_five_hundred_pages_in_a_second():
    import time

    data, began = build(500), time.time()
    with_outline(data, [Item(f"Page {i}", 0, i) for i in range(1, 501)])
    assert time.time() - began < 1
