"""Incremental update: the original bytes, then an outline, a new catalog and cross references, checked before it is handed out."""

from __future__ import annotations

import os
import tempfile

from quireline.sources.formats import Item
from quireline.sources.pdf.document import OBJECTS, Document, PdfError
from quireline.sources.pdf.objects import Name, Ref, text_bytes, written


def tree_links(levels: list[int]) -> list[dict[str, int | None]]:
    """parent, first, last, previous, next and number of descendants of preorder rows."""
    rows = [dict.fromkeys(("parent", "first", "last", "previous", "next"), None) | {"count": 0} for _ in levels]
    path: list[int] = []
    last_at: dict[int | None, int] = {}
    for i, level in enumerate(levels):
        del path[level:]
        parent = path[-1] if path else None
        before = last_at.get(parent)
        if before is not None:
            rows[before]["next"], rows[i]["previous"] = i, before
        elif parent is not None:
            rows[parent]["first"] = i
        if parent is not None:
            rows[parent]["last"] = i
            for p in path:
                rows[p]["count"] += 1
        rows[i]["parent"], last_at[parent] = parent, i
        path.append(i)
    return rows


#: Trailer keys that are about one cross-reference section and its stream; all others are of the file.
OF_SECTION = {"Size", "Prev", "XRefStm", "Type", "W", "Index", "Length", "Filter", "DecodeParms", "DP", "F", "FFilter", "FDecodeParms", "DL"}


def with_outline(data: bytes, items: list[Item], *, offset: int = 0) -> bytes:
    """``data`` with these entries (pages from 1) as its outline; none removes it. What cannot be done without loss is refused."""
    doc = Document(data)
    if doc.encrypted:
        raise PdfError("encrypted")
    if not doc.pages:
        raise PdfError("no pages")
    last = -1
    for r in items:
        if not 1 <= r.page + offset <= len(doc.pages):
            raise PdfError(f"page {r.page + offset} of '{r.title}' is not one of {len(doc.pages)}")
        if not 0 <= r.level <= last + 1:
            raise PdfError(f"level {r.level} behind level {last}")
        last = r.level
    root, first = doc.trailer["Root"], doc.next_number()
    if first + len(items) + 2 > OBJECTS:
        raise PdfError("object numbers too large")
    links, objects = tree_links([r.level for r in items]), {}
    at = lambda i: Ref(first + 1 + i)
    catalog = dict(doc.catalog)
    if items:
        tops = [i for i, link in enumerate(links) if link["parent"] is None]
        objects[Ref(first)] = {"Type": Name("Outlines"), "First": at(tops[0]), "Last": at(tops[-1]), "Count": len(items)}
        for i, (r, link) in enumerate(zip(items, links, strict=True)):
            row = {"Title": text_bytes(r.title), "Parent": Ref(first) if link["parent"] is None else at(link["parent"])}
            row |= {key: at(link[name]) for key, name in (("Prev", "previous"), ("Next", "next"), ("First", "first"), ("Last", "last")) if link[name] is not None}
            if link["count"]:
                row["Count"] = link["count"]
            objects[at(i)] = row | {"Dest": [doc.pages[r.page + offset - 1], Name("Fit")]}
        catalog |= {"Outlines": Ref(first), "PageMode": Name("UseOutlines")}
    else:
        catalog.pop("Outlines", None)
        if catalog.get("PageMode") == Name("UseOutlines"):
            del catalog["PageMode"]
    objects[root] = catalog
    out = bytearray(b"" if data[-1:] in (b"\n", b"\r") else b"\n")
    base, offsets = len(data) - doc.base, {}
    for ref, value in objects.items():
        offsets[ref] = base + len(out)
        out += b"%d %d obj\n" % (ref.num, ref.gen) + written(value) + b"\nendobj\n"
    size = max(first + len(items) + 1 if items else first, doc.trailer.get("Size") if isinstance(doc.trailer.get("Size"), int) else 0)
    carried = {k: v for k, v in doc.trailer.items() if k not in OF_SECTION and v is not None}
    for ref, place in doc.moved.items():  # what stands elsewhere than the table says is listed where it stands
        offsets.setdefault(ref, place)
    previous = {} if doc.rebuilt else {"Prev": doc.startxref}
    start = base + len(out)
    if doc.rebuilt:
        # nothing to link back to: all objects are listed again
        for num, e in doc.entries.items():
            if e.kind == 1:
                offsets.setdefault(Ref(num, e.b), e.a)
    packed = [(num, e) for num, e in doc.entries.items() if e.kind == 2] if doc.rebuilt else []
    if doc.xref_kind == "stream" or packed:
        own = Ref(size)
        rows = {r.num: (1, offsets[r], r.gen) for r in offsets} | {own.num: (1, start, 0)}
        for num, e in packed:
            rows.setdefault(num, (2, e.a, e.b))
        index, body = [], b""
        for num in sorted(rows):
            if index and index[-1][0] + index[-1][1] == num:
                index[-1][1] += 1
            else:
                index.append([num, 1])
            body += b"".join(v.to_bytes(w, "big") for v, w in zip(rows[num], (1, 8, 2), strict=True))
        head = {"Type": Name("XRef"), "Size": size + 1, "W": [1, 8, 2], "Index": [x for pair in index for x in pair], "Length": len(body)} | carried | previous
        out += b"%d 0 obj\n" % own.num + written(head) + b"\nstream\n" + body + b"\nendstream\nendobj\n"
    else:
        out += b"xref\n"
        for ref in sorted(offsets):
            out += b"%d 1\n%010d %05d n \n" % (ref.num, offsets[ref], ref.gen)
        out += b"trailer\n" + written({"Size": size} | carried | previous) + b"\n"
    out += b"startxref\n%d\n%%%%EOF\n" % start
    result = data + bytes(out)
    checked(data, result, [(r.title, r.level, r.page + offset - 1) for r in items])
    return result


def checked(before: bytes, after: bytes, wanted: list[tuple[str, int, int]]) -> None:
    """Raises unless the update keeps the original's bytes and pages and reads back as it was meant."""
    doc = Document(after)
    if not after.startswith(before):
        raise PdfError("the original bytes changed")
    if doc.rebuilt or doc.repairs and not Document(before).repairs:
        raise PdfError("the update's cross references do not hold")
    if len(doc.pages) != len(Document(before).pages):
        raise PdfError("the number of pages changed")
    if [(r.title, r.level, r.page_index) for r in doc.outline()] != wanted:
        raise PdfError("the outline reads back differently")


def write_file(path: str, data: bytes, *, source: str | None = None) -> None:
    """Through a temporary file beside the target, which is never the source, and a rename."""
    if source and os.path.exists(path) and os.path.samefile(path, source):
        raise PdfError("the output is the input")
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".pdf-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise


def blank_document(pages: int) -> bytes:
    """A PDF of empty pages, with a classic cross-reference table."""
    objects = {1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3 + i) for i in range(pages)], "Count": pages}}
    objects |= {3 + i: {"Type": Name("Page"), "Parent": Ref(2), "MediaBox": [0, 0, 595, 842]} for i in range(pages)}
    out, offsets = bytearray(b"%PDF-1.4\n"), []
    for num, value in objects.items():
        offsets.append(len(out))
        out += b"%d 0 obj\n" % num + written(value) + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return bytes(out + b"trailer\n" + written({"Size": len(objects) + 1, "Root": Ref(1)}) + b"\nstartxref\n%d\n%%%%EOF\n" % start)
