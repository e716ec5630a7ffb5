"""A PDF file in memory: cross references of every revision, objects, pages and outline, with limits against hostile files."""

from __future__ import annotations

import re
from dataclasses import dataclass

from quireline.sources.pdf import filters
from quireline.sources.pdf.objects import Name, Parser, Ref, Stream, SyntaxFault, text_of

#: Fixed limits: revisions, references in a row, resolving depth, object numbers, outline items, bytes decoded per file.
SECTIONS, CHAIN, RESOLVE_DEPTH, OBJECTS, ITEMS, FILE_LIMIT = 100_000, 32, 64, 8_388_607, 1_000_000, 512 << 20


class PdfError(ValueError):
    pass


@dataclass(frozen=True)
class Entry:
    """kind: 0 free, 1 at an offset (generation in b), 2 in an object stream (a: its number, b: place)."""

    kind: int
    a: int
    b: int


@dataclass(frozen=True)
class OutlineRow:
    title: str
    level: int
    page_index: int | None


_HEADER = re.compile(rb"(?<![0-9])([0-9]{1,7})[\0\t\n\f\r ]+([0-9]{1,5})[\0\t\n\f\r ]+obj(?![A-Za-z0-9])")


class Document:
    def __init__(self, data: bytes):
        self.data, self.cache, self.inner, self.decoded, self.repairs, self.moved = data, {}, {}, 0, [], {}
        head = data[:1024].find(b"%PDF-")
        if head < 0:
            raise PdfError("no PDF header")
        self.base, self.rebuilt, self.xref_kind, self.revisions = 0, False, "table", 0
        self.startxref = None
        last = list(re.finditer(rb"startxref[\0\t\n\f\r ]+([0-9]{1,12})", data))
        failure = "no startxref"
        # offsets count from the file's start or from its header: the first that lands exactly
        for base in dict.fromkeys((0, head)) if last else ():
            try:
                self.base, self.startxref = base, int(last[-1][1])
                self._sections(int(last[-1][1]))
                if "Root" not in self.trailer:
                    raise PdfError("no catalog")
                self.pages = self._pages()
                break
            except (PdfError, SyntaxFault, filters.FilterError) as e:
                failure = str(e)
        else:
            self.base = 0
            self._rebuild(failure)
            self.pages = self._pages()

    # cross references

    def _sections(self, start: int) -> None:
        self.entries, self.trailer, self.revisions, self.cache = {}, {}, 0, {}
        seen, queue = set(), [start]
        while queue:
            at = queue.pop(0)
            if at in seen:
                continue
            if len(seen) >= SECTIONS:
                raise PdfError("too many revisions")
            seen.add(at)
            trailer, rows, kind = self._section(at + self.base)
            if not self.trailer:
                self.trailer, self.xref_kind = trailer, kind
            self.revisions += 1
            for num, entry in rows:
                self.entries.setdefault(num, entry)
            extra = [trailer.get(k) for k in ("XRefStm", "Prev")]
            queue = [x for x in extra if isinstance(x, int)] + queue

    def _section(self, at: int):
        if not 0 <= at < len(self.data):
            raise PdfError("startxref outside of the file")
        parser = Parser(self.data, at)
        if not parser.expect(b"xref"):
            return self._stream_section(at)
        rows = []
        while not parser.expect(b"trailer"):
            first, count = parser.word(), parser.word()
            if not (first.isdigit() and count.isdigit()):
                raise PdfError("cross-reference table")
            first, count = int(first), int(count)
            if first + count > OBJECTS:
                raise PdfError("object numbers too large")
            own = []
            for _ in range(count):
                offset, gen, kind = parser.word(), parser.word(), parser.word()
                if not (offset.isdigit() and gen.isdigit() and kind in (b"n", b"f")):
                    raise PdfError("cross-reference row")
                own.append((int(offset), int(gen), kind))
            if first == 1 and own and own[0] == (0, 65535, b"f"):
                first = 0  # numbered from 1 by mistake
            rows += [(first + i, Entry(int(kind == b"n" and offset > 0), offset, gen)) for i, (offset, gen, kind) in enumerate(own)]
        trailer = parser.value()
        if not isinstance(trailer, dict):
            raise PdfError("trailer")
        return trailer, rows, "table"

    def _stream_section(self, at: int):
        _, _, value = self._object_at(at)
        if not isinstance(value, Stream) or value.dict.get("Type") != "XRef":
            raise PdfError("no cross references where startxref points")
        widths, size = value.dict.get("W"), value.dict.get("Size")
        index = value.dict.get("Index") or [0, size]
        if not (isinstance(widths, list) and len(widths) == 3 and all(isinstance(w, int) and 0 <= w <= 8 for w in widths)) or not all(isinstance(x, int) and 0 <= x <= OBJECTS for x in index):
            raise PdfError("cross-reference stream")
        data, at, rows, step = self.stream_data(value), 0, [], sum(widths)
        for first, count in zip(index[::2], index[1::2], strict=False):
            for i in range(count):
                row = data[at : at + step]
                if len(row) < step or not step:
                    break
                cut = [row[sum(widths[:k]) : sum(widths[: k + 1])] for k in range(3)]
                kind, a, b = (int.from_bytes(c, "big") for c in cut)
                kind = kind if widths[0] else 1
                rows.append((first + i, Entry(kind if kind in (1, 2) else 0, a, b)))
                at += step
        return value.dict, rows, "stream"

    def _rebuild(self, failure: str) -> None:
        """From the headers of objects, for files whose cross references are of no use. Two definitions of one object are refused."""
        self.entries, self.trailer, self.cache, self.rebuilt = {}, {}, {}, True
        roots = set()
        for m in _HEADER.finditer(self.data):
            num, gen = int(m[1]), int(m[2])
            if self.entries.get(num, Entry(1, m.start(), gen)) != Entry(1, m.start(), gen):
                raise PdfError(f"{failure}; object {num} is there twice")
            self.entries[num] = Entry(1, m.start(), gen)
        for num, entry in list(self.entries.items()):
            try:
                _, _, value = self._object_at(entry.a)
            except (SyntaxFault, PdfError):
                continue
            if isinstance(value, dict) and value.get("Type") == "Catalog":
                roots.add(Ref(num, entry.b))
            if isinstance(value, Stream) and value.dict.get("Type") == "ObjStm":
                for place, inner in enumerate(self._object_stream(num)):
                    self.entries.setdefault(inner, Entry(2, num, place))
        for m in re.finditer(rb"trailer(?=[\0\t\n\f\r <])", self.data):
            try:
                found = Parser(self.data, m.end()).value()
            except SyntaxFault:
                continue
            if isinstance(found, dict) and isinstance(found.get("Root"), Ref):
                roots.add(found["Root"])
                self.trailer = self.trailer | found
        if len(roots) != 1:
            raise PdfError(f"{failure}; {len(roots)} catalogs")
        self.trailer["Root"] = roots.pop()

    # objects

    def _object_at(self, at: int):
        m = re.compile(rb"[\0\t\n\f\r ]*").match(self.data, at)
        header = _HEADER.match(self.data, m.end())
        if not header:
            raise PdfError(f"no object at {at}")
        parser = Parser(self.data, header.end())
        value = parser.value()
        parser.skip()
        if isinstance(value, dict) and self.data.startswith(b"stream", parser.at):
            start = parser.at + 6
            start += 2 if self.data[start : start + 2] == b"\r\n" else self.data[start : start + 1] in (b"\n", b"\r")
            length = value.get("Length")
            if isinstance(length, Ref):
                length = self.resolve(length) if getattr(self, "entries", None) else None
            end = start + length if isinstance(length, int) and length >= 0 else -1
            if not (start <= end <= len(self.data)) or not Parser(self.data, end).expect(b"endstream"):
                end = self.data.find(b"endstream", start)
                if end < 0:
                    raise PdfError("stream without end")
                end -= 2 if self.data[end - 2 : end] == b"\r\n" else self.data[end - 1 : end] in (b"\n", b"\r")
            value = Stream(value, start, end)
        return int(header[1]), int(header[2]), value

    def resolve(self, value, depth: int = 0):
        """What a reference stands for: null for free, missing and other generations; a ring of references is an error."""
        for _ in range(CHAIN):
            if not isinstance(value, Ref):
                return value
            value = self._fetch(value, depth)
        raise PdfError("ring of references")

    def _fetch(self, ref: Ref, depth: int):
        if ref in self.cache:
            if self.cache[ref] is ...:
                raise PdfError("object within itself")
            return self.cache[ref]
        if depth > RESOLVE_DEPTH:
            raise PdfError("references too deep")
        entry = self.entries.get(ref.num)
        self.cache[ref] = ...
        value = None
        try:
            if entry and entry.kind == 1 and entry.b == ref.gen:
                value = self._direct(ref, entry)
            elif entry and entry.kind == 2 and ref.gen == 0:
                value = self._object_stream(entry.a).get(ref.num)
        finally:
            self.cache.pop(ref)
        self.cache[ref] = value
        return value

    def _direct(self, ref: Ref, entry: Entry):
        try:
            num, gen, value = self._object_at(entry.a + self.base)
            if (num, gen) == (ref.num, ref.gen):
                return value
        except (PdfError, SyntaxFault):
            pass
        # a wrong offset: only if the file has exactly one such header
        found = [m.start() for m in re.finditer(rb"(?<![0-9])%d[\0\t\n\f\r ]+%d[\0\t\n\f\r ]+obj(?![A-Za-z0-9])" % (ref.num, ref.gen), self.data)]
        if len(found) != 1:
            raise PdfError(f"object {ref.num} is not where it should be")
        self.repairs.append(ref.num)
        self.moved[ref] = found[0] - self.base
        return self._object_at(found[0])[2]

    def _object_stream(self, num: int) -> dict:
        if num not in self.inner:
            entry = self.entries.get(num)
            value = self._direct(Ref(num, entry.b), entry) if entry and entry.kind == 1 else None
            if not isinstance(value, Stream):
                raise PdfError(f"object stream {num}")
            data, out = self.stream_data(value), {}
            head, first, count = Parser(data), self.resolve(value.dict.get("First")), self.resolve(value.dict.get("N"))
            if not isinstance(first, int) or not isinstance(count, int) or not 0 <= count <= OBJECTS:
                raise PdfError(f"object stream {num}")
            for _ in range(count):
                inner, at = head.word(), head.word()
                if not (inner.isdigit() and at.isdigit()):
                    break
                try:
                    out.setdefault(int(inner), Parser(data, first + int(at)).value())
                except SyntaxFault:
                    out.setdefault(int(inner), None)
            self.inner[num] = out
        return self.inner[num]

    def stream_data(self, stream: Stream) -> bytes:
        data = self.data[stream.start : stream.end]
        kinds, parameters = self.resolve(stream.dict.get("Filter")), self.resolve(stream.dict.get("DecodeParms"))
        kinds = kinds if isinstance(kinds, list) else [] if kinds is None else [kinds]
        parameters = parameters if isinstance(parameters, list) else [parameters]
        for i, kind in enumerate(kinds):
            kind, own = self.resolve(kind), self.resolve(parameters[i]) if i < len(parameters) else None
            own = own if isinstance(own, dict) else {}
            number = lambda k, d: own[k] if isinstance(own.get(k), int) else d  # noqa: B023, E731
            if kind in ("FlateDecode", "Fl"):
                data = filters.flate(data)
            elif kind in ("LZWDecode", "LZW"):
                data = filters.lzw(data, number("EarlyChange", 1))
            elif kind in ("RunLengthDecode", "RL"):
                data = filters.run_length(data)
            elif kind in ("ASCIIHexDecode", "AHx"):
                data = filters.ascii_hex(data)
            elif kind in ("ASCII85Decode", "A85"):
                data = filters.ascii_85(data)
            else:
                raise PdfError(f"filter {kind}")
            if kind in ("FlateDecode", "Fl", "LZWDecode", "LZW"):
                data = filters.unpredicted(data, number("Predictor", 1), number("Columns", 1), number("Colors", 1), number("BitsPerComponent", 8))
            self.decoded += len(data)
            if self.decoded > FILE_LIMIT:
                raise PdfError("the file decodes to too much")
        return data

    # pages and outline

    @property
    def catalog(self) -> dict:
        root = self.resolve(self.trailer.get("Root"))
        if not isinstance(root, dict):
            raise PdfError("no catalog")
        return root

    @property
    def encrypted(self) -> bool:
        return self.trailer.get("Encrypt") is not None

    def _pages(self) -> list[Ref]:
        """Depth first; a ring, a page that is there twice, a direct or missing child and a wrong count are refused."""
        top = self.catalog.get("Pages")
        if not isinstance(top, Ref):
            raise PdfError("no page tree")
        out, seen, stack, counts = [], set(), [top], {}
        while stack:
            ref = stack.pop()
            if not isinstance(ref, Ref):
                raise PdfError("page that is no object of its own")
            if ref in seen:
                raise PdfError("page tree with a ring or a page twice")
            seen.add(ref)
            node = self.resolve(ref)
            if not isinstance(node, dict):
                raise PdfError("missing page")
            kids = self.resolve(node.get("Kids"))
            if isinstance(kids, list):
                stack += reversed(kids)
                if ref == top:
                    counts["declared"] = self.resolve(node.get("Count"))
            else:
                out.append(ref)
        if isinstance(counts.get("declared"), int) and counts["declared"] != len(out):
            raise PdfError(f"{len(out)} pages, but a count of {counts['declared']}")
        return out

    def outline(self) -> list[OutlineRow]:
        place: dict[Ref, int] = {}
        for i, ref in enumerate(self.pages):
            place.setdefault(ref, i)
        root = self.resolve(self.catalog.get("Outlines"))
        out, seen = [], set()
        stack = [(root.get("First"), 0)] if isinstance(root, dict) else []
        while stack and len(out) < ITEMS:
            ref, level = stack.pop()
            item = self.resolve(ref)
            if not isinstance(ref, Ref) or ref in seen or not isinstance(item, dict):
                continue
            seen.add(ref)
            title = self.resolve(item.get("Title"))
            out.append(OutlineRow(text_of(title) if isinstance(title, bytes) else "", level, self._target(item, place)))
            stack += [(item.get("Next"), level), (item.get("First"), level + 1)]
        return out

    def _target(self, item: dict, place: dict[Ref, int]) -> int | None:
        target = self.resolve(item.get("Dest"))
        if target is None:
            action = self.resolve(item.get("A"))
            target = self.resolve(action.get("D")) if isinstance(action, dict) and action.get("S") == "GoTo" else None
        for _ in range(8):
            if isinstance(target, dict):
                target = self.resolve(target.get("D"))
            elif isinstance(target, (bytes, Name)):
                target = self.resolve(self._named(target))
            else:
                break
        if not isinstance(target, list) or not target:
            return None
        page = target[0]
        if isinstance(page, int):
            return page if 0 <= page < len(self.pages) else None
        return place.get(page) if isinstance(page, Ref) else None

    def _named(self, name):
        key = name.encode("latin-1") if isinstance(name, Name) else name
        names = self.resolve(self.catalog.get("Names"))
        stack, seen = [(names.get("Dests"), 0)] if isinstance(names, dict) else [], 0
        while stack and seen < 100_000:
            ref, depth = stack.pop()
            node, seen = self.resolve(ref), seen + 1
            if not isinstance(node, dict) or depth >= RESOLVE_DEPTH:
                continue
            pairs = self.resolve(node.get("Names"))
            for k, v in zip(pairs[::2], pairs[1::2], strict=False) if isinstance(pairs, list) else ():
                if self.resolve(k) == key:
                    return v
            kids = self.resolve(node.get("Kids"))
            stack += [(k, depth + 1) for k in reversed(kids)] if isinstance(kids, list) else []
        old = self.resolve(self.catalog.get("Dests"))
        return old.get(key.decode("latin-1")) if isinstance(old, dict) else None

    # summary

    def next_number(self) -> int:
        """Above all numbers that are declared, defined or referred to."""
        highest = max([0, *self.entries])
        size = self.trailer.get("Size")
        highest = max(highest, size - 1 if isinstance(size, int) else 0)
        for num, entry in list(self.entries.items()):
            if entry.kind == 0:
                continue
            try:
                stack = [self.resolve(Ref(num, entry.b if entry.kind == 1 else 0))]
            except (PdfError, SyntaxFault, filters.FilterError):
                continue
            while stack:
                value = stack.pop()
                if isinstance(value, Stream):
                    value = value.dict
                if isinstance(value, Ref):
                    highest = max(highest, value.num)
                elif isinstance(value, dict):
                    stack += value.values()
                elif isinstance(value, list):
                    stack += value
        return highest + 1

    def linearized(self) -> bool:
        m = _HEADER.search(self.data[:2048])
        try:
            first = self._object_at(m.start())[2] if m else None
        except (PdfError, SyntaxFault):
            first = None
        return isinstance(first, dict) and "Linearized" in first and first.get("L") == len(self.data)

    def info(self) -> dict:
        return {
            "xref": "rebuilt" if self.rebuilt else self.xref_kind,
            "revisions": self.revisions,
            "objects": sum(e.kind > 0 for e in self.entries.values()),
            "pages": len(self.pages),
            "encrypted": self.encrypted,
            "has_outline": bool(self.outline()) if not self.encrypted else False,
            "linearized": self.linearized(),
            "size": len(self.data),
        }
