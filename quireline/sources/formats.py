"""Outline files: indented text, level-by-space text, JSON, OPML and bookmark XML; reading, writing, detection, and tables of either.

Every reader gives raw items (title, level, page or None, line); ``settled`` makes entries of them: a missing page is the one before, levels
rise by one at most, empty titles get a name. The strict text format refuses what it does not understand instead.
"""

from __future__ import annotations

import json
import re
import xml.parsers.expat
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireline.operators.scans import ordered

FORMATS = ("text", "spaces", "json", "opml", "xml")
MAX_PAGE, MAX_DEPTH, MAX_BYTES = 100_000_000, 64, 20 << 20
_LINE = re.compile(r"\r\n|\r|\n")
_JSON_LISTS = ("items", "outline", "entries", "bookmarks", "toc", "children")


class OutlineError(ValueError):
    """A file that cannot be read as the format asks; ``line`` is 0 if there is none."""

    def __init__(self, message: str, line: int = 0):
        super().__init__(f"line {line}: {message}" if line else message)
        self.line = line


@dataclass(frozen=True)
class Item:
    title: str
    level: int
    page: int | None
    line: int = 0


def one_line(text: str) -> str:
    return re.sub(r"[\s\x00-\x1f\x7f-\x9f]+", " ", text).strip()


def parse_int(text: object) -> int | None:
    if isinstance(text, bool) or text is None:
        return None
    if isinstance(text, (int, float)):
        return int(text) if text == int(text) and abs(text) < 1e9 else None
    plain = str(text).translate({0xFF10 + i: 0x30 + i for i in range(10)}).strip()
    return int(plain) if re.fullmatch(r"[+-]?[0-9]{1,8}|[0-9]{9}", plain) else None


def decode_text(data: bytes) -> str:
    """UTF-16 by its mark, UTF-8, else GB18030."""
    try:
        if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return data.decode("utf-16")
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        try:
            return data.decode("gb18030")
        except UnicodeDecodeError:
            raise OutlineError("neither UTF-8 nor GB18030") from None


def read_text(text: str) -> list[Item]:
    """Strict: indent (tab, two blanks or U+3000 a level), title, white space, page; ``#`` in front is a comment."""
    out, last = [], -1
    for number, line in enumerate(_LINE.split(text.removeprefix("﻿")), 1):
        if line.startswith("#") or not line.strip():
            continue
        lead = re.match("[\t 　]*", line)[0]
        if line[len(lead)].isspace():
            raise OutlineError(f"indentation uses U+{ord(line[len(lead)]):04X}", number)
        m = re.fullmatch(r"(.*\S)\s+(\S+)", line.strip(), re.S)
        if not m:
            raise OutlineError(f"expected a title and a page, got '{line.strip()}'", number)
        if not re.fullmatch("[0-9]{1,12}", m[2]) or not 0 < int(m[2]) <= MAX_PAGE:
            raise OutlineError(f"page must be a positive integer, got '{m[2]}'", number)
        level = lead.count("\t") + lead.count("　") + lead.count(" ") // 2
        if level > last + 1:
            raise OutlineError(f"level jumps from {last} to {level}" if last >= 0 else "the first entry must not be indented", number)
        out.append(Item(m[1], level, int(m[2]), number))
        last = level
    return out


def split_number(line: str) -> tuple[str, int | None]:
    """A trailing number, perhaps negative, or one in brackets."""
    if m := re.fullmatch(r"(.*?)((?<!-)-[0-9]{1,9}|(?<![0-9])[0-9]{1,10})", line, re.S):
        return m[1], int(m[2])
    if m := re.fullmatch(r"(.*)[(\[{<（【「《]([0-9]{1,10})[)\]}>）】」》]", line, re.S):
        return m[1], int(m[2])
    return line, None


def read_spaces(text: str) -> list[Item]:
    """Each distinct width of indentation is a level, six at most."""
    rows = []
    for number, line in enumerate(_LINE.split(text.removeprefix("﻿")), 1):
        if line.strip():
            title, page = split_number(line.rstrip())
            rows.append((len(line) - len(line.lstrip()), title.rstrip(" .-").strip(), page, number))
    level = {w: min(i, 5) for i, w in enumerate(sorted({r[0] for r in rows}))}
    return [Item(title, level[w], page, number) for w, title, page, number in rows]


def read_json(text: str) -> list[Item]:
    try:
        held = json.loads(text.removeprefix("﻿"))
    except (ValueError, RecursionError) as e:
        raise OutlineError(f"invalid JSON: {e}") from None
    if isinstance(held, dict):
        held = next((held[k] for k in _JSON_LISTS if isinstance(held.get(k), list)), None)
    if not isinstance(held, list):
        raise OutlineError("expected an array of objects with title, level and page")
    out: list[Item] = []
    first = lambda d, *keys: next((d[k] for k in keys if d.get(k) is not None), None)

    def visit(rows: list, depth: int) -> None:
        if depth >= MAX_DEPTH:
            raise OutlineError("nested too deeply")
        for d in rows:
            if not isinstance(d, dict):
                raise OutlineError(f"item {len(out) + 1} is not an object")
            title = first(d, "title", "text", "name", "Title")
            level = parse_int(d.get("level"))
            page, index = parse_int(first(d, "page", "Page")), parse_int(first(d, "page_index", "pageIndex"))
            level = depth if level is None else level
            out.append(Item(title if isinstance(title, str) else "", level, page if page is not None else None if index is None else index + 1, len(out) + 1))
            inner = first(d, "children", "kids", "items")
            if isinstance(inner, list):
                visit(inner, level + 1)

    visit(held, 0)
    return out


@dataclass
class Element:
    name: str
    attributes: dict[str, str]
    children: list[Element]
    line: int

    def attribute(self, *names: str) -> str | None:
        low = {k.lower(): v for k, v in self.attributes.items()}
        return next((low[n.lower()] for n in names if n.lower() in low), None)


def read_xml_tree(data: bytes) -> Element:
    """Elements and attributes; document types with declarations of their own, and depths of 512, are refused."""
    parser, stack, roots = xml.parsers.expat.ParserCreate(), [], []

    def start(name, attributes):
        element = Element(name, attributes, [], parser.CurrentLineNumber)
        if len(stack) >= 512:
            raise OutlineError("nested too deeply", element.line)
        (stack[-1].children if stack else roots).append(element)
        stack.append(element)

    def refuse(_name, _system, _public, internal):
        if internal:
            raise OutlineError("a document type with declarations is refused", parser.CurrentLineNumber)

    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = start, lambda _: stack.pop(), refuse
    try:
        parser.Parse(data, True)
    except xml.parsers.expat.ExpatError as e:
        raise OutlineError(f"XML: {e}", e.lineno) from None
    return roots[0]


def _walk(parent: Element, names: set[str], pick, level: int = 0) -> list[Item]:
    out = []
    for child in parent.children:
        if child.name.lower() in names:
            title, page = pick(child)
            out += [Item(title, level, page, child.line), *_walk(child, names, pick, level + 1)]
    return out


def read_opml(data: bytes) -> list[Item]:
    root = read_xml_tree(data)
    if root.name.lower() != "opml":
        raise OutlineError(f"not OPML: <{root.name}>")
    body = next((c for c in root.children if c.name.lower() == "body"), None)
    if body is None:
        raise OutlineError("no <body>")
    return _walk(body, {"outline"}, lambda e: (e.attribute("text", "title", "_text") or "", parse_int(e.attribute("page", "_page", "pageNumber", "pagenum", "pageno"))))


def read_bookmarks(data: bytes) -> list[Item]:
    """Bookmark XML with Chinese or English names; the first container in breadth order."""
    root = read_xml_tree(data)
    queue = [root]
    for element in queue:
        if element.name.lower() in ("文档书签", "documentbookmark", "bookmarks", "outline"):
            root = element
            break
        queue += element.children
    return _walk(root, {"书签", "bookmark"}, lambda e: (e.attribute("文本", "Title", "text") or "", parse_int(e.attribute("页码", "Page"))))


def read(data: bytes, kind: str) -> list[Item]:
    if len(data) > MAX_BYTES:
        raise OutlineError("the file is too large")
    if kind == "opml":
        return read_opml(data)
    if kind == "xml":
        return read_bookmarks(data)
    return {"text": read_text, "spaces": read_spaces, "json": read_json}[kind](decode_text(data))


def detect(data: bytes, name: str = "") -> str:
    """By extension, then by the first bytes, then by whether the strict text format takes it."""
    extension = name.rpartition(".")[2].lower() if "." in name else ""
    if extension in ("opml", "json"):
        return extension
    head = data[:4096].decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8", "replace").lstrip("﻿ \t\r\n")
    if head[:1] in ("[", "{"):
        return "json"
    if head[:1] == "<" or extension == "xml":
        return "opml" if "<opml" in head.lower() else "xml"
    try:
        read_text(data.decode("utf-8"))
        return "text"
    except (UnicodeDecodeError, OutlineError):
        return "spaces"


def settled(items: list[Item]) -> tuple[list[Item], list[str]]:
    """(entries with a page each, what had to be changed)."""
    out, notes, level, page = [], [], -1, None
    for r in items:
        own = r.page
        if own is not None and own < 1:
            notes.append(f"{r.line}: page {own} is not a page")
            own = None
        if own is None:
            own = page or 1
            notes.append(f"{r.line}: '{one_line(r.title)}' has no page; using page {own}")
        if r.level > level + 1:
            notes.append(f"{r.line}: level {r.level} lowered to {level + 1}")
        level, page = max(0, min(r.level, level + 1)), own
        title = one_line(r.title)
        if not title:
            notes.append(f"{r.line}: empty title")
        out.append(Item(title or "(untitled)", level, own, r.line))
    return out, notes


def shifted(items: list[Item], offset: int) -> list[Item]:
    for r in items:
        if r.page + offset < 1:
            raise OutlineError(f"page {r.page} with offset {offset} is below 1", r.line)
    return [Item(r.title, r.level, r.page + offset, r.line) for r in items]


def _text_title(title: str, level: int) -> str:
    title = one_line(title) or "(untitled)"
    return "＃" + title[1:] if title.startswith("#") and level == 0 else title


def _escaped(text: str) -> str:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = text.replace(plain, entity)
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", " ", text)


def _tree(items: list[Item], tag: str, attributes, pad: str, unit: str) -> str:
    """Nested elements; those without children are closed at once."""
    out, open_levels = "", []
    items, _ = settled(items)
    for i, r in enumerate(items):
        while open_levels and open_levels[-1] >= r.level:
            open_levels.pop()
            out += f"{pad}{unit * len(open_levels)}</{tag}>\n"
        parent = i + 1 < len(items) and items[i + 1].level > r.level
        out += f"{pad}{unit * r.level}<{tag} {attributes(r)}{'>' if parent else ' />'}\n"
        if parent:
            open_levels.append(r.level)
    while open_levels:
        open_levels.pop()
        out += f"{pad}{unit * len(open_levels)}</{tag}>\n"
    return out


def write(items: list[Item], kind: str, title: str = "Outline") -> str:
    if kind == "text":
        return "".join(f"{chr(9) * r.level}{_text_title(r.title, r.level)}\t{r.page}\n" for r in items)
    if kind == "spaces":
        return "".join(f"{'  ' * r.level}{one_line(r.title)} {r.page}\n" for r in items)
    if kind == "json":
        rows = ",\n".join(f'  {{"title": {json.dumps(r.title, ensure_ascii=False)}, "level": {r.level}, "page": {r.page}}}' for r in items)
        return f"[\n{rows}\n]\n" if rows else "[]\n"
    if kind == "opml":
        body = _tree(items, "outline", lambda r: f'text="{_escaped(r.title)}" page="{r.page}"', "    ", "  ")
        return f'<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0">\n  <head>\n    <title>{_escaped(title)}</title>\n  </head>\n  <body>\n{body}  </body>\n</opml>\n'
    if kind == "xml":
        body = _tree(items, "书签", lambda r: f'文本="{_escaped(r.title)}" 动作="转到页面" 页码="{r.page}"', "\t\t", "\t")
        return f'<?xml version="1.0" encoding="utf-8"?>\n<PDF信息>\n\t<文档书签>\n{body}\t</文档书签>\n</PDF信息>\n'
    raise ValueError(f"unknown format {kind}")


ITEM_TYPE = "struct<format:string,problem:string,notes:array<string>,items:array<struct<title:string,level:int,page:int,line:int>>>"


def read_column(content, name=None, kind: str | None = None):
    """Files of a binary column as outlines; what a file cannot be read as is its ``problem``, never an error of the job."""
    @F.pandas_udf(ITEM_TYPE)
    def run(data: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = []
        for d, n in zip(data, names, strict=True):
            own = kind or detect(bytes(d or b""), n or "")
            try:
                items, notes = settled(read(bytes(d or b""), own))
                rows.append((own, None, notes, [(r.title, r.level, r.page, r.line) for r in items]))
            except OutlineError as e:
                rows.append((own, str(e), [], []))
        return pd.DataFrame(rows, columns=["format", "problem", "notes", "items"])

    return run(content, F.lit("") if name is None else name)


def read_files(spark, path: str, kind: str | None = None) -> DataFrame:
    """Outline files of a folder: path, format, problem, notes, pos, title, level, page, line."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= MAX_BYTES)
    held = files.select("path", read_column(F.col("content"), F.col("path"), kind).alias("o"))
    return held.select("path", "o.format", "o.problem", "o.notes", F.posexplode_outer("o.items").alias("pos", "i")).select("path", "format", "problem", "notes", "pos", "i.*")


def text_sink(rows: DataFrame, doc: str, pos: str, *, title: str = "title", level: str = "level", page: str = "page") -> DataFrame:
    """One indented text for each document, by native aggregation."""
    name = F.trim(F.regexp_replace(title, r"[\s\p{Cntrl}]+", " "))
    name = F.when(name == "", "(untitled)").otherwise(name)
    name = F.when(name.startswith("#") & (F.col(level) == 0), F.concat(F.lit("＃"), F.substring(name, F.lit(2), F.length(name)))).otherwise(name)
    line = F.concat(F.repeat(F.lit("\t"), F.col(level).cast("int")), name, F.lit("\t"), F.col(page).cast("string"), F.lit("\n"))
    return rows.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), line.alias("l")))), lambda r: r["l"]), "").alias("text"))


def file_sink(rows: DataFrame, doc: str, pos: str, kind: str, *, title: str = "title", level: str = "level", page: str = "page") -> DataFrame:
    """One file text of any format for each document."""
    document = rows.schema[doc].dataType.simpleString()

    from quireline.operators.grouped import per_group

    def run(own: list[tuple]) -> list[tuple]:
        return [(own[0][0], write(settled([Item(t or "", int(k), None if p is None else int(p)) for _, _, t, k, p in own])[0], kind))]

    return per_group(rows.select(doc, pos, title, level, page), [doc], [pos], run, f"{doc} {document}, text string")


def space_levels(lines: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    """Level-by-space natively: the rank of a line's indent among those of its document, five at most."""
    indent = F.length(line) - F.length(F.ltrim(F.regexp_replace(line, "^\t+", " ")))
    held = lines.filter(F.col(line).rlike(r"\S")).withColumn("__w", indent)
    return held.withColumn("level", F.least(F.lit(5), F.dense_rank().over(ordered(doc, "__w")) - 1)).drop("__w")
