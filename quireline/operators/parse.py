"""Printed tables of contents to leveled entries: one call per document over its tokenised lines.

``parse_lines`` works on the lines of one document: split pages off, drop what is no entry, join wrapped titles, repair numbering, settle
pages, assign levels, flag pages out of order, and map printed to physical pages. Every doubt multiplies an entry's confidence and leaves a
note. ``printed_toc`` runs it over a table of lines, grouped by document; the largest group is the longest table of contents.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from quireline.functions import headings as H
from quireline.functions.numerals import CHINESE, chinese_numeral, half_width
from quireline.functions.tokens import CJK, LEADERS, Page, lone_page, split_page

#: Words and marks that a title does not end with.
OPEN_MARKS = "与和及的、，,:：;；(（—-–/&《“对在之以暨兼或其"
OPEN_WORDS = set("and or of the a an to in for with on at by from as its their into versus vs vs. & about between under over through toward towards via".split())
_FOOTNOTE = re.compile("注[：: ]|注释：|说明：|资料来源|数据来源|Notes?:|Sources?:")
_FOOT_MARKS = "*＊†‡※§¹²³⁴⁵⁶⁷⁸⁹"
_ENDS_FOOTNOTE = H.NUMBERED - {"arabic", "arabic_paren"} | {"matter", "container", "toc_heading"}
#: Kinds that open the body of a book.
_BODY = {"part", "subpart", "chapter", "section", "dotted", "arabic"}


@dataclass(frozen=True)
class Options:
    offset: int = 0
    roman_offset: int | None = None
    page_count: int | None = None
    indent_tolerance: float = 1.5


@dataclass
class Row:
    """A line, later an entry."""

    title: str
    page: Page | None
    indent: float
    lines: list[int]
    width: int
    strong: bool = False
    lone: bool = False
    conf: float = 1.0
    notes: list[str] = field(default_factory=list)
    heading: H.Heading = H.NONE
    inherited: bool = False
    level: int = 0
    physical: int | None = None

    def doubt(self, factor: float, note: str = "") -> None:
        self.conf *= factor
        if note:
            self.notes.append(note)

    def named(self, title: str) -> None:
        self.title, self.heading = title, H.classify(title)
        if self.heading.kind == "dotted":
            self.title = H.space_after_numbering(title)


def width_of(text: str) -> int:
    return len(text) + len(re.findall(f"[{CJK}ᄀ-ᅟ⺀-〾㄰-㆏︰-﹏！-｠￠-￦]", text))


def indent_of(line: str) -> float:
    return float(sum({"\t": 4, "　": 2}.get(c, 1) for c in line[: len(line) - len(line.lstrip())]))


def looks_cut_off(title: str) -> bool:
    if not title:
        return False
    if title[-1] in OPEN_MARKS or title.split(" ")[-1].lower() in OPEN_WORDS:
        return True
    return any(title.count(a) > title.count(b) for a, b in ("()", "（）", "《》", "“”", "[]")) or bool(re.search(f".第[0-9０-９{CHINESE}]+$", title))


def footnote_start(title: str) -> bool:
    text = title.strip()
    if _FOOTNOTE.match(text):
        return True
    circled = text[:1] and 0x2460 <= ord(text[0]) <= 0x2473
    if not text or not (circled or text[0] in _FOOT_MARKS):
        return False
    rest = text.lstrip(text[0] + _FOOT_MARKS + " ")
    kind = H.classify(rest).kind
    return len(rest) >= (12 if circled else 4) and kind not in H.NUMBERED | {"matter", "trailer", "container", "toc_heading"}


def is_figure_entry(title: str) -> bool:
    text = half_width(title)
    return bool(re.match(rf"(?:附图|附表|插图|图|表)\s*(?:[0-9]|[{CHINESE}][^{CJK}])|(?i:figure|fig\.?|table|plate|illustration)\s*[0-9]", text))


_FIGURE_HEADINGS = set("图表目录 图目录 表目录 插图目录 图表索引 图片目录 附图目录 附表目录 插图与表格目录 图与表目录 listoffigures listoftables listofillustrations listoffiguresandtables listoftablesandfigures figures tables illustrations".split())


def is_figure_heading(title: str) -> bool:
    return re.sub(r"\s", "", half_width(title)).lower().rstrip(":：.。-—·") in _FIGURE_HEADINGS


def is_index_line(line: str) -> bool:
    return bool(re.search(r"[^\W\d_].*?[\s,，][0-9]{1,4}(?:\s*[-–]\s*[0-9]{1,4})?(?:\s*[,，、]\s*[0-9]{1,4}(?:\s*[-–]\s*[0-9]{1,4})?)+[\s.]*$", half_width(line)))


def columns_of(line: str) -> list[str]:
    """A line with two entries side by side, as its entries."""
    if len(line) <= 400:
        # only behind what can end a page
        for m in re.finditer(r"(?<=[0-9０-９OolI|)）\]】}>」》〕页。，,;；:：'\"])\s+(?=\S)", line):
            if not re.search("[0-9０-９OolI|]", line[max(0, m.start() - 8) : m.start()]):
                continue
            left, right = split_page(line[: m.start()]), line[m.end() :]
            if not left.page or left.page.style != "arabic" or len(re.findall(r"[^\W\d_]", left.title)) < 2:
                continue
            led = re.search(f"(?:[{re.escape(LEADERS)}]\\s*){{2,}}[0-9０-９\\s]+$", line[: m.start()])
            if not (left.page.separation == "leader" and led or left.page.separation == "space" and len(m[0]) >= 3):
                continue
            other = split_page(right)
            if other.page and other.title and H.classify(other.title).kind in H.NUMBERED | {"matter"}:
                return [line[: m.start()], *columns_of(right)]
    return [line]


def _tokenised(lines: list[tuple[int, str, float | None]], warn) -> tuple[list[Row], bool]:
    """Rows in reading order, and whether the lines look like a book's index."""
    rows, right, lists, letters = [], [], 0, 0
    for number, line, indent in lines:
        text = line.lstrip()
        indent = indent_of(line) if indent is None else indent
        if not text:
            continue
        lists += is_index_line(text)
        letters += bool(re.fullmatch("[A-Z]", text.strip()))
        if page := lone_page(text):
            rows += right
            right = []
            rows.append(Row("", page, indent, [number], width_of(text), lone=True))
            continue
        parts = columns_of(text)
        if len(parts) == 1:
            rows += right
            right = []
        for k, part in enumerate(parts):
            s = split_page(part)
            if not s.title and not s.page:
                warn(number, f"no title or page, ignored: '{text.strip()}'")
                continue
            row = Row(s.title, s.page, indent, [number], width_of(part), lone=not s.title)
            row.strong = bool(s.page) and (s.page.separation == "leader" or s.wide)
            if len(parts) > 1:
                row.notes.append("second column of the line" if k else "two-column line split")
            if s.noise:
                row.doubt(0.95, "stray punctuation removed")
            if s.gibberish:
                row.doubt(0.7, "OCR noise removed from the end of the title")
            (right if k else rows).append(row)
    return rows + right, lists >= 2 or letters >= 3 or (lists >= 1 and letters >= 2)


def _without_others(rows: list[Row], column_style: bool, warn) -> list[Row]:
    """Rows without lists of figures, footnotes, and the heading of the table itself with the folio before it."""
    out, at = [], 0
    figure = [not r.lone and is_figure_entry(r.title) for r in rows] + [False] * 3
    while at < len(rows):
        row = rows[at]
        if row.lone:
            out.append(row)
            at += 1
            continue
        if figure[at + 1] and figure[at + 2] and (figure[at] or row.page is None and is_figure_heading(row.title)):
            end = at + 1
            while end < len(rows) and (rows[end].lone or figure[end] or is_figure_heading(rows[end].title)):
                end += 1
            while rows[end - 1].lone:
                end -= 1
            warn(row.lines[0], f"list of figures or tables skipped (to line {rows[end - 1].lines[-1]})")
            at = end
            continue
        if column_style and not row.strong and footnote_start(row.title):
            end = at + 1
            while end < len(rows) and not rows[end].lone and not rows[end].strong and H.classify(rows[end].title).kind not in _ENDS_FOOTNOTE:
                end += 1
            for r in rows[at:end]:
                warn(r.lines[0], f"footnote at the foot of a page skipped: '{r.title}'")
            at = end
            continue
        if row.page is None and at + 1 < len(rows) and not rows[at + 1].lone and H.classify(row.title).kind == "toc_heading":
            if len(out) > 1 and out[-1].lone and not out[-2].lone:
                folio = out.pop()
                warn(folio.lines[0], f"lone page number '{folio.page.raw}' ignored (the page's own number)")
            warn(row.lines[0], f"heading '{row.title}' skipped")
            at += 1
            continue
        out.append(row)
        at += 1
    return out


def _reference_width(rows: list[Row]) -> float | None:
    led = sorted(r.width for r in rows if not r.lone and r.page and r.page.separation == "leader")
    if len(led) >= 3:
        return led[len(led) // 2]
    paged = sorted(r.width for r in rows if not r.lone and r.page)
    return max(29, int(paged[len(paged) * 9 // 10] * 0.95 + 0.5)) if len(paged) >= 5 else None


def _joined(first: str, second: str, dash: bool) -> str:
    a, b = first[-1:], second[:1]
    if a == "-" and re.match("[a-z]", b) and first[-2:-1].isalpha():
        return first[:-1] + second
    digit_next_to_han = (a.isdigit() and re.match(f"[{CJK}]", b)) or (re.match(f"[{CJK}]", a) and b.isdigit())
    if dash or not a or not b or digit_next_to_han or (not a.isascii() and not b.isascii()):
        return first + second
    return first + " " + second


def _absorb(into: Row, row: Row, title: str, note: str) -> None:
    into.page, into.strong = row.page, row.strong
    into.lines, into.notes = into.lines + row.lines, into.notes + row.notes
    into.conf *= row.conf
    into.doubt(0.85, note)
    into.named(title)


def _assembled(rows: list[Row], column_style: bool, warn) -> list[Row]:
    """Lone pages joined to their titles and wrapped titles to their beginnings."""
    out: list[Row] = []
    width, last_line = _reference_width(rows), None
    for row in rows:
        before = out[-1] if out and out[-1].lines[-1] == last_line else None
        last_line = row.lines[-1]
        if row.lone:
            if before and before.page is None:
                before.page, before.lines = row.page, before.lines + row.lines
                before.doubt(0.9, f"page number on its own line {row.lines[0]}")
            else:
                warn(row.lines[0], f"lone page number '{row.page.raw}' ignored")
            continue
        if fixed := H.repair(row.title):
            row.title = fixed[0]
            row.doubt(0.9, f"OCR repair: {fixed[1]}")
        row.named(row.title)
        plain, lower = row.heading.kind == "none", bool(re.match("[a-z]", row.title))
        if before and plain:
            p = before.page
            if column_style and p and not before.strong and p.style == "arabic" and p.separation in ("glued", "space") and row.strong and row.indent > before.indent and (lower or re.match(f"[{CJK}]", row.title)) and (lower or before.heading.kind in H.NUMBERED):
                title = before.title + ("" if p.separation == "glued" else " ") + p.raw + (" " if re.match("[A-Za-z]", row.title) else "") + row.title
                _absorb(before, row, title, f"'{p.raw}' is part of the title, which continues on line {row.lines[0]}")
                before.strong = True
                warn(before.lines[0], f"'{p.raw}' read as part of a wrapped title, not as its page")
                continue
            dash = bool(re.match("—|--|－|―", row.title))
            wide = width is not None and before.width >= 0.85 * width
            if p is None and before.heading.kind not in ("matter", "container", "toc_heading", "trailer") and (looks_cut_off(before.title) or lower or wide or dash):
                _absorb(before, row, _joined(before.title, row.title, dash), f"title continues on line {row.lines[0]}")
                continue
        out.append(row)
    return out


def _without_headers(rows: list[Row], warn) -> list[Row]:
    repeated = Counter(r.title for r in rows if r.page is None and r.heading.kind == "none")
    out = []
    for r in rows:
        if r.page is None and r.heading.kind == "toc_heading":
            warn(r.lines[0], f"heading '{r.title}' skipped")
        elif r.page is None and r.heading.kind == "none" and repeated[r.title] >= 2:
            warn(r.lines[0], f"repeated line '{r.title}' skipped (running header?)")
        else:
            if r.heading.kind == "toc_heading":
                r.heading = replace(r.heading, kind="matter")
            out.append(r)
    return out


_HIGHER = {"part": set(), "subpart": {"part"}, "chapter": {"part", "subpart"}, "section": {"part", "subpart", "chapter"}}


def _restore_ordinals(rows: list[Row]) -> None:
    """Lost numerals from the neighbours of their kind, which have to agree; lost closing brackets."""

    def neighbour(i: int, step: int):
        kind, j = rows[i].heading.kind, i + step
        while 0 <= j < len(rows):
            other = rows[j].heading
            if other.kind in _HIGHER[kind]:
                return None, True, None
            if other.kind == kind and other.numbers:
                return other.numbers[0], False, bool(re.search(f"第[{CHINESE}]", rows[j].title))
            j += step
        return None, False, None

    for i, r in enumerate(rows):
        h = r.heading
        if h.numbers or not h.ocr or h.kind not in _HIGHER:
            continue
        (low, edge, han), (high, _, han_next) = neighbour(i, -1), neighbour(i, 1)
        up = low + 1 if low is not None else 1 if edge or i == 0 else None
        down = high - 1 if high is not None else None
        value = (up if up == down else None) if up is not None and down is not None else up if up is not None else down
        if not value or value < 1:
            continue
        chinese = han if han is not None else han_next if han_next is not None else True
        fixed = H.insert_ordinal(r.title, chinese_numeral(value) or str(value) if chinese else str(value))
        if fixed:
            r.notes.append(f"numeral lost by OCR; restored from the neighbouring headings: '{fixed}'")
            r.title, r.heading = fixed, replace(h, numbers=(value,))
    if sum(r.heading.kind == "cn_paren" for r in rows) >= 2:
        for r in rows:
            m = re.match(f"([(（])([{CHINESE}]{{1,3}})(?=[{CJK}])(?![{CHINESE}])", r.title) if r.heading.kind == "none" else None
            if m:
                closed = m[0] + (")" if m[1] == "(" else "）")
                r.doubt(0.9, f"closing bracket lost by OCR; read as '{closed}'")
                r.named(closed + r.title[m.end() :])


def _unglue(rows: list[Row]) -> None:
    """A dotted number that swallowed the quantity behind it, where the number expected next fits."""
    last, chapter = None, None
    for r in rows:
        kind, numbers = r.heading.kind, r.heading.numbers
        if kind in ("chapter", "arabic", "part"):
            last = None
            chapter = None if kind == "part" else (numbers[0] if numbers else chapter)
            continue
        wanted = [] if last is None else [*(last[: d - 1] + (last[d - 1] + 1,) for d in range(2, len(last) + 1)), last + (1,)]
        wanted += [(chapter, 1), (chapter + 1, 1)] if chapter is not None else []
        if kind not in ("dotted", "none"):
            continue
        if not (kind == "dotted" and (not wanted or numbers in wanted)):
            text = half_width(r.title)
            for number in sorted(wanted, key=len, reverse=True):
                lead = ".".join(map(str, number))
                m = re.match(re.escape(lead) + r"([0-9]+(?:\.[0-9]+|(?=[%年月日倍万亿千百兆元个种项岁次位天])))", text)
                if m:
                    r.doubt(0.9, f"numbering '{m[0]}' read as {lead} followed by '{m[1]}' (OCR dropped a space)")
                    r.named(r.title[: len(lead)] + " " + r.title[len(lead) :])
                    last = number
                    break
            else:
                last = numbers if kind == "dotted" else last
        else:
            last = numbers


def _settle_pages(rows: list[Row]) -> None:
    """Roman pages read as ones, penalties for how a page is set off, and pages for entries without one."""
    body = next((i for i, r in enumerate(rows) if r.heading.kind in _BODY), None)
    first = next((r.page.value for r in rows[body:] if r.page and r.page.style == "arabic"), None) if body is not None else None
    if first is not None and first <= 3:
        for r in rows[:body]:
            p = r.page
            if r.heading.kind in ("matter", "none") and p and p.style == "arabic" and p.value >= first and re.fullmatch("[1lI|]{1,3}", p.raw):
                r.page = Page("roman", len(p.raw), "i" * len(p.raw), p.separation, ocr=True)
                r.doubt(0.8, f"front matter before page {first} of chapter 1: read '{p.raw}' as roman")
    ahead, upcoming = [None] * len(rows), None
    for i in range(len(rows) - 1, -1, -1):
        ahead[i] = upcoming
        if rows[i].page and rows[i].page.style == "arabic":
            upcoming = rows[i].page.value
    seen = None
    for r, later in zip(rows, ahead, strict=True):
        p = r.page
        if p is None:
            continue
        if p.style == "roman" and seen is not None and re.fullmatch("[Il|]+", p.raw):
            value = int("1" * len(p.raw))
            if value >= seen and (later is None or value <= later):
                r.page = p = Page("arabic", value, p.raw, p.separation, ocr=True, is_range=p.is_range)
        if p.style == "arabic":
            seen = p.value
        if p.separation in ("space", "bracket"):
            r.doubt(0.95)
        elif p.separation == "glued":
            r.doubt(0.85, "page number glued to the title")
        if p.ocr:
            r.doubt(0.7, f"OCR repair: page '{p.raw}' read as {p.value}")
        if p.is_range:
            r.doubt(0.95, "page range; using the first page")
    own = [i for i, r in enumerate(rows) if r.page]
    for i, r in enumerate(rows):
        if r.page and not r.inherited:
            continue
        at = bisect_right(own, i)
        source = own[at] if at < len(own) else own[-1] if own else None
        r.inherited, r.conf = True, min(r.conf, 0.6)
        if source is None:
            r.notes.append("no page number")
        else:
            r.page = rows[source].page
            r.notes.append(f"no page number; using the {'next' if source > i else 'previous'} entry's page (line {rows[source].lines[0]})")


def anchored(values: list[float], tolerance: float) -> list[float]:
    """First values of clusters: one begins where a value is over ``tolerance`` above the cluster's first."""
    out: list[float] = []
    for v in sorted(set(values)):
        if not out or v - out[-1] > tolerance:
            out.append(v)
    return out


def _column_ranks(rows: list[Row], ranks: list[float | None], tolerance: float) -> tuple[list[int], dict[int, float]]:
    """Cluster of each row's indent, and a rank for each cluster if indentation says anything."""
    starts = anchored([r.indent for r in rows], tolerance)
    cluster = [bisect_right(starts, r.indent) - 1 for r in rows]
    sizes = Counter(cluster)
    if len(starts) < 2 or sum(n >= 2 for n in sizes.values()) < 2:
        return cluster, {}
    known: dict[int, float] = {}
    for c in sizes:
        counts = Counter(k for k, own in zip(ranks, cluster, strict=True) if own == c and k is not None)
        if counts:
            known[c] = min(counts, key=lambda k: (-counts[k], k))
    order = sorted(known)
    if any(known[a] >= known[b] for a, b in zip(order, order[1:], strict=False)):
        known, order = {}, []
    out = dict(known)
    for c in range(len(starts)):
        if c not in out:
            low, high = max((k for k in order if k < c), default=None), min((k for k in order if k > c), default=None)
            if low is not None and high is not None:
                out[c] = (known[low] + known[high]) / 2
            elif low is not None:
                out[c] = known[low] + 0.5 * (c - low)
            elif high is not None:
                out[c] = known[high] - 0.5 * (high - c)
            else:
                out[c] = float(c)
    return cluster, out


def _arabic_heads(rows: list[Row]) -> bool:
    """Whether "1 Title" stands above "1.1" in this table."""
    chapter, hits, total = None, 0, 0
    for r in rows:
        if r.heading.kind == "arabic":
            chapter = r.heading.numbers[0]
        elif r.heading.kind in ("chapter", "part"):
            chapter = None
        elif r.heading.kind == "dotted":
            total += 1
            hits += r.heading.numbers[0] == chapter
    return hits >= 1 and 2 * hits >= total


def assign_levels(rows: list[Row], tolerance: float = 1.5) -> None:
    """A stack of ranks: numbering gives a rank, or the column of the indent does; matter and containers start over."""
    heads = _arabic_heads(rows)
    ranks = [H.rank(r.heading, heads) for r in rows]
    structural = [i for i, r in enumerate(rows) if r.heading.kind in ("part", "chapter") or (heads and r.heading.kind == "arabic")]
    if not structural:
        numbered = [k for r, k in zip(rows, ranks, strict=True) if k is not None and r.heading.kind != "appendix"]
        structural = [i for i, (r, k) in enumerate(zip(rows, ranks, strict=True)) if numbered and k == min(numbered) and r.heading.kind != "appendix"]
    inside = {r.heading.keyword for i, r in enumerate(rows) if r.heading.kind == "matter" and structural and structural[0] < i < structural[-1]}
    cluster, column = _column_ranks(rows, ranks, tolerance)
    any_numbered = any(k is not None for k in ranks)
    stack: list[float] = []
    used: list[float | None] = []
    for i, r in enumerate(rows):
        kind, own = r.heading.kind, ranks[i]
        trailing = kind == "trailer" or (kind == "matter" and r.heading.keyword in inside and i > structural[0])
        if trailing:
            limit = 4 if kind == "trailer" and ("节" in r.heading.keyword or len(r.heading.numbers) >= 2) else 1
            above = [j for j, k in enumerate(stack) if k <= limit]
            r.level = above[-1] + 1 if above else min(1, len(stack))
            stack = stack[: max(1, r.level)]
        elif kind in ("matter", "toc_heading"):
            r.level, stack = 0, [column[cluster[i]]] if column else []
        elif kind == "container":
            r.level, stack = 0, [-0.5]
        elif own is not None or column:
            by_column = own is None
            k = column[cluster[i]] if by_column else own
            sibling = next((j for j in range(i - 1, -1, -1) if cluster[j] <= cluster[i]), None) if by_column else None
            if sibling is not None and cluster[sibling] == cluster[i] and used[sibling] is not None:
                k = used[sibling]
            while stack and stack[-1] >= k:
                stack.pop()
            r.level = len(stack)
            stack.append(k)
            used.append(k)
            if by_column:
                r.doubt(0.9, "level from indentation")
            continue
        else:
            before = rows[i - 1] if i else None
            if before is not None and before.heading.kind == "none":
                r.level = before.level
            else:
                r.level = len(stack) if not stack or stack[-1] <= 2 else len(stack) - 1
            if any_numbered:
                r.doubt(0.8, "level guessed for an entry without numbering")
        used.append(None)


def kept_in_order(values: list[int]) -> set[int]:
    """Places of a longest non-decreasing subsequence."""
    tails, ends, back = [], [], []
    for i, v in enumerate(values):
        at = bisect_right(tails, v)
        back.append(ends[at - 1] if at else None)
        tails[at : at + 1], ends[at : at + 1] = [v], [i]
    out, at = set(), ends[-1] if ends else None
    while at is not None:
        out.add(at)
        at = back[at]
    return out


def _check_order(rows: list[Row], warn) -> None:
    for style in ("arabic", "roman"):
        own = [i for i, r in enumerate(rows) if r.page and r.page.style == style and not r.inherited]
        kept = {own[k] for k in kept_in_order([rows[i].page.value for i in own])}
        for i in own:
            if i not in kept:
                near = [("previous", max((j for j in kept if j < i), default=None)), ("next", min((j for j in kept if j > i), default=None))]
                context = ", ".join(f"{name} {rows[j].page.raw} on line {rows[j].lines[0]}" for name, j in near if j is not None)
                note = f"page order: page {rows[i].page.raw} is out of order" + (f" ({context})" if context else "")
                rows[i].doubt(0.4, note)
                warn(rows[i].lines[0], note)


def _map_pages(rows: list[Row], options: Options, warn) -> None:
    for r in rows:
        p, note = r.page, ""
        if p is None:
            continue
        if p.style == "prefixed":
            note = f"page '{p.raw}' uses appendix-style numbering and cannot be mapped"
        elif p.style == "roman" and options.roman_offset is None:
            note = f"front-matter page '{p.raw}' is not mapped without a front-matter offset"
        else:
            if p.style == "roman":
                r.doubt(0.9)
            physical = p.value + (options.offset if p.style == "arabic" else options.roman_offset)
            if physical < 1 or (options.page_count is not None and physical > options.page_count):
                note = f"page {p.raw} maps to physical page {physical}, which is not there"
            else:
                r.physical = physical
        if note:
            r.doubt(0.3, note)
            if not r.inherited or p.style in ("arabic",):
                warn(r.lines[0], note)


def parse_lines(lines: list[tuple[int, str, float | None]], options: Options = Options()) -> tuple[list[Row], list[tuple[int, str]]]:  # noqa: B008
    """(entries, warnings by line) of one document's lines: (line number, text, indent or None)."""
    warnings: list[tuple[int, str]] = []
    warn = lambda line, text: warnings.append((line, text))
    rows, index_like = _tokenised(lines, warn)
    paged = [r for r in rows if not r.lone and r.page]
    column_style = len(paged) >= 5 and sum(r.strong for r in paged) >= 0.6 * len(paged)
    rows = _assembled(_without_others(rows, column_style, warn), column_style, warn)
    rows = _without_headers(rows, warn)
    _restore_ordinals(rows)
    _unglue(rows)
    if index_like:
        for r in rows:
            r.doubt(0.5, "the lines look like a book index, not a table of contents")
        if rows:
            warn(rows[0].lines[0], "these lines look like a book index; every entry is flagged")
    for r in rows:
        if not re.search(r"[^\W\d_]", r.title):
            r.doubt(0.5, "title has no letters")
        elif len(r.title) == 1 and not re.match(f"[{CJK}]", r.title):
            r.doubt(0.6, "one-character title")
        if r.heading.ocr:
            r.doubt(0.9, "OCR repair in the numbering")
    _settle_pages(rows)
    assign_levels(rows, options.indent_tolerance)
    last = -1
    for r in rows:
        if r.level > last + 1:
            r.doubt(0.8, f"level lowered from {r.level} to {last + 1}")
            r.level = last + 1
        last = r.level
    _check_order(rows, warn)
    _map_pages(rows, options, warn)
    for r in rows:
        r.conf = int(r.conf * 100 + 0.5) / 100
    return rows, sorted(warnings, key=lambda w: w[0])


SCHEMA = "pos int, title string, level int, kind string, page_style string, printed_page int, page_raw string, physical_page int, inherited boolean, confidence double, lines string, notes string"


def printed_toc(lines: DataFrame, doc: str = "doc_id", *, line_no: str = "line_no", text: str = "text", indent: str | None = None, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Entries of every document: SCHEMA behind the document's key; ``lines`` and ``notes`` are JSON arrays. Null texts are blank lines."""
    from quireline.operators.grouped import per_group

    kind = lines.schema[doc].dataType.simpleString()

    def run(own: list[tuple]) -> list[tuple]:
        rows, _ = parse_lines([(n, t or "", None if not x or x[0] is None else float(x[0])) for _, n, t, *x in own], options)
        key = own[0][0]
        return [
            (key, i, r.title, r.level, r.heading.kind, r.page and r.page.style, r.page and r.page.value, r.page and r.page.raw, r.physical, r.inherited, r.conf, json.dumps(r.lines), json.dumps(r.notes, ensure_ascii=False))
            for i, r in enumerate(rows)
        ]

    held = lines.select(doc, line_no, text, *([indent] if indent else []))
    return per_group(held, [doc], [line_no], run, f"{doc} {kind}, {SCHEMA}")


def review_text(entries: list[Row], *, least: float = 0.75) -> str:
    """Indented text for a reviewer; doubtful or unmapped entries have a comment above."""
    out = ["# title, page; lines with '# ?' say why the next entry is doubtful"]
    for r in entries:
        if r.conf < least or r.physical is None:
            out.append("# ? " + f"confidence {r.conf:.2f}" + "".join(f"; {n}" for n in r.notes))
        page = "" if r.physical is None else f"\t{r.physical}"
        out.append(("# ? " if r.physical is None else "") + "\t" * r.level + r.title + page)
    return "\n".join(out) + "\n"
