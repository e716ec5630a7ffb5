"""The printed page at the end of a line of a table of contents, and the title before it.

A line is compared with shapes in the order of their strength; each is one regular expression, anchored at the line's end, on its half-width
form. What stands before a shape decides how the page is set off (leaders, blank, glued, bracket, alone) and may veto it. Readings that
optical recognition got wrong are repaired and marked.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import functions as F

from quireline.functions.numerals import half_width, roman_value

#: Characters of leaders and rules between a title and its page.
LEADERS = ".…·‥⋯‧•・･．﹒-—─–―‒_＿~～⋅∙°﹍﹎=━┄┈╌∶︰。"
#: Stray punctuation behind a page, and marks that misread leaders leave before a page or before a title.
NOISE, BEFORE_PAGE, BEFORE_TITLE = "。，,;；:：'\"’”‘“`´、!！*^\\/|｜¦", "、’‘'`,，×ˊˋ¸·⋅", "：:⋅・，,。'’`、·"
#: Letters that are read for digits, surely and (behind leaders only) possibly.
SURE = {"O": "0", "o": "0", "l": "1", "I": "1", "|": "1"}
LOOSE = SURE | {"D": "0", "Q": "0", "i": "1", "S": "5", "s": "5", "Z": "2", "z": "2", "B": "8", "g": "9", "q": "9", "b": "6", "G": "6", "T": "7"}
#: Words whose number belongs to the title.
NUMBERING_WORDS = set("part chapter chap ch section sec book volume vol appendix unit lesson lecture module act scene day step level phase stage no number figure fig table exercise problem war grade class version edition ed vol. no. ch. sec. fig.".split())
CJK = "一-鿿㐀-䶿豈-﫿\U00020000-\U0003134f぀-ヿ가-힯々〇"
_L = re.escape(LEADERS)
_DASH = "-–—~～‒−"


@dataclass(frozen=True)
class Page:
    """style: arabic, roman or prefixed; separation: leader, space, bracket, glued or alone."""

    style: str
    value: int
    raw: str
    separation: str
    ocr: bool = False
    is_range: bool = False


@dataclass(frozen=True)
class Split:
    title: str
    page: Page | None = None
    noise: bool = False
    gibberish: bool = False
    wide: bool = False


def _gap(text: str) -> int:
    """Width of the white space that ends ``text``; a tab counts twice."""
    tail = text[len(text.rstrip()) :]
    return len(tail) + tail.count("\t")


def _set_off(before: str) -> str | None:
    """How a page behind ``before`` is set off; None if it is part of a word."""
    bare = before.rstrip()
    if not bare:
        return "alone"
    if bare[-1] in LEADERS:
        return "leader"
    if bare != before:
        return "space"
    return None if re.match("[A-Za-z0-9]", bare[-1]) else "glued"


def _digits(text: str, known: dict[str, str]) -> str:
    return "".join(known.get(c, c) for c in text)


_BRACKET = re.compile(r"[(\[{<【「《〔]\s*(?:([0-9]{1,5})|([ivxlcdm]{1,15}))\s*[)\]}>】」》〕]$")
_PREFIXED = re.compile(r"(?<=[\s" + _L + r"])([A-HJ-NP-Z])[-–]?([0-9]{1,4})$")
_RANGE = re.compile(r"([0-9]{1,5})\s*[" + _DASH + r"至到]\s*[0-9]{1,6}$")
_RUN = re.compile(r"[0-9OolI|]+$")
_WORD = re.compile(r"(?<![A-Za-z])([0-9OolI|ivxcdmVXLCDM]+)[" + _DASH + r"][0-9OolI|ivxcdmVXLCDM" + _DASH + r"]*$")
_ROMAN = re.compile(r"[ivxlcdmIVXLCDMⅠ-ⅿ]+$")
_LOOSE = re.compile(r"(?:[" + _L + r"]\s*){2,}([0-9A-Za-z|]{2,5})$")
_POINT = re.compile(r"(?<=\s)([0-9])\.([0-9])$")
_WORD_PAGE = re.compile(r"(?:^|(?<=[\s" + _L + r"]))(?:pp?|s)[.\s]*$", re.I)


def _arabic(line: str) -> tuple[Page, int] | None:
    if m := _RANGE.search(line):
        # digits in front of a range would make it part of a longer number
        how = _set_off(line[: m.start()])
        if how and int(m[1]):
            return Page("arabic", int(m[1]), m[1], how, is_range=True), m.start()
    if not (m := _RUN.search(line)):
        return None
    run, at = m[0], m.start()
    if (word := _WORD.search(line)) and not re.fullmatch(r"[0-9OolI|]+", word[1]):
        return None  # a word of letters that could be numerals, and a number that a hyphen joins to it
    if not re.search("[0-9]", run):
        return None
    if at and re.match("[A-Za-z]", line[at - 1]):
        skip = re.search("[0-9]", run).start()
        run, at = run[skip:], at + skip
    how, plain = _set_off(line[:at]), _digits(run, SURE)
    if how is None or len(run) > 6 or len(plain) > 5 or not int(plain) or (plain != run and how == "glued"):
        return None
    return Page("arabic", int(plain), run, how, ocr=plain != run), at


def _letters(line: str) -> tuple[Page, int] | None:
    """Roman numerals, and letters that can only be misread digits."""
    m = re.search(r"[ivxlcdmIVXLCDMOo|Ⅰ-ⅿ]+$", line)
    if not m:
        return None
    run, at = m[0], m.start()
    how = _set_off(line[:at])
    if how in (None, "glued"):
        return None
    if re.fullmatch("l{1,2}", run):
        return Page("arabic", int("1" * len(run)), run, how, ocr=True), at
    if len(run) <= 4 and re.fullmatch("[lI|][lI|Oo]*", run) and re.search("[Oo]", run):
        return Page("arabic", int(_digits(run, SURE)), run, how, ocr=True), at
    value = roman_value(run)
    return (Page("roman", value, run, how), at) if value and value <= 200 else None


def _found(line: str) -> tuple[Page, int] | None:
    """The strongest page at the end of ``line`` and where the title ends."""
    if m := _BRACKET.search(line):
        value = int(m[1]) if m[1] else roman_value(m[2])
        if value and (m[1] or value <= 200):
            return Page("arabic" if m[1] else "roman", value, m[1] or m[2], "bracket"), m.start()
    if m := _PREFIXED.search(line):
        before = line[: m.start()]
        how = _set_off(before)
        if before.strip() and (how == "leader" or how == "space" and _gap(before) >= 2):
            return Page("prefixed", int(m[2]), m[0], how), m.start()
    if hit := _arabic(line) or _letters(line):
        return hit
    if (m := _LOOSE.search(line)) and line[: m.start()].strip():
        token = m[1]
        if re.search("[0-9]", token) and all(c.isdigit() or c in LOOSE for c in token) and int(_digits(token, LOOSE)):
            return Page("arabic", int(_digits(token, LOOSE)), token, "leader", ocr=True), m.start(1)
    if (m := _POINT.search(line)) and re.search(f"[{CJK}]", line) and int(m[1] + m[2]):
        return Page("arabic", int(m[1] + m[2]), m[0], "space", ocr=True), m.start()
    return None


def _belongs_to_title(page: Page, before: str, behind_ordinal: bool) -> bool:
    if _gap(before) >= 2 or page.separation in ("leader", "bracket", "alone") or page.style == "prefixed":
        return False
    words = before.split()
    if page.separation != "glued" and words and words[-1].lower() in NUMBERING_WORDS:
        return True
    if behind_ordinal:
        return True
    return page.style == "roman" and page.raw != page.raw.lower()


def gibberish_start(title: str) -> int | None:
    """Where a run of eight or more Latin letters begins that is glued to an ideograph and changes case at random (or has twenty)."""
    m = re.search(f"(?<=[{CJK}])[A-Za-z]{{8,}}$", title)
    if not m:
        return None
    flips = len(re.findall("(?=[a-z][A-Z])", m[0])) + len(re.findall("(?=[A-Z][a-z][A-Z])", m[0]))
    return m.start() if flips >= 3 or len(m[0]) >= 20 else None


def normal_title(title: str) -> str:
    """White space collapsed; two to eight single ideographs are one word; no blank behind an ideographic list mark or bracket."""
    words = title.split()
    if 2 <= len(words) <= 8 and all(re.fullmatch(f"[{CJK}]", w) for w in words):
        return "".join(words)
    return re.sub(f"(?<=[、）】〕：，]) (?=[{CJK}])", "", " ".join(words))


def _title_before(raw: str, plain: str, page: Page | None, page_word: bool) -> tuple[str, bool]:
    """(title, whether debris was taken off) of what stands before a page; ``raw`` and ``plain`` are the line and its half-width form up to it."""
    if page is None:
        if re.search(r"\S\s+0$", plain):
            raw = raw[: len(plain[:-1].rstrip())]
            plain = half_width(raw)
        keep = len(plain) if re.search(r"[^\W\d_]-$", plain) else len(plain.rstrip(LEADERS + " \t　"))
        return raw[:keep], False
    noise, size = False, len(plain)
    drop = LEADERS + BEFORE_PAGE + " \t　" + ("第" if page_word else "")
    while True:
        cut = len(plain[:size].rstrip(drop))
        head = plain[:cut]
        if re.search("[A-Za-z].*一$", head) and not re.search(f"[{CJK}]", head[:-1]):
            cut -= 1  # leaders misread as a numeral behind a Latin title
        elif re.search(f"[{CJK}]", head) and (m := re.search(r"(?<=[" + _L + r"])[A-Za-z]{1,2}$", head)):
            cut = m.start()  # or as letters behind an ideographic one
        if page.style == "arabic" and (m := re.search(r"((?:\s+[0-9OolI|]{1,3}){1,3})$", plain[:cut])) and plain[: m.start()].strip():
            again = _digits(re.sub(r"\s", "", m[1]), SURE)
            if str(page.value).startswith(again) and (again == str(page.value) or re.search("[OolI|]", m[1])):
                cut, noise = m.start(), True  # the page was read twice
        if (m := re.search(r"[" + _L + r"]{2,}\s*[0-9]{1,3}$", plain[:cut])) and re.search(r"[^\W\d_]", plain[: m.start()]):
            cut, noise = m.start(), True  # a short number between leaders and page
        if cut == size:
            return raw[:size], noise
        size = cut


def split_page(line: str) -> Split:
    """Title and page of one line."""
    whole = line.rstrip()
    plain = half_width(whole)
    # stray marks, and points behind a digit, up to six
    end, noise = len(plain), False
    for _ in range(6):
        head = plain[:end]
        if head and (head[-1] in NOISE or re.search(r"[0-9][.·•]$", head)):
            end, noise = len(head[:-1].rstrip()), True
        else:
            break
    page_word = bool(re.search("[0-9]页$", plain[:end]))
    body = plain[: end - page_word]
    hit = _found(body)
    if hit:
        page, at = hit
        if page.separation != "alone" and (m := _WORD_PAGE.search(body[:at].rstrip(" ."))):
            at = m.start()
            page = replace(page, separation="space" if page.separation == "glued" else page.separation)
        if _belongs_to_title(page, body[:at], body[:at].rstrip().endswith("第") and not page_word):
            hit = None
    if not hit:
        title, _ = _title_before(whole, plain, None, False)
        page, wide, noise = None, False, False
    else:
        title, debris = _title_before(whole[:at], body[:at], page, page_word)
        noise, wide = noise or debris, page.separation != "alone" and _gap(body[:at]) >= 2
    title = title.lstrip(BEFORE_TITLE + " \t　")
    cut = gibberish_start(title)
    if cut is not None:
        title = title[:cut].rstrip(LEADERS + " \t　")
    return Split(normal_title(title), page, noise, cut is not None, wide)


def lone_page(line: str) -> Page | None:
    """The page of a line that holds nothing else, decorated or not."""
    core = half_width(line).strip("-—–·•.*()[]【】~_|/ \t")
    if not core or len(core) > 6:
        return None
    if re.fullmatch("[0-9]+", core):
        return Page("arabic", int(core), core, "alone") if int(core) else None
    value = roman_value(core)
    return Page("roman", value, core, "alone") if value and value <= 200 else None


#: What ``split_page`` gives, as a column.
SPLIT_TYPE = "struct<title:string,page:struct<style:string,value:int,raw:string,separation:string,ocr:boolean,is_range:boolean>,noise:boolean,gibberish:boolean,wide:boolean>"


def split_column(line):
    """``split_page`` over a column, a batch of rows at a time."""
    @F.pandas_udf(SPLIT_TYPE)
    def run(lines: pd.Series) -> pd.DataFrame:
        rows = [asdict(split_page(x or "")) for x in lines]
        return pd.DataFrame(rows, columns=["title", "page", "noise", "gibberish", "wide"])

    return run(line)
