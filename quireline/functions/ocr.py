"""Page numbers in recognised text: bare tokens, ends of lines, folios, and titles settled between several readings.

The marks taken for leaders here are not those of the printed-text tokens: recognition gives other characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, replace

from quireline.functions.numerals import roman_value
from quireline.functions.tokens import CJK

#: Leaders, separators and stray closing marks in recognised lines.
LEADERS = ".·•…‥⋯-—–―‒_~～․‧∙・･⋅。．﹒－＿︙∶"
SEPARATORS, STRAY, DASHES = ",，:：;；'\"`‘’“”", ".,;:'\"`)]}|»›）】」』。，、’”", "-–—~～－‒"
#: Decoration around a number that stands alone, words and signs that make a number part of a heading, and strokes read for i.
DECORATION = "-—–―‒·•・.|[](){}（）〔〕<>《》【】〈〉~～*_－…⋯：:/"
CHAPTER_WORDS = set("chapter section part vol vol. volume lesson unit lecture § 第 figure fig. table appendix book no. article".split())
CHAPTER_SIGNS = "章节節篇部讲講课課卷回编編期年月日条項项图表号"
STROKES = {"1": "i", "l": "i", "I": "i", "|": "i", "!": "i", "f": "i", "j": "i", "í": "i", "ì": "i", "V": "v", "X": "x", "i": "i", "v": "v", "x": "x", "L": "l"}
_DIGITS = {0xFF10 + i: 0x30 + i for i in range(10)}
_NOISE = {"O": "0", "o": "0", "l": "1", "I": "1"}
_N = "[0-9OolI]{1,4}"


@dataclass(frozen=True)
class Number:
    """kind: arabic or roman; text: normalised; noisy: letters read as digits; upper: a capital Roman numeral."""

    value: int
    kind: str
    text: str
    noisy: bool = False
    upper: bool = False


def _plain(text: str) -> str:
    return "".join(_NOISE.get(c, c) for c in text)


def parse_token(token: str, *, noise_only: bool = False, upper_roman: bool = True) -> Number | None:
    """A bare token: up to four digits, a range that does not fall, or a Roman numeral to 40."""
    token = token.translate(_DIGITS)
    value = roman_value(token.lower()) if re.fullmatch("[ivxlcdmIVXLCDM]+", token) else None
    if value is not None and value <= 40:
        upper = token != token.lower()
        return None if upper and not upper_roman else Number(value, "roman", token.lower(), upper=upper)
    m = re.fullmatch(f"({_N})(?:[{re.escape(DASHES)}]({_N}))?", token)
    if not m or len(token) > 11:
        return None
    parts = [p for p in m.groups() if p]
    if not noise_only and not all(re.search("[0-9]", p) for p in parts):
        return None
    numbers = [int(_plain(p)) for p in parts]
    if numbers[0] < 1 or numbers[-1] < numbers[0]:
        return None
    return Number(numbers[0], "arabic", "-".join(map(str, numbers)), noisy=any(re.search("[A-Za-z]", p) for p in parts))


def strip_leaders(text: str) -> str:
    return text.rstrip(LEADERS + SEPARATORS + " \t　")


@dataclass(frozen=True)
class Trailing:
    title: str
    number: Number
    leader: bool
    abutting: bool


_TOKEN = re.compile(f"(?:[0-9０-９OolIivxcdmVXLCDM]|(?<=[0-9０-９])[{re.escape(DASHES)}](?=[0-9０-９]))+$")
_BETWEEN = f"[\\s{re.escape(SEPARATORS + LEADERS)}]"
_SPACED = re.compile(f"({_BETWEEN}+)([0-9０-９]{{1,2}}) ([0-9０-９]{{1,2}})$")


def _led(between: str) -> bool:
    """Whether there are leaders in it: two marks, or one of three points."""
    return sum(c in LEADERS for c in between) >= 2 or any(c in "…⋯‥" for c in between)


def split_trailing(line: str) -> Trailing | None:
    """Title and number at the end of a recognised line. Between them are leaders, white space or separators, or nothing where arabic digits follow
    an ideograph. Capital Roman numerals count behind leaders or alone; what ends a section's number or a word does not count."""
    if line.endswith("j"):
        # i behind leaders
        found = split_trailing(line[:-1] + "i")
        return replace(found, number=replace(found.number, noisy=True)) if found and found.leader and found.number.text == "i" else None
    body, strays = line.rstrip(), 0
    while body and body[-1] in STRAY and strays < 2:
        body, strays = body[:-1].rstrip(), strays + 1
    m = _TOKEN.search(body)
    if not m:
        return None
    token, before = m[0], body[: m.start()]
    if (wide := _SPACED.search(body)) and _led(wide[1]) and (number := parse_token(wide[2] + wide[3])) and number.kind == "arabic":
        return Trailing(body[: wide.start()].strip(), number, True, False)
    between = re.search(f"{_BETWEEN}*$", before)[0]
    title = before[: len(before) - len(between)]
    led, apart, alone = _led(between), any(c.isspace() or c in SEPARATORS for c in between), not title
    marks = sum(c in LEADERS for c in between)
    abutting = bool(title) and not between
    latin = bool(title) and re.match("[A-Za-z0-9０-９]", title[-1])
    if (latin and marks == 1 and not apart) or (abutting and (latin or not title[-1].isalpha())):
        return None
    number = parse_token(token, noise_only=led or (alone and not between and len(token) == 1 and token != "I"))
    if number is None:
        return None
    if number.kind == "roman" and (abutting or (number.upper and not (led or alone and not between)) or not (led or apart or alone and not between)):
        return None
    if number.noisy and not led and not (alone and not between) and not re.search("[0-9０-９]", token):
        return None
    return Trailing(title.strip(), number, led, abutting)


def folio(line: str) -> Number | None:
    """A number that stands alone, perhaps decorated (- 12 -, (iv), Page 12, 第12页); white space inside it does not matter."""
    core = re.sub("[页頁]$", "", re.sub(r"^(?:Page|PAGE|page|P\.|p\.|第)", "", line.strip()))
    return parse_token(re.sub(r"\s", "", core.strip(DECORATION + " \t\n\r\u3000")))


def _glued(word: str) -> list[int]:
    """Digits at either end of a word of ideographs."""
    digits = "([0-9０-９]{1,4})"
    back = re.search(f"[^\x00-\x7f第{CHAPTER_SIGNS}０-９]{digits}$", word)
    front = re.match(f"{digits}[^\x00-\x7f{CHAPTER_SIGNS}０-９]", word)
    return [int(m[1]) for m in (back, front) if m and int(m[1])]


def folio_candidates(line: str) -> list[tuple[int, bool]]:
    """(value, whether it is all of the line) of the arabic numbers at the ends of a running head that are no part of a heading's numbering."""
    alone = folio(line)
    if alone and alone.kind == "arabic":
        return [(alone.value, True)]
    words = line.split()
    if len(words) < 2:
        return [(v, False) for w in words for v in _glued(w)]
    plain = lambda w: (n := parse_token(w)) and n.kind == "arabic" and "-" not in n.text and n.value
    out = []
    if (value := plain(words[0])) and words[1][0] not in CHAPTER_SIGNS:
        out.append((value, False))
    if (value := plain(words[-1])) and words[-2].lower() not in CHAPTER_WORDS and not words[-2].endswith("第"):
        out.append((value, False))
    return out or [(v, False) for w in (words[-1], words[0]) for v in _glued(w)]


def roman_lookalike(text: str) -> Number | None:
    """A small Roman numeral to 40 whose thin strokes were read as other marks; leaders and decoration around it are left out."""
    core = re.sub(r"\s", "", text).strip(DECORATION + LEADERS)
    if not 0 < len(core) <= 7 or any(c not in STROKES for c in core):
        return None
    plain = "".join(STROKES[c] for c in core)
    value = roman_value(plain)
    return Number(value, "roman", plain, noisy=plain != core.lower()) if value and value <= 40 else None


def normalized(title: str) -> str:
    """NFKC, lower case, letters and digits only: what titles are compared by."""
    return "".join(c for c in unicodedata.normalize("NFKC", title).lower() if c.isalnum())


def settled_reading(readings: list[str]) -> tuple[str, int] | None:
    """(reading, votes): the first that two agree on, else the commonest, the earliest of ties."""
    counts: Counter[str] = Counter()
    for r in readings:
        counts[r] += 1
        if counts[r] == 2:
            return r, 2
    return max(counts.items(), key=lambda x: (x[1], -readings.index(x[0])), default=None)


def is_subsequence(short: str, long: str) -> bool:
    rest = iter(long)
    return all(c in rest for c in short)


def merged_title(title: str, others: list[str]) -> str:
    """Another reading of the title that only adds to it: up to three ideographs, or anything to an empty one. Two readings have to agree."""
    if not title:
        agreed = settled_reading([o for o in others if o])
        return agreed[0] if agreed and agreed[1] >= 2 else title
    fits = [o for o in others if o != title and is_subsequence(title, o) and 1 <= len(o) - len(title) <= 3 and all(re.match(f"[{CJK}]", c) for c in (Counter(o) - Counter(title)))]
    agreed = settled_reading(fits)
    return agreed[0] if agreed and agreed[1] >= 2 else title


def unstable(title: str, others: list[str]) -> bool:
    """Whether no other reading has the title's letters, trailing numbers aside."""
    letters = lambda t: re.sub("[0-9]+$", "", normalized(t))
    return bool(others) and all(letters(o) != letters(title) for o in others)


_ORDINAL = re.compile("(第[一二三四五六七八九十百千零〇两0-9０-９]+(?:部分|[章节節篇部讲講课課编編卷回]))[\\s.,，．、:：]*(?=.)", re.S)


def clean_title(title: str) -> str:
    """Without bullets and the specks in front, with 一 for a dash in front of 、, one blank behind 第X章, and no leaders at the end."""
    text = title.replace("•", " ")
    text = re.sub("^[-—–_‐―](?=、)", "一", text).lstrip(".．·•・。,，'`‘’_:;|¦ \t\n\r\x0b\x0c\u3000")
    if m := _ORDINAL.match(text):
        text = f"{m[1]} {text[m.end() :]}"
    return re.sub(" {2,}", " ", strip_leaders(text))


MISREAD_TAIL = re.compile("[0-9ivxlIVXL×|!Oo]{1,5}")


def drop_misread_tail(title: str, words: list[tuple[str, float]], column: float) -> tuple[str, str] | None:
    """(title, tail) without the last words that can only be a misread page number: up to five marks each, not all letters, and printed at
    ``column`` or right of it. ``words``: the line's words and where each begins."""
    rest, tail, left = title.strip(), [], list(words)
    while " " in rest and sum(map(len, tail)) < 6:
        head, _, last = rest.rpartition(" ")
        at = next((i for i in range(len(left) - 1, -1, -1) if left[i][0] == last), None)
        if not MISREAD_TAIL.fullmatch(last) or last.isalpha() or at is None or left[at][1] < column:
            break
        rest, tail, left = head.strip(), [last, *tail], left[:at]
    rest = strip_leaders(rest)
    return (rest, " ".join(tail)) if tail and rest else None


def trailing_digits(title: str) -> tuple[str, int | None]:
    """(title without it, number) of one to three digits that end a title as a group of their own, with blanks between them or not."""
    m = re.fullmatch(r"(.*?)((?: *[0-9]){1,3}) *", title)
    if not m or not m[1] or " " not in title[len(m[1]) :] or re.search(r"[\d.A-Za-z]$", m[1]):
        return title, None
    return m[1].strip(), int(m[2].replace(" ", ""))
