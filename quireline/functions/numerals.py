"""Numbers written as words, Chinese or Roman numerals; plain Python, used inside vectorised functions."""

from __future__ import annotations

import re

#: Chinese digits and units, simplified, traditional and formal.
CHINESE_DIGITS = {
    "零": 0, "〇": 0, "○": 0, "Ｏ": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9,
    "壹": 1, "贰": 2, "貳": 2, "叁": 3, "參": 3, "肆": 4, "伍": 5, "陆": 6, "陸": 6, "柒": 7, "捌": 8, "玖": 9,
}
CHINESE_UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
#: Characters that can only be numerals; a full-width O may be a letter.
CHINESE = "".join(c for c in [*CHINESE_DIGITS, *CHINESE_UNITS] if c != "Ｏ")
#: English number words; ordinals go up to tenth.
ENGLISH = dict(zip("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(1, 20), strict=True))
ENGLISH_TENS = dict(zip("twenty thirty forty fifty".split(), range(20, 60, 10), strict=True))
ENGLISH_ORDINALS = dict(zip("first second third fourth fifth sixth seventh eighth ninth tenth".split(), range(1, 11), strict=True))
_ROMAN = re.compile("m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")
_WORTH = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
#: Single characters for Roman numerals (U+2160 on, U+2170 on).
_ROMAN_SIGNS = {0x2160 + shift + i: (s if not shift else s.lower()) for shift in (0, 16) for i, s in enumerate("I II III IV V VI VII VIII IX X XI XII L C D M".split())}


def half_width(text: str) -> str:
    """Full-width forms as ASCII, the ideographic space as a blank; the length stays."""
    return text.translate(_HALF)


_HALF = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20}


_RUN = f"[{''.join(CHINESE_DIGITS)}]*"
#: Thousands, hundreds, tens and ones; each of the first three with its unit.
_UNITS_FALL = re.compile(f"({_RUN}[千仟])?({_RUN}[百佰])?({_RUN}[十拾])?({_RUN})")


def chinese_number(text: str) -> int | None:
    """Digits in a row (一〇五), or digits with falling units (一百零五), where a bare unit counts once. Up to eight characters."""
    if not 0 < len(text) <= 8:
        return None
    if all(c in CHINESE_DIGITS for c in text):
        return int("".join(str(CHINESE_DIGITS[c]) for c in text))
    pieces = _UNITS_FALL.fullmatch(text)
    if not pieces:
        return None
    last = lambda run: CHINESE_DIGITS[run[-1]] if run else 0
    groups = zip((1000, 100, 10), (pieces[i] for i in (1, 2, 3)), strict=True)
    return sum(max(last(run[:-1]), 1) * unit for unit, run in groups if run) + last(pieces[4])


def chinese_numeral(value: int) -> str | None:
    """1 to 99."""
    if not 1 <= value <= 99:
        return None
    digits = "零一二三四五六七八九"
    tens, ones = divmod(value, 10)
    return ("" if tens == 0 else "十" if tens == 1 else digits[tens] + "十") + (digits[ones] if ones else "")


def roman_value(text: str) -> int | None:
    """Canonical numeral in one case, up to 15 letters."""
    text = text.translate(_ROMAN_SIGNS)
    low = text.lower()
    if not text or len(text) > 15 or text not in (low, text.upper()) or not _ROMAN.fullmatch(low):
        return None
    worth = [_WORTH[c] for c in low]
    return sum(-v if any(w > v for w in worth[i + 1 : i + 2]) else v for i, v in enumerate(worth))


def roman_string(value: int) -> str | None:
    if not 1 <= value <= 3999:
        return None
    out = ""
    for place, (one, five, ten) in ((1000, "m  "), (100, "cdm"), (10, "xlc"), (1, "ivx")):
        d = value // place % 10
        out += one + ten if d == 9 else one + five if d == 4 else (five if d > 4 else "") + one * (d % 5)
    return out


_ENGLISH = ENGLISH | ENGLISH_TENS | ENGLISH_ORDINALS
#: Two words with a hyphen, ones behind tens, as cardinal or ordinal.
_ENGLISH |= {f"{tens}-{ones}": ENGLISH_TENS[tens] + value for tens in ENGLISH_TENS for ones, value in _ENGLISH.items() if value < 10}


def english_number(text: str) -> int | None:
    return _ENGLISH.get(text.lower())


def any_number(text: str) -> int | None:
    """Arabic of up to six digits, Roman, Chinese or English, in this order."""
    plain = half_width(text)
    if re.fullmatch("[0-9]{1,6}", plain):
        return int(plain)
    return next((v for v in (read(text) for read in (roman_value, chinese_number, english_number)) if v is not None), None)
