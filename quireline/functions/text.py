"""Column functions on text lines; all native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line ends; CRLF is one.
LINE_END = r"\r\n|\r|\n"
#: Blocks of wide characters (ideographs, kana, hangul, full-width forms), as regular expression classes.
CJK = r"一-鿿㐀-䶿豈-﫿\x{20000}-\x{3134F}぀-ヿ가-힯々〇"
WIDE = CJK + r"ᄀ-ᅟ⺀-〾㄰-㆏︰-﹏！-｠￠-￦"
#: Characters of dot leaders and rules.
LEADERS = r".．·•…‥・∙⋯‧_\-—–─=~"


def lines(df: DataFrame, text: str, *, keep: tuple[str, ...]) -> DataFrame:
    """A row for each line, blank ones too: the columns ``keep``, ``line_no`` (from 1) and ``line``. A leading byte-order mark goes."""
    held = df.select(*keep, F.posexplode(F.split(F.regexp_replace(text, r"^\x{FEFF}", ""), LINE_END, -1)).alias("pos", "line"))
    return held.select(*keep, (F.col("pos") + 1).alias("line_no"), "line")


def entry_lines(df: DataFrame, line: str) -> DataFrame:
    """Without comments (# in front) and blank lines."""
    return df.filter(~F.col(line).startswith("#") & F.col(line).rlike(r"\S"))


def trailing_number(line: Column) -> Column:
    """The last 1 to 4 digits of a line, before trailing punctuation; empty if there are none."""
    return F.regexp_extract(line, r"([0-9]{1,4})[ .,;:]*$", 1)


_FULL = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
_HALF = "".join(chr(0x21 + i) for i in range(94)) + " "


def half_width(text: Column) -> Column:
    """Full-width forms as ASCII, the ideographic space as a blank; the length stays."""
    return F.translate(text, _FULL, _HALF)


def has_digit(text: Column) -> Column:
    return text.rlike("[0-9０-９]")


def has_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK}]")


def display_width(text: Column) -> Column:
    """Wide characters count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, f"[^{WIDE}]", ""))


def measure_indent(line: Column) -> Column:
    """Width of leading white space: tab 4, ideographic space 2, any other 1."""
    lead = F.regexp_extract(line, r"^[\s　]*", 0)
    return F.length(lead) + 3 * (F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit("")))) + (F.length(lead) - F.length(F.replace(lead, F.lit("　"), F.lit(""))))


def strip_trailing_leaders(text: Column) -> Column:
    return F.regexp_replace(text, f"[\\s　:：,，;；{LEADERS}]+$", "")


def one_line(text: Column) -> Column:
    """Runs of white space and control characters as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Cntrl}  \x85]+", " "))


def title_text(text: Column) -> Column:
    """White space collapsed; up to eight ideographs with blanks between them are one word; no blank behind an ideographic list mark."""
    plain = one_line(text)
    spaced = f"(?<=(?:^|[^{CJK}])[{CJK}]|^[{CJK}]) (?=[{CJK}](?:$| |[^{CJK}]))"
    return F.regexp_replace(F.regexp_replace(plain, spaced, ""), "(?<=[、，。：；]) ", "")


def parse_int(text: Column) -> Column:
    """Signed digits (full-width too) of at most nine characters, else null."""
    plain = F.trim(half_width(text))
    return F.when((F.length(plain) <= 9) & plain.rlike("^[+-]?[0-9]+$"), plain.try_cast("int"))


def numbered_title(line: Column) -> Column:
    """(title, page) of a line that ends with a signed number, bare behind white space or in brackets; page null otherwise."""
    plain = F.trim(half_width(line))
    bare, bracketed = r"^(.*\S)\s+([+-]?[0-9]{1,8})$", r"^(.*\S)\s*[(\[]\s*([+-]?[0-9]{1,8})\s*[)\]]$"
    shape = F.when(plain.rlike(bare), bare).when(plain.rlike(bracketed), bracketed)
    title = F.when(plain.rlike(bare), F.regexp_extract(plain, bare, 1)).when(plain.rlike(bracketed), F.regexp_extract(plain, bracketed, 1)).otherwise(plain)
    page = F.when(plain.rlike(bare), F.regexp_extract(plain, bare, 2)).when(plain.rlike(bracketed), F.regexp_extract(plain, bracketed, 2))
    return F.struct(title.alias("title"), page.try_cast("int").alias("page"), shape.isNotNull().alias("has_page"))


def is_index_line(line: Column) -> Column:
    """Ends with at least two comma-separated groups of page numbers, as index entries do."""
    return half_width(line).rlike(r"(?:^|[^0-9])[0-9]{1,4}(?:\s*[-–]\s*[0-9]{1,4})?(?:\s*[,，、]\s*[0-9]{1,4}(?:\s*[-–]\s*[0-9]{1,4})?)+[\s.]*$")


def is_figure_heading(line: Column) -> Column:
    return F.trim(line).rlike(r"^(?i:list of (?:figures|tables|illustrations)|figures|tables)$|^(?:图|表|插图|附图|附表|图表)\s*(?:目录|清单|索引|目次)$")


def is_figure_entry(line: Column) -> Column:
    return F.trim(half_width(line)).rlike(r"^(?i:fig(?:ure|\.)?|table|tab\.)\s*[0-9A-Z]+(?:[.\-][0-9]+)*|^(?:图|表)\s*[0-9A-Z]+(?:[.\-][0-9]+)*")


def utf16_hex(text: Column) -> Column:
    """PDF text string: hexadecimal UTF-16BE behind a byte-order mark."""
    return F.concat(F.lit("FEFF"), F.hex(F.encode(text, "UTF-16BE")))


def xml_escaped(text: Column) -> Column:
    out = text
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")


def page_spec(spec: Column, pages: Column) -> Column:
    """Distinct pages of a list like ``5-7,12-,-3`` in order, within 1 to ``pages``; full-width forms are fine, other shapes give null."""
    plain = F.translate(F.regexp_replace(half_width(spec), r"\s+", ""), "、，—–－〜～", ",,-----")
    parts = F.filter(F.split(plain, ","), lambda p: p != "")
    good = F.forall(parts, lambda p: p.rlike("^(?:[0-9]{1,9}|[0-9]{1,9}-|-[0-9]{1,9}|[0-9]{1,9}-[0-9]{1,9})$"))

    def numbers(p: Column) -> Column:
        low = F.when(p.startswith("-"), 1).otherwise(F.regexp_extract(p, "^([0-9]+)", 1).try_cast("int"))
        high = F.when(p.endswith("-"), pages).when(p.contains("-"), F.regexp_extract(p, "-([0-9]+)$", 1).try_cast("int")).otherwise(low)
        low, high = F.greatest(low, F.lit(1)), F.least(high, pages)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.when(good, F.array_distinct(F.flatten(F.transform(parts, numbers))))


def edit_limit(length: Column) -> Column:
    """Edits that a fuzzy match of this length may have: none up to three characters, else a fifth."""
    return F.when(length <= 3, 0).otherwise(F.floor(length * 0.2).cast("int"))


def fuzzy_equal(a: Column, b: Column) -> Column:
    """Edit distance within the limit of ``a``'s length; a length difference beyond it settles the matter first."""
    limit = edit_limit(F.length(a))
    return (F.abs(F.length(a) - F.length(b)) <= limit) & (F.levenshtein(a, b) <= limit)


def error_rate(got: Column, truth: Column) -> Column:
    """Edit distance by the truth's length, at most 1; 0 for two empty texts."""
    size = F.length(truth)
    return F.when(size == 0, F.when(F.length(got) == 0, 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), F.levenshtein(got, truth) / size))


def is_digit_slip(read: Column, expected: Column) -> Column:
    """Whether ``read`` is ``expected`` with one digit lost, or with another last digit (two digits at least)."""
    r, e = read.cast("string"), expected.cast("string")
    lost = F.exists(F.sequence(F.lit(1), F.length(e)), lambda i: F.concat(F.substring(e, F.lit(1), i - 1), F.substring(e, i + 1, F.length(e))) == r)
    last = (F.length(r) == F.length(e)) & (F.length(e) >= 2) & (F.substring(r, F.lit(1), F.length(r) - 1) == F.substring(e, F.lit(1), F.length(e) - 1))
    return (read != expected) & (((F.length(r) == F.length(e) - 1) & lost) | last)


#: Roman numerals from large to small.
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman_string(value: Column) -> Column:
    """Lower-case Roman numeral of 1 to 3999, else null."""
    parts = []
    for place, (one, five, ten) in ((1000, "m  "), (100, "cdm"), (10, "xlc"), (1, "ivx")):
        digit = (F.floor(value / place) % 10).cast("int")
        shapes = F.array(*(F.lit(s) for s in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)))
        parts.append(F.try_element_at(shapes, digit + 1))
    return F.when(value.between(1, 3999), F.concat(*parts))


def roman_value(text: Column) -> Column:
    """Value of a canonical Roman numeral in one case, else null. Letters are added up, each less twice itself if a larger one follows."""
    low = F.lower(text)
    shape = (text == low) | (text == F.upper(text))
    worth = F.transform(F.filter(F.split(low, ""), lambda c: c != ""), lambda c: F.when(c == "m", 1000).when(c == "d", 500).when(c == "c", 100).when(c == "l", 50).when(c == "x", 10).when(c == "v", 5).when(c == "i", 1).otherwise(0))
    total = F.aggregate(F.transform(worth, lambda v, i: F.when(v < F.coalesce(F.try_element_at(worth, i + 2), F.lit(0)), -v).otherwise(v)), F.lit(0), lambda a, v: a + v)
    return F.when(shape & low.rlike("^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$") & (F.length(low) > 0), total)


def repeated_lines(df, doc: str, line: str, number: str, *, least: int = 2):
    """Lines with text that occur at least ``least`` times in a document, such as running heads, with their count and first place."""
    return df.filter(F.trim(line) != "").groupBy(doc, line).agg(F.count("*").alias("n"), F.min(number).alias("first_line")).filter(F.col("n") >= least)


def title_confidence(title: Column) -> Column:
    """Confidence of a title by its looks: halved without letters, 0.6 of it for a single character."""
    return F.when(~title.rlike(r"\p{L}"), 0.5).otherwise(1.0) * F.when(F.length(title) == 1, 0.6).otherwise(1.0)
