"""Tokens, headings and the parse of whole tables, on inputs of our own."""

import random

import pytest

from quireline.functions import headings as H
from quireline.functions import numerals as N
from quireline.functions import tokens as T
from quireline.operators import parse as P

TOKENS = [
    ("第一章 绪论……………… 1", "第一章 绪论", ("arabic", 1, "leader")),
    ("1.1 Scope ........ 12", "1.1 Scope", ("arabic", 12, "leader")),
    ("Preface ....... xii", "Preface", ("roman", 12, "leader")),
    ("Part 2", "Part 2", None),
    ("World War II", "World War II", None),
    ("附录 数据 (12)", "附录 数据", ("arabic", 12, "bracket")),
    ("Intro 12-15", "Intro", ("arabic", 12, "space")),
    ("Hello12", "Hello12", None),
    ("Solving the Problem\t7", "Solving the Problem", ("arabic", 7, "space")),
    ("Appendix ..... A-12", "Appendix", ("prefixed", 12, "leader")),
    ("foo .... 2S", "foo", ("arabic", 25, "leader")),
    ("前言 第3页", "前言", ("arabic", 3, "glued")),
    ("Alge-", "Alge-", None),
    ("１２", "", ("arabic", 12, "alone")),
]


@pytest.mark.parametrize(("line", "title", "page"), TOKENS)
def test_split_page(line, title, page):
    got = T.split_page(line)
    assert got.title == title
    assert (got.page and (got.page.style, got.page.value, got.page.separation)) == page


KINDS = {"第三章 方法": ("chapter", (3,)), "1.2.3 x": ("dotted", (1, 2, 3)), "1.5倍速": ("none", ()), "3 Results": ("arabic", (3,)), "(3) bar": ("arabic_paren", (3,)), "（二）则": ("cn_paren", (2,)), "一、引言": ("cn_enum", (1,)), "Appendix B Data": ("appendix", (2,)), "Chapter IV Foo": ("chapter", (4,)), "Part One": ("part", (1,)), "Contents": ("toc_heading", ()), "Preface": ("matter", ()), "本章小结": ("trailer", ()), "程序": ("none", ()), "Appendices": ("container", ())}


@pytest.mark.parametrize("title", KINDS)
def test_classify(title):
    got = H.classify(title)
    assert (got.kind, got.numbers) == KINDS[title]


def test_numerals():
    for n in range(1, 4000):
        assert N.roman_value(N.roman_string(n)) == n
    assert [N.roman_value(x) for x in ("IIII", "VX", "Iv", "", "Ⅳ")] == [None, None, None, None, 4]
    assert all(N.chinese_number(N.chinese_numeral(n)) == n for n in range(1, 100))
    assert [N.chinese_number(x) for x in ("一百零五", "一〇五", "十百", "百")] == [105, 105, None, 100]
    assert [N.any_number(x) for x in ("１２", "xii", "十二", "twenty-one", "tenth", "no")] == [12, 12, 12, 21, 10, None]


def parsed(text, **options):
    lines = [(i, line, None) for i, line in enumerate(text.split("\n"), 1)]
    return P.parse_lines(lines, P.Options(**options))


def test_plain_table():
    rows, warnings = parsed("Contents\nPreface ...... iii\nChapter 1 One ...... 1\n  1.1 First ...... 2\n  1.2 Second ...... 9\nChapter 2 Two ...... 15\nIndex ...... 99", offset=6)
    assert [(r.title, r.level, r.physical) for r in rows] == [("Preface", 0, None), ("Chapter 1 One", 0, 7), ("1.1 First", 1, 8), ("1.2 Second", 1, 15), ("Chapter 2 Two", 0, 21), ("Index", 0, 105)]
    assert [w[0] for w in warnings] == [1, 2]


def test_page_out_of_order_is_flagged():
    rows, warnings = parsed("1 A ...... 1\n2 B ...... 15\n3 C ...... 450\n4 D ...... 32\n5 E ...... 40")
    assert [r.conf < 0.5 for r in rows] == [False, False, True, False, False]
    assert "15" in warnings[0][1] and "32" in warnings[0][1]


def test_offsets():
    rows, _ = parsed("i Alpha ... i\nii Beta ... iii\nOne ...... 1", offset=6)
    assert [r.physical for r in rows] == [None, None, 7]
    rows, _ = parsed("Alpha ... i\nBeta ... iii\nOne ...... 1", offset=6, roman_offset=2)
    assert [r.physical for r in rows] == [3, 5, 7]
    rows, warnings = parsed("A one ...... 1\nB nine ...... 9", offset=-3)
    assert [r.physical for r in rows] == [None, 6] and warnings


def test_indentation_only():
    rows, _ = parsed("Alpha ...... 1\n    Beta ...... 2\n        Gamma ...... 3\n    Delta ...... 4\nOmega ...... 5\n    Sigma ...... 6\n        Tau ...... 7")
    assert [r.level for r in rows] == [0, 1, 2, 1, 0, 1, 2]
    lines = [(i, f"Entry {chr(65 + i)}x ...... {i + 1}", x) for i, x in enumerate([72.0, 90.4, 91.1, 108.2, 72.3, 90.0, 108.0])]
    rows, _ = P.parse_lines(lines, P.Options(indent_tolerance=4))
    assert [r.level for r in rows] == [0, 1, 1, 2, 0, 1, 2]


def test_wrapped_titles_and_lone_pages():
    rows, _ = parsed("1 A long title that ends with and\nthe rest of it ...... 3\n2 Another\n7\n3 Third ...... 9")
    assert [(r.title, r.page.value, r.lines) for r in rows] == [("1 A long title that ends with and the rest of it", 3, [1, 2]), ("2 Another", 7, [3, 4]), ("3 Third", 9, [5])]


def test_headers_figures_and_inherited_pages():
    rows, warnings = parsed("Running head\nPart I Start\nChapter 1 One ...... 3\nRunning head\nFigure 1.1 a ...... 4\nFigure 1.2 b ...... 5\nFigure 1.3 c ...... 6")
    assert [(r.title, r.page.value, r.inherited) for r in rows] == [("Part I Start", 3, True), ("Chapter 1 One", 3, False)]
    assert rows[0].conf <= 0.6 and len(warnings) == 3


def test_lost_ordinal():
    rows, _ = parsed("第一章 甲 ...... 1\n第章 乙 ...... 9\n第三章 丙 ...... 20")
    assert rows[1].title == "第二章 乙" and rows[1].notes


def test_longest_nondecreasing():
    assert len(P.kept_in_order([1, 5, 3, 7, 7, 2, 9])) == 5
    assert P.kept_in_order([]) == set()


POOL = ["第一章", "1.1", "Chapter", "2", "...", "……", "12", "iv", "附录", "A", "(3)", "一、", "and", "\t", "  ", "目录", "Index", "l2", "-", "第", "章", "图1", "注：", "①", "§", "99", "O", "的"]


def test_random_lines_keep_the_invariants():
    rng = random.Random(11)
    for _ in range(400):
        text = "\n".join(" ".join(rng.choice(POOL) for _ in range(rng.randrange(11))) for _ in range(rng.randrange(1, 15)))
        rows, _ = parsed(text, offset=rng.choice([-3, 0, 7]), page_count=rng.choice([None, 50]))
        last = -1
        for r in rows:
            assert 0 <= r.level <= last + 1 and 0 <= r.conf <= 1
            last = r.level


def test_six_thousand_entries():
    import time

    began = time.time()
    rows, _ = parsed("\n".join(f"{i // 20 + 1}.{i % 20 + 1} Entry {i}x ...... {i + 1}" for i in range(6000)))
    assert len(rows) == 6000 and time.time() - began < 10


def test_table_of_documents(spark):
    lines = [(d, i, t) for d in (1, 2) for i, t in enumerate(["Chapter 1 One ...... 1", "1.1 First ...... 2", None, "Chapter 2 Two ...... 9"])]
    got = P.printed_toc(spark.createDataFrame(lines, "doc_id long, line_no int, text string")).collect()
    assert sorted((r.doc_id, r.pos, r.level, r.printed_page) for r in got) == [(d, *x) for d in (1, 2) for x in ((0, 0, 1), (1, 1, 2), (2, 0, 9))]


def test_columns(spark):
    df = spark.createDataFrame([("1.1 Scope ...... 12",), (None,)], "line string")
    a, b = df.select(T.split_column("line").alias("s"), H.classify_column("line").alias("h")).collect()
    assert (a.s.title, a.s.page.value, a.h.kind, a.h.numbers) == ("1.1 Scope", 12, "dotted", [1, 1])
    assert (b.s.title, b.s.page, b.h.kind) == ("", None, "none")


def test_matter_that_chapters_end_with_is_theirs():
    lines = ["第一章 市场 …… 1", "第一节 需求 …… 2", "参考文献 …… 9", "第二章 生产 …… 10", "参考文献 …… 19", "第三章 分配 …… 20", "参考文献 …… 29", "附录 …… 30"]
    rows, _ = parsed("\n".join(lines))
    got = [(r.title, r.level) for r in rows]
    assert got == [("第一章 市场", 0), ("第一节 需求", 1), ("参考文献", 1), ("第二章 生产", 0), ("参考文献", 1), ("第三章 分配", 0), ("参考文献", 1), ("附录", 0)]
