"""Kind and numbers of the numbering in front of a heading.

Rules are tried in order: keywords, Chinese ordinals, English heading words, signs, dotted and plain numbers, Chinese lists. The word lists
below are fixed values; they decide which titles count as front and back matter, containers and exercises.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import functions as F

from quireline.functions.numerals import CHINESE, chinese_number, english_number, half_width, roman_value
from quireline.functions.tokens import CJK, LOOSE

#: Headings of tables of contents and what may follow them; lists of figures; column headers.
TOC = set("目录 目次 目錄 contents tableofcontents 简明目录 详细目录 总目录 目录页 briefcontents detailedcontents 日录 自录 目彔 日錄 tabledesmatières tabledesmatieres sommaire inhaltsverzeichnis inhalt índice indicegeneral contenido contenidos sumário sumario indice".split())
CONTINUED = "(续) (續) (续前) 续 (continued) continued (cont'd) (cont.) (cont) (contd)".split()
COLUMN_WORDS = set("chapter chapters page pages section title contents part no pg p".split())
COLUMN_CN = set("章节页码 章节页次 页码 页次 标题页码 内容页码".split())
CONTAINERS = set("附录 附錄 附录部分 appendices appendixes appendix".split())
#: Parts of a chapter that come behind its sections.
TRAILERS_CN = "本章 本节 本编 本篇 本部分 本讲 小结 习题 練習 练习 思考题 复习思考题 复习题 思考与练习 课后 阅读材料 延伸阅读 拓展阅读 扩展阅读 案例分析 真题 历年真题 典型例题 强化训练 知识框架 知识结构 学习目标 学习要点 章末 同步练习 自测题 综合练习 巩固练习".split()
TRAILERS_EN = set("summary chaptersummary exercises exercise problems questions reviewquestions discussionquestions keyterms keyconcepts furtherreading suggestedreading suggestedreadings bibliographicnotes casestudy selftest self-test chapterreview review practice quiz keypoints learningobjectives objectives practiceproblems programmingexercises projects chapterexercises summaryandexercises checkyourunderstanding wrap-up recap".split())
#: Front and back matter.
MATTER_CN = set("序 序言 自序 代序 原序 总序 前言 引言 导言 导论 绪论 緒論 绪言 楔子 引子 序章 序幕 尾声 终章 后记 後記 跋 结语 结束语 结论 结论与展望 总结 总结与展望 参考文献 参考书目 主要参考文献 参考资料 索引 名词索引 人名索引 主题索引 术语表 词汇表 注释 致谢 谢辞 鸣谢 摘要 中文摘要 英文摘要 内容提要 内容简介 出版说明 出版者的话 编者的话 编者按 写在前面 作者简介 作者介绍 译者简介 译后记 译者后记 译者序 符号说明 符号表 主要符号表 缩略语 缩略词表 图目录 表目录 插图目录 版权 封面 扉页 版权页 献词 题记 使用说明 阅读指南 本书导读 导读 封底 书名页 编委会 作者的话 再版说明 修订说明 总复习题 总习题".split())
MATTER_EN = set("preface foreword prologue epilogue afterword introduction contents acknowledgments acknowledgements acknowledgment acknowledgement dedication abstract bibliography references index glossary notes endnotes conclusion conclusions copyright colophon credits epigraph halftitle titlepage aboutthisbook abouttheauthor abouttheauthors abouttheeditors alsoby permissions nomenclature abbreviations sources cover subjectindex nameindex authorindex indexofnames selectedbibliography furtherresources illustrations maps timeline chronology praise frontispiece coda interlude postscript resume vita".split())
_MATTER_TAIL = re.compile("(?:版|者|本|文|总|再|新|译|自|作|原|代|的|书|丛|主编)(序|序言|前言|后记|跋)")
_MATTER_HEAD = re.compile("参考文献|攻读|致谢|索引|主要符号|作者简介")
_MATTER_FIRST = set("preface foreword prologue epilogue afterword acknowledgments acknowledgements bibliography glossary index".split())
_MATTER_TWO = {"about the", "list of", "index of", "notes on", "notes to", "introduction to", "praise for", "also by", "table of"}
#: Units behind 第N, longer ones first, and words that take a number.
UNITS = {u: k for k, own in (("subpart", "分编 分册 分卷 分篇"), ("part", "部分 单元 模块 专题 單元 篇 编 卷 部 册 集 幕 季 辑 編"), ("chapter", "讲座 章 回 讲 课 场 講 課"), ("section", "节 節")) for u in own.split()}
NUMBERED_CN = {"考点": "section", "知识点": "section", "题型": "section", "专题": "chapter", "单元": "part", "模块": "part", "项目": "chapter", "任务": "section", "实验": "chapter"}
WORDS = {w: k for k, own in (("chapter", "chapter chap ch lecture lesson scene chapitre kapitel capítulo capitulo capitolo"), ("part", "part book volume vol unit module act partie teil parte"), ("section", "section sec"), ("appendix", "appendix annex annexe anhang")) for w in own.split()}
MARKERS = "*※△▲☆★▪■□◆◇●○►▶"
NUMBERED = frozenset("part subpart chapter section appendix dotted arabic cn_enum cn_paren arabic_paren".split())


@dataclass(frozen=True)
class Heading:
    kind: str = "none"
    numbers: tuple[int, ...] = ()
    keyword: str = ""
    ocr: bool = False
    circled: bool = False


NONE = Heading()
_N = f"[{CHINESE}]"
_READ = re.compile(f"({_N}{{1,8}})|([0-9OolI]{{1,5}})|([ivxlcdmIVXLCDMⅠ-ⅿ]{{1,8}})(?![A-Za-z])")


def _number(text: str) -> tuple[int, int, bool] | None:
    """(value, length, repaired) of the number that ``text`` begins with."""
    m = _READ.match(text)
    if not m:
        return None
    if m[1]:
        value = chinese_number(m[1])
        return None if value is None else (value, m.end(), False)
    if m[2] and re.search("[0-9]", m[2]):
        plain = "".join({"O": "0", "o": "0", "l": "1", "I": "1"}.get(c, c) for c in m[2])
        return int(plain), m.end(), plain != m[2]
    roman = re.match("[ivxlcdmIVXLCDMⅠ-ⅿ]{1,8}(?![A-Za-z])", text)
    value = roman and roman_value(roman[0])
    return (value, roman.end(), False) if value else None


def _key(text: str) -> str:
    return re.sub(r"\s", "", text).lower().rstrip(":：.。-—·")


def _keyword(text: str) -> Heading | None:
    key = _key(text)
    cjk = bool(re.search(f"[{CJK}]", text))
    if not key:
        return None
    for tail in ("", *CONTINUED):
        if key.endswith(tail) and key.removesuffix(tail) in TOC:
            return Heading("toc_heading", keyword=key.removesuffix(tail))
    if key in CONTAINERS:
        return Heading("container", keyword=key)
    if key in COLUMN_CN:
        return Heading("toc_heading", keyword=key)
    words = re.findall(r"[^\W\d_]+", text.lower())
    if cjk:
        latin, han = "".join(re.findall("[a-z]", text.lower())), "".join(re.findall(f"[{CJK}]", text))
        if latin and re.fullmatch(f"[{CJK}\\sA-Za-z&/·:：—-]+", text):
            if han in TOC and latin in TOC:
                return Heading("toc_heading", keyword=han)
            if han in MATTER_CN and latin in MATTER_EN:
                return Heading("matter", keyword=han)
        for p in TRAILERS_CN:
            if key.startswith(p) and len(key) <= len(p) + 14:
                return Heading("trailer", tuple(map(int, re.findall("[0-9]+", key[len(p) :]))), p)
        if key in MATTER_CN:
            return Heading("matter", keyword=key)
        if len(key) <= 10 and (m := re.search(_MATTER_TAIL.pattern + "$", key)):
            return Heading("matter", keyword=m[1])
        if m := _MATTER_HEAD.match(key):
            return Heading("matter", keyword=m[0])
        if "声明" in key and len(key) <= 16 and re.search("原创|独创|授权", key):
            return Heading("matter", keyword="声明")
        return None
    if 2 <= len(words) <= 4 and set(words) <= COLUMN_WORDS and not re.search("[0-9]", text) and {"page", "pages", "pg"} & set(words) and {"chapter", "chapters", "section", "contents", "part", "no"} & set(words):
        return Heading("toc_heading", keyword="column header")
    if not text[0].isalpha():
        return None
    letters = re.sub(r"[^\w-]|_", "", key)
    if letters in TRAILERS_EN:
        return Heading("trailer", keyword=letters)
    if letters in MATTER_EN:
        return Heading("matter", keyword=letters)
    first, two = words[0] if words else "", " ".join(words[:2])
    if len(words) <= 8 and first in _MATTER_FIRST:
        return Heading("matter", keyword=first)
    if len(words) <= 8 and two in _MATTER_TWO:
        return Heading("matter", keyword=two)
    if len(words) <= 4 and first in ("summary", "exercises", "problems"):
        return Heading("trailer", keyword=first)
    return None


_UNIT = re.compile("|".join(sorted(UNITS, key=len, reverse=True)))


def _chinese_ordinal(text: str) -> Heading | None:
    if text.startswith("第"):
        rest = text[1:].lstrip()
        if found := _number(rest):
            unit = _UNIT.match(rest[found[1] :].lstrip())
            return Heading(UNITS[unit[0]], (found[0],), ocr=found[2]) if unit else None
        # the numeral is lost
        lost = re.match(f"[^{CJK}A-Za-z]{{0,2}}(部分|章|节|篇|编)", text[1:])
        return Heading(UNITS[lost[1]], ocr=True) if lost else None
    if m := re.match("([上中下])[篇编卷册部]", text):
        return Heading("part", ("上中下".index(m[1]) + 1,))
    if m := re.match(r"附\s?[录錄]\s*", text):
        rest = text[m.end() :]
        if letter := re.match("([A-Z])(?![A-Za-z])", rest):
            return Heading("appendix", (ord(letter[1]) - 64,))
        found = _number(rest)
        return Heading("appendix", (found[0],) if found else (), ocr=bool(found and found[2]))
    for word, kind in NUMBERED_CN.items():
        if text.startswith(word):
            rest = text[len(word) :].lstrip()
            found = _number(rest)
            if found and not re.match("[A-Za-z]", rest[found[1] :]):
                return Heading(kind, (found[0],), ocr=found[2])
    return None


def _heading_word(text: str) -> Heading | None:
    m = re.match(r"([^\W\d_]+)(\.?)(\s*)(.*)", text, re.S)
    kind = m and WORDS.get(m[1].lower())
    if not kind or not m[4] or (not m[3] and re.match("[A-Za-z]", m[4])):
        return None
    rest = m[4]
    letter = re.match("([A-Z])(?![A-Za-z])", rest)
    if kind == "appendix" and letter:
        return Heading(kind, (ord(letter[1]) - 64,))
    if d := re.match(r"[0-9]{1,4}(?:\.[0-9]{1,4})*", rest):
        if re.match("[A-Za-z0-9]", rest[d.end() :]):
            return None
        numbers = tuple(map(int, d[0].split(".")))
        return Heading("dotted" if len(numbers) > 1 else kind, numbers)
    token = re.match("[A-Za-z-]*", rest)[0]
    value = roman_value(token) or english_number(token)
    if value:
        return Heading(kind, (value,))
    if len(token) == 1 and kind in ("chapter", "section") and token in LOOSE:
        return Heading(kind, (int(LOOSE[token]),), ocr=True)
    if letter and len(token) == 1 and kind in ("part", "section"):
        return Heading(kind, (ord(token) - 64,))
    return None


_SEPARATOR = "[.:。·,\\-–_．•]"
_DOTTED = re.compile(f"(?:([A-Z])(?=\\.[0-9])|[0-9lIOo]{{1,3}}(?![A-Za-z0-9]))(?:{_SEPARATOR}(?:[0-9]{{1,3}}|[lI](?![A-Za-z]))(?![0-9])){{0,6}}")


def dotted(text: str) -> tuple[tuple[int, ...], int, bool, bool] | None:
    """(numbers, length, repaired, begins with a letter) of a dotted number, or of a single one."""
    m = _DOTTED.match(text)
    if not m or not re.search("[0-9]", m[0]):
        return None
    parts = re.split(_SEPARATOR, m[0])
    plain = ["".join({"l": "1", "I": "1", "O": "0", "o": "0"}.get(c, c) for c in p) for p in parts]
    if m[1]:
        plain[0] = str(ord(m[1]) - 64)
    fixed = plain[bool(m[1]) :] != parts[bool(m[1]) :]
    return tuple(map(int, plain)), m.end(), fixed, bool(m[1])


_SIGNS = ((0x2460, 20, "arabic_paren", True), (0x2474, 20, "arabic_paren", False), (0x2488, 20, "arabic", False), (0x3220, 10, "cn_paren", False))


def _sign(text: str) -> Heading | None:
    if text[0] == "§":
        found = dotted(text[1:].lstrip())
        return Heading("dotted" if len(found[0]) > 1 else "section", found[0], ocr=found[2]) if found else None
    for base, count, kind, circled in _SIGNS:
        if base <= ord(text[0]) < base + count:
            return Heading(kind, (ord(text[0]) - base + 1,), circled=circled)
    m = re.match(rf"[(\[〔【<]\s*(?:({_N}{{1,6}})|([0-9]{{1,3}}))\s*[)\]〕】>]", text)
    if not m:
        return None
    value = chinese_number(m[1]) if m[1] else int(m[2])
    return None if value is None else Heading("cn_paren" if m[1] else "arabic_paren", (value,))


def _plain_number(text: str) -> Heading | None:
    found = dotted(text)
    if not found:
        return None
    numbers, end, fixed, letter = found
    rest = text[end:]
    if len(numbers) > 1:
        rest = rest[1:] if rest[:1] in (".", "、") else rest
        if rest[:1] and (rest[0] in "%％年月日时岁寸倍万亿千百兆元" or (len(numbers) == 2 and not letter and rest[0] == ")")):
            return None  # a quantity
        return Heading("dotted", numbers, ocr=fixed)
    if letter or numbers[0] > 999 or not rest:
        return None
    if rest[0] in ")）":
        return Heading("arabic_paren", numbers, ocr=fixed)
    if re.match(r"[.、．:,，]\s*[^\s0-9]", rest):
        return Heading("arabic", numbers, ocr=fixed)
    if re.match(r"\s+[^\s0-9年月日%个种项]", rest) and numbers[0] <= 199:
        return Heading("arabic", numbers, ocr=fixed)
    return None


def _chinese_list(text: str) -> Heading | None:
    m = re.match(rf"({_N}{{1,6}})(\s*)(.)", text)
    value = m and chinese_number(m[1])
    if value is None or m is None:
        return None
    listed = m[3] in "、.,，:：·" or (m[2] and len(m[1]) <= 3 and not m[3].isdigit())
    return Heading("cn_enum", (value,)) if listed else None


def classify(title: str) -> Heading:
    text = half_width(title).lstrip(MARKERS + " \t").strip()
    if not text:
        return NONE
    for rule in (_keyword, _chinese_ordinal, _heading_word, _sign, _plain_number, _chinese_list):
        if (found := rule(text)) is not None:
            return found
    return NONE


def rank(heading: Heading, arabic_heads_dotted: bool = False) -> float | None:
    """Order of depth; none for headings without numbering."""
    if heading.kind == "dotted":
        return 2.0 + min(len(heading.numbers), 5)
    if heading.kind == "arabic":
        return 1.0 if arabic_heads_dotted else 10.0
    if heading.kind == "arabic_paren":
        return 12.0 if heading.circled else 11.0
    return {"part": 0.0, "appendix": 0.0, "subpart": 0.5, "chapter": 1.0, "section": 2.0, "cn_enum": 8.0, "cn_paren": 9.0}.get(heading.kind)


def space_after_numbering(title: str) -> str:
    """A blank between a dotted number and the title glued to it."""
    lead = re.match("[" + re.escape(MARKERS) + r"\s]*", title)[0]
    found = dotted(half_width(title[len(lead) :]))
    if not found or len(found[0]) < 2:
        return title
    end = len(lead) + found[1]
    return title[:end] + " " + title[end:] if end < len(title) and title[end].isalpha() else title


def repair(title: str) -> tuple[str, str] | None:
    """(title, note) with slips in the numbering put right, or None."""
    notes, lead = [], re.match("[" + re.escape(MARKERS) + r"\s]*", title)[0]
    body = title[len(lead) :]
    found = dotted(half_width(body))
    if found and len(found[0]) > 1 and not found[3]:
        span, plain = body[: found[1]], ".".join(map(str, found[0]))
        if "." in half_width(span) and re.search("[:。,·•]", span):
            body = plain + body[found[1] :]
            notes.append(f"numbering '{span}' read as {plain}")
            found = (found[0], len(plain), *found[2:])
        if re.match(f"[.．][{CJK}]", body[found[1] :]):
            body = body[: found[1]] + " " + body[found[1] + 1 :]
            notes.append("dot after the numbering read as a space")
    m = re.match(r"([A-Za-z]+)( +)([IiLl1|VvXx]{1,6})(?= |$)", body)
    if m and WORDS.get(m[1].lower()) in ("part", "chapter", "section") and roman_value(m[3]) is None and re.search("[IVX]", m[3]):
        mapped = re.sub("[iLl1|]", "I", m[3]).upper()
        if roman_value(mapped):
            body = body[: m.start(3)] + mapped + body[m.end(3) :]
            notes.append(f"roman numeral '{m[3]}' read as {mapped}")
    m = re.match(r"(\S{1,12}) +([⋅·•∙・‧･]+)(?=[^\W\d_])", body)
    if m and (classify(m[1]).kind != "none" or classify(body).kind != "none"):
        body = body[: m.start(2)] + body[m.end(2) :]
        notes.append("stray dot after the numbering removed")
    return (lead + body, "; ".join(notes)) if notes else None


def insert_ordinal(title: str, numeral: str) -> str | None:
    """第章 with its lost numeral put back."""
    m = re.match(f"([{re.escape(MARKERS)}\\s]*)第[^{CJK}A-Za-z]{{0,2}}(部分|章|节|篇|编)(.*)", title, re.S)
    if not m:
        return None
    tail = " " + m[3] if m[3] and not m[3][0].isspace() else m[3]
    return f"{m[1]}第{numeral}{m[2]}{tail}"


HEADING_TYPE = "struct<kind:string,numbers:array<int>,keyword:string,ocr:boolean,circled:boolean>"


def classify_column(title):
    @F.pandas_udf(HEADING_TYPE)
    def run(titles: pd.Series) -> pd.DataFrame:
        rows = [asdict(classify(x or "")) for x in titles]
        return pd.DataFrame([r | {"numbers": list(r["numbers"])} for r in rows], columns=["kind", "numbers", "keyword", "ocr", "circled"])

    return run(title)
