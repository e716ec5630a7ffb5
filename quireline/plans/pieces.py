"""Queries of single functions: each row of a table gets one of the listed inputs, and SQL looks up the answer or works it out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quireline.functions import numerals, ocr, text as T, tokens
from quireline.operators import layout, matching, parse, policy, verify
from quireline.plans import recognised
from quireline.plans.documents import _DRAFTS, _toc_lines, draft_issues
from quireline.plans.recognised import _made, _oracle, _read, _table

CLEANED = [("•三、供给", "三、供给"), ("． 第二节 •供给分析", "第二节 供给分析"), ("第二节，价格", "第二节 价格"), ("第二节.模型", "第二节 模型"), ("第十一部分 总结", "第十一部分 总结"), ("让·罗尔斯", "让·罗尔斯"), ("-、供给 ...", "一、供给"), ("第#章供给", "第#章 供给"), ("Supply #", "Supply #")]
DIGIT_TAILS = [("供给 #", "供给", "#"), ("供给 2 0", "供给", "20"), ("Section 3.#", "Section 3.#", ""), ("Chapter #", "Chapter #", ""), ("附录#", "附录#", ""), ("供给 1234", "供给 1234", "")]
STROKES = [("... 11l", "3"), (".. ifi", "3"), ("x!i", "12"), ("IV", "4"), ("v|i", "7"), ("12", ""), ("供给", ""), ("xlviii", ""), ("xLi", "")]
LONE = [("#", "#"), ("— # —", "#"), ("· # ·", "#"), ("第 # 页", "#"), ("Page #", "#"), ("p. #", "#"), ("(xiv)", "14"), ("第#章", ""), ("# 供给", ""), ("1 2", "12")]
PAGES_ALONE = [("#", "#"), ("- # -", "#"), ("· # ·", "#"), ("— # —", "#"), ("xiv", "14"), ("Chapter #", ""), ("第#章", ""), ("1234567", "")]
#: Line, and whether it looks cut off, begins a footnote, is a figure's entry, heads a list of figures, is a line of an index.
SHAPES = [("The supply of and", "10000"), ("供给（需求", "10000"), ("关于供给的第#", "10000"), ("① 本表的数据来自当年的统计公报和年鉴", "01000"), ("Figure #. Supply", "00100"), ("图 # 供给", "00100"), ("List of Figures", "00010"), ("图表目录", "00010"), ("supply, price of, 12, 15-17, #", "00001"), ("供给 #", "00000"), ("Supply and demand", "00000")]
WARNINGS = [("cannot read /tmp/a/b.pdf at 120", "cannot read <path> at <n>"), ("object 12 0 R is lost at offset 99", "object <ref> R is lost at offset <n>"), ("no outline", "no outline")]
INTEGERS = [("#", "#"), (" # ", "#"), ("１２", "12"), ("-#", "-#"), ("+7", "7"), ("12a", ""), ("", ""), ("1234567890", "")]


def _answer(value) -> str:
    return "" if value is None else str(value)


def chinese_numerals(spark, sf_dir):
    """1 to 99 in Chinese numerals, and back."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 99 + 1).cast("string").alias("line"))
    return _read(orders, "numeral string, value string", lambda n: (numerals.chinese_numeral(int(n)), str(numerals.chinese_number(numerals.chinese_numeral(int(n))))))


def title_cleanup(spark, sf_dir):
    return _read(_made(spark, sf_dir, CLEANED), "title string", lambda line: (ocr.clean_title(line),))


def title_digits(spark, sf_dir):
    def one(line):
        title, digits = ocr.trailing_digits(line)
        return title, _answer(digits)

    return _read(_made(spark, sf_dir, DIGIT_TAILS), "title string, digits string", one)


def roman_strokes(spark, sf_dir):
    return _read(_made(spark, sf_dir, STROKES), "value string", lambda line: ((n := ocr.roman_lookalike(line)) and str(n.value) or "",))


def lone_numbers(spark, sf_dir):
    return _read(_made(spark, sf_dir, LONE), "value string", lambda line: ((n := ocr.folio(line)) and str(n.value) or "",))


def lone_pages(spark, sf_dir):
    return _read(_made(spark, sf_dir, PAGES_ALONE), "value string", lambda line: ((p := tokens.lone_page(line)) and str(p.value) or "",))


def line_shapes(spark, sf_dir):
    tests = (parse.looks_cut_off, parse.footnote_start, parse.is_figure_entry, parse.is_figure_heading, parse.is_index_line)
    return _read(_made(spark, sf_dir, SHAPES), "flags string", lambda line: ("".join(str(int(t(line))) for t in tests),))


def settled_readings(spark, sf_dir):
    """Three readings of a line: the first that two agree on, else the first."""
    key = F.col("o_orderkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("|", key % 3, F.floor(key / 3) % 3, F.floor(key / 9) % 3).alias("line"))
    return _read(orders, "reading string, votes string", lambda line: tuple(map(str, ocr.settled_reading(line.split("|")))))


def warning_texts(spark, sf_dir):
    return _made(spark, sf_dir, WARNINGS).select("o_orderkey", verify.normal_warning(F.col("line")).alias("warning"))


def signed_integers(spark, sf_dir):
    return _made(spark, sf_dir, INTEGERS).select("o_orderkey", F.coalesce(T.parse_int(F.col("line")).cast("string"), F.lit("")).alias("value"))


def utf16_titles(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", T.utf16_hex(F.col("p_name")).alias("hex"))


def kept_prefixes(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").cast("binary").alias("before"), F.concat(F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(""), F.col("p_name"), F.lit(" more")).cast("binary").alias("after"))
    return parts.select("p_partkey", verify.keeps_prefix(F.col("before"), F.col("after")).alias("kept"))


def pdf_filters(spark, sf_dir):
    """Each turn's text through the encodings of PDF streams and back."""
    from quireline.sources.pdf import filters

    def packed(data: bytes) -> list[bytes]:
        """The text by each filter, encoded."""
        import base64
        import zlib

        codes = [c for low in range(0, len(data), 200) for c in (256, *data[low : low + 200])] + [257]
        bits = "".join(f"{c:09b}" for c in codes)
        lzw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
        runs = b"".join(bytes([len(p) - 1]) + p for p in (data[i : i + 128] for i in range(0, len(data), 128))) + b"\x80"
        ups = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True)) for row, above in zip(*(lambda r: (r, [bytes(16), *r[:-1]]))([data[i : i + 16].ljust(16, b"\0") for i in range(0, len(data), 16)]), strict=True))
        raw = zlib.compressobj(wbits=-15)
        return [zlib.compress(data), raw.compress(data) + raw.flush(), lzw, runs, data.hex().encode() + b">", base64.a85encode(data) + b"~>", ups]

    readers = (filters.flate, filters.flate, filters.lzw, filters.run_length, filters.ascii_hex, filters.ascii_85, lambda d: filters.unpredicted(d, 12, 16))

    @F.pandas_udf("string")
    def through(texts: pd.Series) -> pd.Series:
        import hashlib

        def one(text: str) -> str:
            data = text.encode("utf-8")
            return ",".join(hashlib.md5(read(code)[: len(data)]).hexdigest() for read, code in zip(readers, packed(data), strict=True))

        return texts.map(one)

    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", through(F.coalesce("text", F.lit(""))).alias("digests"))


def mapped_pages(spark, sf_dir):
    """Physical pages of the made-up contents, 6 behind the printed ones and 2 in front matter; those beyond page 150 are left out."""
    found = parse.printed_toc(_toc_lines(spark, sf_dir), "doc_id", line_no="line_no", text="text", options=parse.Options(offset=6, roman_offset=2, page_count=150))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("physical_page").cast("long").alias("physical_page"))


def draft_counts(spark, sf_dir):
    held = draft_issues(spark, sf_dir).withColumn("issues", F.split("issues", ","))
    return policy.write_readiness(held, "conv_id")


def _leaning(spark, sf_dir):
    """Line items as boxes that lean."""
    items = _table(spark, sf_dir, "lineitem")
    q, n = F.floor("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    return items.select("l_orderkey", "l_linenumber", "l_partkey", n.alias("min_x"), q.alias("min_y"), (n + q * 3).alias("max_x"), (q + 10).alias("max_y"), ((F.floor("l_extendedprice") % 400 - 200) / 100).alias("angle"))


def upright_boxes(spark, sf_dir):
    return layout.upright(_leaning(spark, sf_dir)).groupBy("l_orderkey").agg(F.count("*").alias("n"))


def turned_share(spark, sf_dir):
    return layout.misoriented_share(_leaning(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", F.round("misoriented", 6).alias("misoriented"))


def page_skew(spark, sf_dir):
    boxes = _leaning(spark, sf_dir).withColumn("angle", F.col("angle") / 20)
    return layout.estimate_skew(boxes, ["l_orderkey"]).select("l_orderkey", F.round("skew", 6).alias("skew"))


def deskewed_boxes(spark, sf_dir):
    made = layout.deskew(_leaning(spark, sf_dir).filter("l_linenumber = 1"), F.lit(0.05), F.lit(50.0), F.lit(40.0))
    return made.select("l_orderkey", "l_partkey", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))


def chapter_shift(spark, sf_dir):
    """The shift that most chapters' pages agree on."""
    found = recognised.chapter_pages(spark, sf_dir).withColumn("pages", F.when(F.col("pages") == "", F.array().cast("array<bigint>")).otherwise(F.split("pages", ",").cast("array<bigint>")))
    return matching.shift_vote(found, "user_id", "expected").select("user_id", F.col("shift").cast("long").alias("shift"), "n")


_QUERIES = (chinese_numerals, title_cleanup, title_digits, roman_strokes, lone_numbers, lone_pages, line_shapes, settled_readings, warning_texts, signed_integers, utf16_titles, kept_prefixes, pdf_filters, mapped_pages, draft_counts, upright_boxes, turned_share, page_skew, deskewed_boxes, chapter_shift)
QUERIES = {f.__name__: f for f in _QUERIES}

_LEAN = "b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber::DOUBLE AS min_x, floor(l_quantity) AS min_y, l_linenumber + floor(l_quantity) * 3 AS max_x, floor(l_quantity) + 10 AS max_y, (floor(l_extendedprice) % 400 - 200) / 100 AS angle FROM lineitem)"
_TURNED = "50 + (x - 50) * cos(-0.05::DOUBLE) - (y - 40) * sin(-0.05::DOUBLE)", "40 + (x - 50) * sin(-0.05::DOUBLE) + (y - 40) * cos(-0.05::DOUBLE)"

ORACLES = {
    "chinese_numerals": "SELECT o_orderkey, CASE WHEN n < 10 THEN '' WHEN n < 20 THEN '十' ELSE ['', '二', '三', '四', '五', '六', '七', '八', '九'][n // 10] || '十' END || ['', '一', '二', '三', '四', '五', '六', '七', '八', '九'][n % 10 + 1] AS numeral, n::VARCHAR AS value FROM (SELECT o_orderkey, o_orderkey % 99 + 1 AS n FROM orders)",
    "title_cleanup": _oracle(CLEANED, ("title",)),
    "title_digits": _oracle(DIGIT_TAILS, ("title", "digits")),
    "roman_strokes": _oracle(STROKES, ("value",)),
    "lone_numbers": _oracle(LONE, ("value",)),
    "lone_pages": _oracle(PAGES_ALONE, ("value",)),
    "line_shapes": _oracle(SHAPES, ("flags",)),
    "settled_readings": "SELECT o_orderkey, CASE WHEN b = c AND a <> b THEN b ELSE a END::VARCHAR AS reading, CASE WHEN a = b OR a = c OR b = c THEN '2' ELSE '1' END AS votes FROM (SELECT o_orderkey, o_orderkey % 3 AS a, o_orderkey // 3 % 3 AS b, o_orderkey // 9 % 3 AS c FROM orders)",
    "warning_texts": _oracle(WARNINGS, ("warning",)),
    "signed_integers": _oracle(INTEGERS, ("value",)),
    "utf16_titles": "SELECT p_partkey, 'FEFF' || array_to_string(list_transform(string_split(p_name, ''), lambda c: '00' || hex(c)), '') AS hex FROM part",
    "kept_prefixes": "SELECT p_partkey, p_partkey % 3 <> 0 AS kept FROM part",
    "pdf_filters": "SELECT conv_id, turn, array_to_string([d, d, d, d, d, d, d], ',') AS digests FROM (SELECT conv_id, turn, md5(coalesce(text, '')) AS d FROM conversations)",
    "mapped_pages": """WITH o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT doc_id, n AS pos, CASE WHEN n * 7 + 6 <= 150 THEN n * 7 + 6 END AS physical_page FROM o UNION ALL SELECT DISTINCT doc_id, 0, 6 FROM o""",
    "draft_counts": f"""WITH {_DRAFTS}, p AS (SELECT conv_id, pos, CASE WHEN pos % 5 = 4 THEN NULL WHEN pos % 3 = 2 THEN page - 5 ELSE page END AS page FROM drafts),
b AS (SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
s AS (SELECT conv_id, page IS NULL OR page < 1 OR page > 16 AS wrong, coalesce(page < before, false) AS falls, pos % 7 = 2 AS sure FROM b)
SELECT conv_id, count(*) FILTER (wrong) AS blockers, count(*) FILTER (NOT wrong AND falls AND NOT sure) AS unconfirmed, count(*) FILTER (falls) AS order_warnings, count(*) FILTER (wrong) = 0 AS ready FROM s GROUP BY 1""",
    "upright_boxes": f"WITH {_LEAN} SELECT l_orderkey, count(*) AS n FROM b WHERE abs(angle) <= pi() / 3 GROUP BY 1",
    "turned_share": f"WITH {_LEAN} SELECT l_orderkey, round(sum(CASE WHEN abs(angle) > pi() / 4 THEN max_x - min_x ELSE 0 END) / sum(max_x - min_x), 6) AS misoriented FROM b GROUP BY 1",
    "page_skew": f"""WITH {_LEAN}, w AS (SELECT l_orderkey, median(angle / 20) AS m, count(*) AS n FROM b WHERE max_x - min_x >= 5 * (max_y - min_y) GROUP BY 1)
SELECT DISTINCT b.l_orderkey, CASE WHEN n >= 3 AND abs(m) <= 5 * pi() / 180 THEN round(m, 6) ELSE 0.0::DOUBLE END AS skew FROM b LEFT JOIN w USING (l_orderkey)""",
    "deskewed_boxes": f"""WITH {_LEAN}, c AS (SELECT l_orderkey, l_partkey, rowid AS id, unnest([min_x, min_x, max_x, max_x]) AS x, unnest([min_y, max_y, min_y, max_y]) AS y FROM (SELECT *, row_number() OVER () AS rowid FROM b WHERE l_linenumber = 1)),
t AS (SELECT l_orderkey, l_partkey, id, {_TURNED[0]} AS x, {_TURNED[1]} AS y FROM c)
SELECT l_orderkey, l_partkey, round(min(x), 4) + 0.0::DOUBLE AS min_x, round(min(y), 4) + 0.0::DOUBLE AS min_y, round(max(x), 4) + 0.0::DOUBLE AS max_x, round(max(y), 4) + 0.0::DOUBLE AS max_y FROM t GROUP BY l_orderkey, l_partkey, id""",
    "chapter_shift": f"""WITH f AS ({recognised.ORACLES["chapter_pages"]}), s AS (SELECT user_id, unnest(CASE WHEN pages = '' THEN [] ELSE string_split(pages, ',') END)::BIGINT - expected AS shift FROM f), n AS (SELECT user_id, shift, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, shift, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, abs(shift), shift) AS r FROM n) WHERE r = 1 AND n >= 2""",
}
