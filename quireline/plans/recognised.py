"""Queries on page numbers, headings and lines as they are read from pages; lines are made of the test tables, with known answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quireline.functions import headings, numerals, ocr, tokens
from quireline.operators import layout, matching, recognised


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines and what they say: title, value, kind. ``#`` is a number of the row, 2 to 96.
TRAILING = [
    ("Growth of cities ........ #", "Growth of cities", "#", "arabic"),
    ("城市的发展 …… #", "城市的发展", "#", "arabic"),
    ("小结#", "小结", "#", "arabic"),
    ("Trade routes and ports   #", "Trade routes and ports", "#", "arabic"),
    ("Foreword . . . . xiv", "Foreword", "14", "roman"),
    ("Foreword xiv", "Foreword", "14", "roman"),
    ("Volume IX", None, None, None),
    ("Volume —— IX", "Volume", "9", "roman"),
    ("Section 4.#", None, None, None),
    ("3.1.#", None, None, None),
    ("Rivers and lakes …… l#", "Rivers and lakes", "1#", "arabic"),
    ("Rivers and lakes …… #-98", "Rivers and lakes", "#", "arabic"),
    ("谢辞 ……j", "谢辞", "1", "roman"),
    ("Thanks ×#", None, None, None),
    ("Planet B#", None, None, None),
    ("A word alone", None, None, None),
]
#: Running heads and the numbers that may be a page's.
HEADS = [("#", "#"), ("— # —", "#"), ("Page #", "#"), ("第 # 页", "#"), ("Supply and demand #", "#"), ("# Supply and demand", "#"), ("供给#", "#"), ("#供给", "#"), ("Chapter #", ""), ("第 # 章 供给", ""), ("第#章 供给", ""), ("3.# Supply", ""), ("CHAPTER 4 · SUPPLY #", "#"), ("xiv", ""), ("plain words", "")]
#: Titles, their kind and numbers.
TITLES = [
    ("第#章 供给", "chapter", "#"), ("Chapter # Supply", "chapter", "#"), ("Chapter IX: Supply", "chapter", "9"), ("第Ⅳ章 供给", "chapter", "4"), ("CHAPTER SEVEN", "chapter", "7"), ("Lecture # Supply", "chapter", "#"),
    ("第十一节 供给", "section", "11"), ("§# Supply", "section", "#"), ("Part II Supply", "part", "2"), ("下篇 供给", "part", "3"), ("二、供给", "cn_enum", "2"), ("（三）供给", "cn_paren", "3"),
    ("#. Supply", "arabic", "#"), ("（#）供给", "arabic_paren", "#"), ("4.# Supply", "dotted", "4,#"), ("4.#.2 Supply", "dotted", "4,#,2"), ("B.# Supply", "dotted", "2,#"), ("Appendix C Supply", "appendix", "3"), ("附录 D 供给", "appendix", "4"),
    ("Preface", "matter", ""), ("参考文献", "matter", ""), ("Table of Contents", "toc_heading", ""), ("思考题", "trailer", ""), ("The price of bread", "none", ""), ("三国演义", "none", ""), ("Unit Testing", "none", ""),
]
#: Lines of printed contents: title, value, style.
LINES = [
    ("第#章 供给 …… #", "第#章 供给", "#", "arabic"), ("4.1 Supply ........ #", "4.1 Supply", "#", "arabic"), ("Preface . . . . xiv", "Preface", "14", "roman"), ("Star Wars IV", "Star Wars IV", None, None), ("Part #", "Part #", None, None),
    ("供给#", "供给", "#", "arabic"), ("Supply#", "Supply#", None, None), ("COVID-#", "COVID-#", None, None), ("供给 …… l#", "供给", "1#", "arabic"), ("Supply #-98", "Supply", "#", "arabic"), ("供给（#）", "供给", "#", "arabic"),
    ("Supply p. #", "Supply", "#", "arabic"), ("Index\tB#", "Index", "#", "prefixed"), ("Vitamin B#", "Vitamin B#", None, None), ("供给 ……", "供给", None, None), ("前 言 …… #", "前言", "#", "arabic"), ("Web 2.0 Supply #", "Web 2.0 Supply", "#", "arabic"),
]
#: Numbers as words, and their values.
NUMBERS = [("九十六", 96), ("两千零五", 2005), ("一Ｏ五", 105), ("叁拾", 30), ("十百", None), ("xciv", 94), ("IIII", None), ("Ⅻ", 12), ("twenty-first", 21), ("Forty-Two", 42), ("tenth", 10), ("sixty", None), ("123456", 123456), ("1234567", None), ("１２", 12), ("国", None)]


def _made(spark, sf_dir, rows):
    """Each order with one of the lines, the number of the order in it."""
    number = (F.col("o_orderkey") % 95 + 2).cast("string")
    pick = (F.col("o_orderkey") % len(rows)).cast("int") + 1
    shape = F.element_at(F.array(*(F.lit(r[0]) for r in rows)), pick)
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.replace(shape, F.lit("#"), number).alias("line"))


def _oracle(rows, names):
    """The same answers, looked up."""
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    table = ", ".join(f"({i}, {', '.join(text(v) for v in r[1:])})" for i, r in enumerate(rows))
    shown = ", ".join(f"replace(v{i}, '#', (o_orderkey % 95 + 2)::VARCHAR) AS {n}" for i, n in enumerate(names))
    return f"SELECT o_orderkey, {shown} FROM orders JOIN (VALUES {table}) t(k, {', '.join(f'v{i}' for i in range(len(names)))}) ON k = o_orderkey % {len(rows)}"


def _read(df, schema, one):
    """``one`` of each different line, a batch of lines at a time."""

    @F.pandas_udf(schema)
    def run(lines: pd.Series) -> pd.DataFrame:
        known = {t: one(t) for t in lines.unique()}
        names = [part.split(" ")[0] for part in schema.split(", ")]
        return pd.DataFrame([known[t] for t in lines], columns=names)

    return df.select("*", run("line").alias("read")).select("o_orderkey", "read.*")


def ocr_trailing(spark, sf_dir):
    def one(line):
        found = ocr.split_trailing(line)
        return (found.title, str(found.number.value), found.number.kind) if found else (None, None, None)

    return _read(_made(spark, sf_dir, TRAILING), "title string, value string, kind string", one)


def ocr_folio(spark, sf_dir):
    return _read(_made(spark, sf_dir, HEADS), "numbers string", lambda line: (",".join(str(v) for v, _ in ocr.folio_candidates(line)),))


def heading_classify(spark, sf_dir):
    def one(line):
        found = headings.classify(line)
        return found.kind, ",".join(map(str, found.numbers))

    return _read(_made(spark, sf_dir, TITLES), "kind string, numbers string", one)


def page_split(spark, sf_dir):
    def one(line):
        found = tokens.split_page(line)
        return (found.title, *((str(found.page.value), found.page.style) if found.page else (None, None)))

    return _read(_made(spark, sf_dir, LINES), "title string, value string, style string", one)


def any_number(spark, sf_dir):
    def one(line):
        value = numerals.any_number(line)
        return (None if value is None else str(value),)

    return _read(_made(spark, sf_dir, NUMBERS), "value string", one)


def _numbered(spark, sf_dir):
    """Page numbers in the order of a customer's orders: front matter, then pages; some are 1 or i."""
    key = F.col("o_orderkey")
    kind = F.when(key % 7 == 0, F.lit(None)).when(key % 5 < 2, "roman").otherwise("arabic")
    value = F.when(kind.isNotNull(), F.when(key % 3 < 2, 1).otherwise(key % 6 + 1).cast("long"))
    return _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", value.alias("value"), kind.alias("kind"))


def one_or_i(spark, sf_dir):
    return recognised.one_or_i(_numbered(spark, sf_dir), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "kind_read")


def _boxes(spark, sf_dir):
    """Line items of an order as boxes of a page."""
    x, y = F.floor("l_quantity").cast("double"), (F.floor("l_extendedprice") % 40).cast("double")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).cast("long").alias("key"), x.alias("min_x"), y.alias("min_y"), (x + 8).alias("max_x"), (y + 10 + F.col("l_linenumber")).alias("max_y"), (F.col("l_linenumber") % 2 == 0).alias("new"), "l_partkey", "l_discount")


def reread_boxes(spark, sf_dir):
    """Boxes of a second reading that no box of the first covers by over 0.3; only the first of a page's second reading is asked."""
    boxes = _boxes(spark, sf_dir)
    first = boxes.filter("new").groupBy("l_orderkey").agg(F.min(F.struct("key", "min_x", "min_y", "max_x", "max_y")).alias("one")).select("l_orderkey", "one.*")
    return recognised.drop_reread(boxes.filter("NOT new"), first, ["l_orderkey"], "key").select("l_orderkey", "key")


def front_anchors(spark, sf_dir):
    """Users' events as titles of front pages, shown on pages by a second rule; the offset where all agree."""
    events = _table(spark, sf_dir, "events")
    entries = events.filter("event_id % 4 = 0").select("user_id", F.concat(F.lit("Notes of "), (F.col("event_id") % 9).cast("string"), F.lit(" "), "event_type").alias("title"), (F.col("event_id") % 9 + 1).alias("value"))
    lines = events.filter("event_id % 3 = 0").select("user_id", F.concat(F.lit("Notes of "), (F.col("event_id") % 9).cast("string"), F.lit(" "), "event_type").alias("line"), (F.col("event_id") % 9 + 4 + F.when(F.col("event_id") % 33 == 0, 5).otherwise(0)).alias("page"))
    return recognised.title_anchors(entries, lines, "user_id")


def entry_confidence(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem")
    n = F.col("l_partkey")
    made = recognised.entry_confidence(F.col("l_discount") * 10, title=F.when(n % 11 > 0, "t"), noisy=n % 2 == 0, upper=n % 3 == 0, touches=F.when(n % 5 > 0, n % 5 == 1), unstable=n % 7 == 0)
    return items.select("l_orderkey", "l_linenumber", "l_partkey", F.round(made, 6).alias("confidence"))


def mean_confidence(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer").select("c_custkey")
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 5 / 4).alias("confidence"))
    return recognised.mean_confidence(orders, customers, "c_custkey").select("c_custkey", F.round("mean_confidence", 6).alias("mean_confidence"))


def nearest_pages(spark, sf_dir):
    pages = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") % 60 - 3).alias("page"), F.lit(50).alias("n"))
    known = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), F.explode(F.array(F.lit(44).cast("long"), F.lit(47).cast("long"))).alias("page"))
    return recognised.nearest_pages(pages, known, "doc", "page", count="n")


def next_status(spark, sf_dir):
    w = F.row_number().over(recognised.ordered("o_custkey", "o_orderkey")).cast("long") - 1
    rows = _table(spark, sf_dir, "orders").withColumn("pos", w)
    return recognised.next_with_status(rows, "o_custkey", "pos", "o_orderstatus", ["F", "P"], F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey") % 4 * 2))


def number_column(spark, sf_dir):
    return layout.number_column(_boxes(spark, sf_dir), ["l_orderkey"], 6.0)


def number_skew(spark, sf_dir):
    """Line items as numbers in a column that leans; the slope in thousandths."""
    items = _table(spark, sf_dir, "lineitem")
    y = (F.floor("l_extendedprice") % 1000).cast("double")
    x = 900 + y * (F.col("l_orderkey") % 9 - 4) / 100 + F.when(F.col("l_linenumber") == 3, 7).otherwise(0)
    made = layout.number_column_skew(items.select("l_orderkey", x.alias("x"), y.alias("y")), ["l_orderkey"], x="x", y="y", width=F.lit(1000), height=F.lit(1000), tolerance=F.lit(4))
    return made.select("l_orderkey", (F.round("skew", 6) + F.lit(0.0)).alias("skew"))


def _shown(spark, sf_dir):
    """Events of a user as lines of pages."""
    return _table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 40).alias("page"), F.concat(F.lit("Matters of "), "event_type").alias("line"))


def chapter_pages(spark, sf_dir):
    """Pages around the expected one that show a chapter's title, and whether the expected page confirms it."""
    chapters = _table(spark, sf_dir, "events").filter("event_id % 11 = 0").select("user_id", F.concat(F.lit("Matter of "), "event_type").alias("title"), (F.col("event_id") % 37 + 3).alias("expected")).distinct()
    found = matching.chapter_windows(chapters, _shown(spark, sf_dir), "user_id", expected="expected", title="title", page="page", line="line")
    return found.select("user_id", "title", "expected", F.array_join("pages", ",").alias("pages"), "confirmed")


def located_titles(spark, sf_dir):
    """The first page of a span that shows a title; pages that are divisible by 5 are not looked at."""
    events = _table(spark, sf_dir, "events")
    spans = events.filter("event_id % 13 = 0").select("user_id", "event_id", F.concat(F.lit("Matter of "), "event_type").alias("title"), (F.col("event_id") % 30).alias("low"), (F.col("event_id") % 30 + 9).alias("high"))
    out = events.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(40), F.lit(5))).alias("p")).select("user_id", F.col("p").cast("long").alias("page"))
    return matching.locate_titles(spans, _shown(spark, sf_dir), "user_id", "event_id", title="title", page="page", line="line", excluded=out).select("user_id", "event_id", "located")


QUERIES = {f.__name__: f for f in (number_column, number_skew, chapter_pages, located_titles, ocr_trailing, ocr_folio, heading_classify, page_split, any_number, one_or_i, reread_boxes, front_anchors, entry_confidence, mean_confidence, nearest_pages, next_status)}

ORACLES = {
    "number_column": """WITH b AS (SELECT l_orderkey AS k, floor(l_quantity) AS x0, floor(l_quantity) + 8 AS x1, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
c AS (SELECT k, n, 1 AS side, x1 AS edge, count(*) OVER w AS size, min(x0) OVER w AS l, max(x1) OVER w AS r FROM b WINDOW w AS (PARTITION BY k ORDER BY x1 RANGE BETWEEN CURRENT ROW AND 6 FOLLOWING)
UNION ALL SELECT k, n, 0, x0, count(*) OVER w, min(x0) OVER w, max(x1) OVER w FROM b WINDOW w AS (PARTITION BY k ORDER BY x0 RANGE BETWEEN CURRENT ROW AND 6 FOLLOWING))
SELECT k AS l_orderkey, l AS "left", r AS "right" FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY size DESC, side DESC, edge) AS i FROM c) WHERE i = 1 AND size >= 3 AND 2 * size >= n""",
    "number_skew": """WITH p AS (SELECT l_orderkey AS k, (floor(l_extendedprice) % 1000)::DOUBLE AS y, 900 + (floor(l_extendedprice) % 1000)::DOUBLE * (l_orderkey % 9 - 4) / 100 + CASE WHEN l_linenumber = 3 THEN 7 ELSE 0 END AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
c AS (SELECT * FROM p q WHERE x >= (SELECT max(x) FROM p WHERE p.k = q.k) - 50),
g AS (SELECT k, count(*) AS n, max(y) - min(y) AS tall FROM c GROUP BY 1),
s AS (SELECT a.k, median((b.x - a.x) / (b.y - a.y)) AS slope FROM c a JOIN c b ON a.k = b.k AND a.i < b.i AND abs(b.y - a.y) >= 100 GROUP BY 1),
t AS (SELECT c.k, slope, median(x - slope * y) AS start FROM c JOIN s USING (k) GROUP BY 1, 2),
f AS (SELECT c.k, slope, count(*) FILTER (abs(x - (start + slope * y)) <= 4) AS near FROM c JOIN t USING (k) GROUP BY 1, 2)
SELECT g.k AS l_orderkey, CASE WHEN n >= 4 AND tall >= 250 AND 4 * near >= 3 * n AND abs(atan(slope)) <= 5 * pi() / 180 THEN round(-atan(slope), 6) + 0.0::DOUBLE END AS skew FROM g LEFT JOIN f USING (k)""",
    "chapter_pages": """WITH c AS (SELECT DISTINCT user_id, 'Matter of ' || event_type AS title, event_id % 37 + 3 AS expected FROM events WHERE event_id % 11 = 0), l AS (SELECT DISTINCT user_id, event_id % 40 AS page, 'Matters of ' || event_type AS line FROM events),
h AS (SELECT c.user_id, title, expected, list_sort(list(DISTINCT page)) AS pages FROM c JOIN l ON l.user_id = c.user_id AND abs(page - expected) <= 3 AND levenshtein(title, line) <= floor(length(title) * 0.2::DOUBLE) GROUP BY 1, 2, 3)
SELECT user_id, title, expected, coalesce(array_to_string(pages, ','), '') AS pages, coalesce(list_contains(pages, expected) AND NOT list_contains(pages, expected - 1), false) AS confirmed FROM c LEFT JOIN h USING (user_id, title, expected)""",
    "located_titles": """WITH s AS (SELECT user_id, event_id, 'Matter of ' || event_type AS title, event_id % 30 AS low, event_id % 30 + 9 AS high FROM events WHERE event_id % 13 = 0), l AS (SELECT user_id, event_id % 40 AS page, 'Matters of ' || event_type AS line FROM events)
SELECT s.user_id, s.event_id, min(page) AS located FROM s JOIN l ON l.user_id = s.user_id AND page BETWEEN low AND high AND page % 5 <> 0 AND levenshtein(title, line) <= floor(length(title) * 0.2::DOUBLE) GROUP BY 1, 2""",
    "ocr_trailing": _oracle(TRAILING, ("title", "value", "kind")),
    "ocr_folio": _oracle(HEADS, ("numbers",)),
    "heading_classify": _oracle(TITLES, ("kind", "numbers")),
    "page_split": _oracle(LINES, ("title", "value", "style")),
    "any_number": _oracle([(t, None if v is None else str(v)) for t, v in NUMBERS], ("value",)),
    "one_or_i": """WITH n AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 < 2 THEN 'roman' ELSE 'arabic' END AS kind, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 < 2 THEN 1 ELSE o_orderkey % 6 + 1 END AS value FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM n WHERE kind IS NOT NULL),
r AS (SELECT b.o_custkey, b.o_orderkey, CASE WHEN b.value = 1 AND b.kind = 'roman' AND (a.kind = 'roman' OR a.value = 1) AND c.kind = 'arabic' AND c.value <= 3 THEN 'arabic' WHEN b.value = 1 AND b.kind = 'arabic' AND c.kind = 'roman' THEN 'roman' ELSE b.kind END AS kind_read
FROM k b LEFT JOIN k a ON a.o_custkey = b.o_custkey AND a.i = b.i - 1 LEFT JOIN k c ON c.o_custkey = b.o_custkey AND c.i = b.i + 1)
SELECT o_custkey, o_orderkey, kind_read FROM n LEFT JOIN r USING (o_custkey, o_orderkey)""",
    "reread_boxes": """WITH b AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS key, floor(l_quantity) AS x0, floor(l_extendedprice) % 40 AS y0, floor(l_quantity) + 8 AS x1, floor(l_extendedprice) % 40 + 10 + l_linenumber AS y1, l_linenumber % 2 = 0 AS new FROM lineitem),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY key, x0, y0, x1, y1) AS i FROM b WHERE new) WHERE i = 1)
SELECT l_orderkey, key FROM f WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = f.l_orderkey AND NOT b.new AND least(b.x1, f.x1) > greatest(b.x0, f.x0) AND least(b.y1, f.y1) > greatest(b.y0, f.y0)
AND (least(b.x1, f.x1) - greatest(b.x0, f.x0)) * (least(b.y1, f.y1) - greatest(b.y0, f.y0)) > 0.3::DOUBLE * ((f.x1 - f.x0) * (f.y1 - f.y0)))""",
    "front_anchors": """WITH t AS (SELECT DISTINCT user_id, 'Notes of ' || event_id % 9 || ' ' || event_type AS title, event_id % 9 + 1 AS value FROM events WHERE event_id % 4 = 0),
l AS (SELECT user_id, 'Notes of ' || event_id % 9 || ' ' || event_type AS line, event_id % 9 + 4 + CASE WHEN event_id % 33 = 0 THEN 5 ELSE 0 END AS page FROM events WHERE event_id % 3 = 0),
h AS (SELECT DISTINCT t.user_id, title, value, page FROM t JOIN l ON t.user_id = l.user_id AND levenshtein(title, line) <= floor(length(title) * 0.2::DOUBLE)),
s AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.user_id = h.user_id AND g.title = h.title AND g.value = h.value AND g.page = h.page - 1)),
o AS (SELECT user_id, title, value, count(*) AS n, min(page) AS page FROM s GROUP BY 1, 2, 3)
SELECT user_id, CASE WHEN count(DISTINCT page - value) FILTER (n = 1) = 1 AND min(page - value) FILTER (n = 1) >= 0 THEN min(page - value) FILTER (n = 1) END AS roman_offset, count(*) FILTER (n = 1) AS anchors, count(*) FILTER (n > 1) AS ambiguous FROM o GROUP BY 1""",
    "entry_confidence": """SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.5::DOUBLE + 0.5::DOUBLE * (l_discount * 10)) * CASE WHEN l_partkey % 2 = 0 THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN l_partkey % 3 = 0 THEN 0.8::DOUBLE ELSE 1 END
* CASE WHEN l_partkey % 5 = 1 THEN 0.8::DOUBLE ELSE 1 END * CASE WHEN l_partkey % 11 = 0 THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN l_partkey % 7 = 0 THEN 0.85::DOUBLE ELSE 1 END)), 6) AS confidence FROM lineitem""",
    "mean_confidence": "SELECT c_custkey, round(coalesce((SELECT avg(o_orderkey % 5 / 4) FROM orders WHERE o_custkey = c_custkey), 1.0), 6) AS mean_confidence FROM customer",
    "nearest_pages": """WITH p AS (SELECT DISTINCT l_suppkey AS doc, l_orderkey % 60 - 3 AS page FROM lineitem) SELECT doc, page FROM (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page DESC) AS n FROM p WHERE page BETWEEN 1 AND 50
AND NOT (page IN (44, 47) AND doc IN (SELECT s_suppkey FROM supplier))) WHERE n <= 12""",
    "next_status": """WITH r AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
s AS (SELECT *, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 4 * 2 + 1 ELSE 0 END AS start FROM r WHERE o_orderstatus IN ('F', 'P'))
SELECT o_custkey, arg_min(pos, ((pos - start) % n + n) % n) AS next_row FROM s GROUP BY 1""",
}
