"""Lines of recognised contents pages: which numbers belong to which titles, what a second reading adds, and how sure an entry is.

Rows carry a page key, an order and boxes (min_x, min_y, max_x, max_y, y grows down). Windows where neighbours decide; rows are streamed in
order where an earlier decision changes a later one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireline.functions import ocr
from quireline.functions.text import fuzzy_equal
from quireline.operators.grouped import per_group
from quireline.operators.layout import overlap
from quireline.operators.scans import ordered


def one_or_i(df: DataFrame, doc: str, order: str, *, value: str = "value", kind: str = "kind", out: str = "kind_read") -> DataFrame:
    """The kind (arabic or roman) of each page number, where the order of print decides between 1 and i: i behind a Roman number and before an
    arabic one of at most 3 is 1; 1 before a Roman number is i. A 1 that this makes Roman counts as Roman for the next."""
    w = ordered(doc, F.col(value).isNull(), order)  # rows without a number come last and are no neighbours
    before, after = F.lag(kind).over(w), F.lead(kind).over(w)
    one = F.col(value) == 1
    roman_before = (before == "roman") | ((before == "arabic") & (F.lag(value).over(w) == 1))
    follows = F.lead(value).over(w)
    read = F.when(one & (F.col(kind) == "roman") & roman_before & (after == "arabic") & (follows <= 3), "arabic").when(one & (F.col(kind) == "arabic") & (after == "roman"), "roman").otherwise(F.col(kind))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), read).otherwise(F.col(kind)))


def attach_numbers(df: DataFrame, page: list[str], order: str, *, title: str = "title", number: str = "number", reach: Column | float = 0.8) -> DataFrame:
    """``attached`` (the order of the line that a number alone goes to, else null) and ``number_read`` (a line's number after that). A line of a
    number without a title goes to the line before or behind it that has a title and no number, less than ``reach`` away, the nearer by its
    middle (the one before of equals). Lines are taken in order, so a line takes one number."""
    held = df.select(*page, order, F.coalesce(title, F.lit("")).alias("__t"), F.col(number).alias("__n"), F.col("min_y").cast("double").alias("__a"), F.col("max_y").cast("double").alias("__b"), (reach if isinstance(reach, Column) else F.lit(float(reach))).cast("double").alias("__r"))
    keys = len(page)

    def run(rows: list[tuple]) -> list[tuple]:
        own, gone, to = [r[keys + 2] for r in rows], set(), {}
        box = lambda i: rows[i][keys + 3 : keys + 5]
        middle = lambda i: sum(box(i)) / 2
        for i, r in enumerate(rows):
            if own[i] is None or r[keys + 1].strip() or i in gone:
                continue
            near = [j for j in (i - 1, i + 1) if 0 <= j < len(rows) and own[j] is None and j not in gone and rows[j][keys + 1].strip() and max(box(i)[0] - box(j)[1], box(j)[0] - box(i)[1]) < r[keys + 5]]
            if near:
                j = min(near, key=lambda j: abs(middle(j) - middle(i)))
                own[j], own[i], to[i] = own[i], None, j
                gone.add(i)
        return [(*r[: keys + 1], rows[to[i]][keys] if i in to else None, own[i]) for i, r in enumerate(rows)]

    schema = held.select(*page, order, F.col(order).alias("attached"), F.col("__n").alias("number_read")).schema
    for f in schema.fields[-2:]:
        f.nullable = True
    return per_group(held, page, [order], run, schema)


def drop_reread(known: DataFrame, found: DataFrame, page: list[str], key: str, *, most: float = 0.3) -> DataFrame:
    """Rows of ``found``, in the order of ``key``, that are no second copy: those whose box neither a known box nor a row kept before covers by
    more than ``most``."""
    boxes = ["min_x", "min_y", "max_x", "max_y"]
    side = lambda df, n, *more: df.select(*page, F.lit(n).alias("__side"), *(F.col(b).cast("double").alias(f"__{b}") for b in boxes), *more)
    both, keys = side(known, 0).unionByName(side(found, 1, *(c for c in found.columns if c not in page)), allowMissingColumns=True), len(page)
    places = [both.columns.index(c) for c in found.columns]

    def run(rows: list[tuple]) -> list[tuple]:
        there, kept = [], []
        for r in rows:
            x0, y0, x1, y1 = r[keys + 1 : keys + 5]
            if r[keys]:
                area = (x1 - x0) * (y1 - y0)
                shared = ((min(x1, c) - max(x0, a), min(y1, d) - max(y0, b)) for a, b, c, d in there)
                if any(w > 0 and t > 0 and w * t > most * area for w, t in shared):
                    continue
                kept.append(tuple(r[i] for i in places))
            there.append((x0, y0, x1, y1))
        return kept

    return per_group(both, page, ["__side", key], run, found.schema)


def title_readings(lines: DataFrame, readings: DataFrame, page: list[str], line: str, *, text: str = "text", left: str = "left", right: str = "right", char: str = "char_height") -> DataFrame:
    """Per line that another reading shows: ``title`` and ``title_x``. Its boxes overlap the line vertically by half, begin between ``left`` and
    ``right`` and not far behind the line, and are not much taller; their texts from left to right, without a page number and leaders, are
    the title. ``lines``: page, line, min_y, max_y, max_x, left, right, char_height; ``readings``: page, text and boxes."""
    a = lines.select(*page, line, *(F.col(c).cast("double").alias(f"__{n}") for c, n in (("min_y", "y0"), ("max_y", "y1"), ("max_x", "x1"), (left, "l"), (right, "r"), (char, "h"))))
    met = a.join(readings.select(*page, F.col(text).alias("__t"), "min_x", "min_y", "max_y"), page)
    tall = F.greatest(F.col("__y1") - F.col("__y0"), F.col("__h"))
    fits = (overlap(F.col("min_y"), F.col("max_y"), F.col("__y0"), F.col("__y1")) >= 0.5) & (F.col("min_x") >= F.col("__l")) & (F.col("min_x") < F.least(F.col("__r"), F.col("__x1") + F.col("__h"))) & (F.col("max_y") - F.col("min_y") < 2.5 * tall)
    parts = F.array_sort(F.collect_list(F.struct(F.col("min_x").cast("double").alias("x"), F.col("__t").alias("t"))))
    whole = met.filter(fits).groupBy(*page, line).agg(parts.alias("__parts"))

    @F.pandas_udf("string")
    def titles(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            found = ocr.split_trailing(text)
            return ocr.clean_title(ocr.strip_leaders(found.title if found else text))

        return texts.map(one)

    read = whole.select(*page, line, titles(F.array_join(F.transform("__parts", lambda p: p["t"]), " ")).alias("title"), F.element_at("__parts", 1)["x"].alias("title_x"))
    return read.filter("title <> ''")


def title_anchors(entries: DataFrame, lines: DataFrame, doc: str, *, title: str = "title", value: str = "value", page: str = "page", line: str = "line") -> DataFrame:
    """Per document: ``roman_offset`` from the headings of front pages, ``anchors`` and ``ambiguous`` titles. Pages that follow each other and show
    one title count as the first; a title anchors if it then shows once. All anchors have to give one offset, and none below 0."""
    met = entries.select(doc, F.col(title).alias("__t"), F.col(value).alias("__v")).distinct().join(lines.select(doc, F.col(page).alias("__p"), F.col(line).alias("__l")), doc)
    hits = met.filter(fuzzy_equal(F.col("__t"), F.col("__l"))).select(doc, "__t", "__v", "__p").distinct()
    starts = hits.withColumn("__q", F.lag("__p").over(ordered([doc, "__t", "__v"], "__p"))).filter("__q IS NULL OR __p > __q + 1")
    once = starts.groupBy(doc, "__t", "__v").agg(F.count("*").alias("n"), F.min("__p").alias("__p"))
    found = once.groupBy(doc).agg(F.count_if(F.col("n") == 1).alias("anchors"), F.count_if(F.col("n") > 1).alias("ambiguous"), F.min(F.when(F.col("n") == 1, F.col("__p") - F.col("__v"))).alias("low"), F.max(F.when(F.col("n") == 1, F.col("__p") - F.col("__v"))).alias("high"))
    good = (F.col("anchors") > 0) & (F.col("low") == F.col("high")) & (F.col("low") >= 0)
    return found.select(doc, F.when(good, F.col("low")).alias("roman_offset"), "anchors", "ambiguous")


def entry_confidence(recognised: Column, *, title: Column, noisy: Column, upper: Column, touches: Column, unstable: Column) -> Column:
    """Confidence of an entry: half, and half of what recognition gave, times a factor for each doubt. ``noisy``, ``upper`` and ``touches`` are about
    the page number (null: there is none): letters read for digits, a capital Roman numeral, no gap to the title."""
    doubt = lambda when, factor: F.when(F.coalesce(when, F.lit(False)), factor).otherwise(1.0)
    factors = (doubt(noisy, 0.7), doubt(upper, 0.8), doubt(touches, 0.8), doubt(F.coalesce(title, F.lit("")) == "", 0.5), doubt(unstable, 0.85))
    sure = 0.5 + 0.5 * recognised
    for factor in factors:
        sure = sure * factor
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))


def mean_confidence(df: DataFrame, docs: DataFrame, doc: str, *, confidence: str = "confidence") -> DataFrame:
    """Per document of ``docs``: the mean confidence of its entries, 1 without any."""
    return docs.select(doc).join(df.groupBy(doc).agg(F.avg(confidence).alias("mean_confidence")), doc, "left").fillna(1.0, ["mean_confidence"])


def nearest_pages(pages: DataFrame, known: DataFrame, doc: str, page: str, *, count: str, limit: int = 12) -> DataFrame:
    """The last ``limit`` pages of each document that are in it (1 to ``count``) and not among the known ones."""
    todo = pages.filter((F.col(page) >= 1) & (F.col(page) <= F.col(count))).select(doc, page).distinct().join(known.select(doc, page), [doc, page], "left_anti")
    return todo.withColumn("__n", F.row_number().over(ordered(doc, F.desc(page)))).filter(F.col("__n") <= limit).drop("__n")


def next_with_status(df: DataFrame, doc: str, pos: str, status: str, wanted: list[str], focus: Column) -> DataFrame:
    """Per document with such a row: the position of the next row behind ``focus`` (null: before the first) whose status is wanted, going round."""
    rows = F.count("*").over(Window.partitionBy(doc))
    steps = F.pmod(F.col(pos) - F.coalesce(focus + 1, F.lit(0)), F.col("__rows"))
    held = df.withColumn("__rows", rows).filter(F.col(status).isin(*wanted))
    return held.groupBy(doc).agg(F.min_by(pos, steps).alias("next_row"))
