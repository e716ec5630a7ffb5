"""Joins between titles, lines and pages: fuzzy, range, interval and containment joins.

Each has an equality key (document, page, or a bucket) that Spark can hash on; the inexact condition is checked within it. A bucket join is
used for ranges, so that no pair outside neighbouring buckets is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireline.functions.text import edit_limit, fuzzy_equal
from quireline.operators.scans import backwards, ordered


def first_match(left: DataFrame, right: DataFrame, key: list[str], order: str, value: str, *, out: str) -> DataFrame:
    """Left join that keeps, of equal right keys, the value that is first in ``order``."""
    once = right.groupBy(*key).agg(F.min_by(value, order).alias(out))
    return left.join(once, key, "left")


def unique_match(left: DataFrame, right: DataFrame, key: list[str], value: str, *, out: str) -> DataFrame:
    """Left join with the value of the right key if exactly one row has that key."""
    once = right.groupBy(*key).agg(F.count("*").alias("__n"), F.min(value).alias(out)).filter("__n = 1").drop("__n")
    return left.join(once, key, "left")


def range_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, reach: int, *, key: list[str] = (), how: str = "inner") -> DataFrame:
    """Pairs whose values differ by at most ``reach``. Right rows are put into their bucket and both neighbours, so the join is an equality."""
    size = max(1, reach)
    a = left.withColumn("__b", F.floor(F.col(left_value) / size))
    spread = F.explode(F.array(*(F.floor(F.col(right_value) / size) + d for d in (-1, 0, 1))))
    b = right.withColumn("__b", spread)
    on = [*key, "__b"]
    joined = a.join(b, on, how) if how == "inner" else a.join(b, on, how)
    return joined.filter(F.abs(F.col(left_value) - F.col(right_value)) <= reach).drop("__b")


def fuzzy_join(titles: DataFrame, lines: DataFrame, key: list[str], title: str, line: str) -> DataFrame:
    """Titles and lines of one key whose edit distance is within a fifth of the title's length (exact up to three characters). For keys of few
    rows, such as pages; ``similar_titles`` is for large ones."""
    return titles.join(lines, key).filter(fuzzy_equal(F.col(title), F.col(line)))


def similar_titles(df: DataFrame, key: list[str], title: str) -> DataFrame:
    """Pairs of different titles of one key, ``title`` and ``other``, whose edit distance is within a fifth of ``title``'s length (none up to
    three characters). However many rows have a title, it counts once.

    A title of n characters that may have k edits is cut into k + 1 parts of like size: one of them is whole in the other title, at most k
    places off. So pairs meet on (key, n, number of the part, the part), and only those that meet are compared. The other title asks for all n
    that its own length allows."""
    once = df.filter(F.col(title).isNotNull()).select(*key, F.col(title).alias("title")).distinct()
    limit, start = edit_limit(F.col("__n")), lambda i: F.floor(i * F.col("__n") / (F.col("__k") + 1)).cast("int")
    part = F.explode(F.sequence(F.lit(0), F.col("__k"))).alias("__part")
    asks = once.withColumn("__n", F.length("title")).withColumn("__k", limit).filter("__k > 0")
    asks = asks.select(*key, "title", "__n", "__k", part).select(*key, "title", "__n", "__part", F.substring("title", start(F.col("__part")) + 1, start(F.col("__part") + 1) - start(F.col("__part"))).alias("__held"))
    length = F.length("title")
    told = once.select(*key, F.col("title").alias("other"), length.alias("__m"), F.explode(F.sequence(F.floor(length / 1.2).cast("int"), F.ceil(length * 1.25).cast("int"))).alias("__n"))
    told = told.withColumn("__k", limit).filter((F.col("__k") > 0) & (F.abs(F.col("__m") - F.col("__n")) <= F.col("__k"))).select(*key, "other", "__m", "__n", "__k", part)
    told = told.withColumn("__at", start(F.col("__part"))).withColumn("__size", start(F.col("__part") + 1) - F.col("__at"))
    low, high = F.greatest(F.lit(0), F.col("__at") - F.col("__k")), F.least(F.col("__m") - F.col("__size"), F.col("__at") + F.col("__k"))
    told = told.filter(low <= high).select(*key, "other", "__n", "__part", F.explode(F.array_distinct(F.transform(F.sequence(low, high), lambda p: F.substring("other", p + 1, F.col("__size"))))).alias("__held"))
    met = asks.join(told, [*key, "__n", "__part", "__held"]).filter(F.col("title") != F.col("other")).select(*key, "title", "other").distinct()
    return met.filter(fuzzy_equal(F.col("title"), F.col("other")))


def with_pairs(lines: DataFrame, doc: str, page: str, order: str, line: str) -> DataFrame:
    """The lines of each page, and each two neighbouring lines as one: titles may wrap."""
    held = lines.withColumn("__next", F.lead(line).over(ordered([doc, page], order)))
    both = F.filter(F.array(F.col(line), F.concat(F.col(line), F.col("__next"))), lambda t: t.isNotNull())
    return held.withColumn("candidate", F.explode(both)).drop("__next")


def chapter_windows(chapters: DataFrame, lines: DataFrame, doc: str, *, expected: str, title: str, page: str, line: str, reach: int = 3) -> DataFrame:
    """Per chapter: pages within ``reach`` of the expected one that show its title, and whether the expected page does and the one before does not."""
    window = chapters.withColumn("__page", F.explode(F.sequence(F.col(expected) - reach, F.col(expected) + reach)))
    shown = window.join(lines.withColumnRenamed(page, "__page"), [doc, "__page"]).filter(fuzzy_equal(F.col(title), F.col(line)))
    pages = F.array_sort(F.collect_set("__page"))
    found = shown.groupBy(doc, title, expected).agg(pages.alias("pages"))
    held = chapters.join(found, [doc, title, expected], "left").withColumn("pages", F.coalesce("pages", F.array().cast(found.schema["pages"].dataType)))
    return held.withColumn("confirmed", F.array_contains("pages", F.col(expected)) & ~F.array_contains("pages", F.col(expected) - 1))


def shift_vote(windows: DataFrame, doc: str, expected: str) -> DataFrame:
    """doc, shift, n: the commonest difference of a shown page from the expected one, two at least; ties to the nearer, then smaller."""
    each = windows.select(doc, F.explode(F.transform("pages", lambda p: p - F.col(expected))).alias("shift")).groupBy(doc, "shift").agg(F.count("*").alias("n"))
    w = Window.partitionBy(doc).orderBy(F.desc("n"), F.abs("shift"), "shift")
    return each.withColumn("__r", F.row_number().over(w)).filter("__r = 1 AND n >= 2").drop("__r")


def neighbour_spans(entries: DataFrame, doc: str, order: str, page: str, trusted: Column, *, most: int = 12) -> DataFrame:
    """Rows that are not trusted, with ``low`` and ``high``: pages of the nearest trusted rows before and behind; spans over ``most`` pages go."""
    w = ordered(doc, order)
    own = F.when(trusted, F.col(page))
    held = entries.withColumn("low", F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("high", F.last(own, ignorenulls=True).over(backwards(doc, order).rowsBetween(Window.unboundedPreceding, -1)))
    return held.filter(~F.coalesce(trusted, F.lit(False)) & F.col("low").isNotNull() & F.col("high").isNotNull() & (F.col("high") >= F.col("low")) & (F.col("high") - F.col("low") <= most))


def locate_titles(spans: DataFrame, lines: DataFrame, doc: str, order: str, *, title: str, page: str, line: str, excluded: DataFrame | None = None) -> DataFrame:
    """For each span, the first page in it that shows the title; pages in ``excluded`` (doc, page) are not looked at."""
    pages = spans.select(doc, order, title, F.explode(F.sequence("low", "high")).alias(page))
    if excluded is not None:
        pages = pages.join(excluded, [doc, page], "left_anti")
    hits = pages.join(lines, [doc, page]).filter(fuzzy_equal(F.col(title), F.col(line)))
    return hits.groupBy(doc, order, title).agg(F.min(page).alias("located"))


def as_of(left: DataFrame, right: DataFrame, key: list[str], at: str, value: str, *, out: str) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before it. One union and one window; no pairs are made."""
    a = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__side", F.lit(1))
    b = right.select(*key, at, F.col(value).alias("__v")).withColumn("__side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    last = F.last("__v", ignorenulls=True).over(Window.partitionBy(*key).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(out, last).filter("__side = 1").drop("__v", "__side")
