"""Checks of written outlines and of page references against a text layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireline.operators.scans import ordered


def normal_warning(text: Column) -> Column:
    """Paths, offsets and object numbers masked, so that warnings of two runs can be compared."""
    out = F.regexp_replace(text, r"(?:[A-Za-z]:)?(?:/[^\s/:'\"]+)+", "<path>")
    out = F.regexp_replace(out, r"(?i)\b(offset|byte|position|at)\s+[0-9]+", "$1 <n>")
    return F.regexp_replace(out, r"\b[0-9]+ [0-9]+ (?=R\b|obj\b)", "<ref> ")


def keeps_prefix(before: Column, after: Column) -> Column:
    """Whether the original bytes begin the updated ones."""
    return F.startswith(after, before)


def probe_outline(files: DataFrame, key: str, pages: str) -> DataFrame:
    """Five entries for each file: first page, quarters and last; levels 0, 1, 2, 1, 0."""
    n = F.col(pages)
    at = [F.lit(1), *(F.greatest(F.lit(1), F.floor(n * k / 4)).cast("int") for k in (1, 2, 3)), n.cast("int")]
    rows = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(f"Probe {i + 1}").alias("title"), F.lit(level).alias("level"), page.cast("int").alias("page")) for i, (level, page) in enumerate(zip((0, 1, 2, 1, 0), at, strict=True))))
    return files.select(key, F.inline(rows))


def toc_pages(lines: DataFrame, doc: str, page: str, text: str, *, first: int = 40, least: int = 3, share: float = 0.35) -> DataFrame:
    """doc, page of the run of pages that begins with a heading of a table of contents among the first pages and goes on while enough lines
    end in numbers."""
    tail = F.col(text).rlike(r"[0-9ivxlc]\s*$") & F.col(text).rlike(r"\S\s*[.…·\s]+\s*[0-9ivxlc]+\s*$")
    heading = F.trim(F.lower(text)).isin("contents", "table of contents", "目录", "目次", "inhalt", "inhaltsverzeichnis", "sommaire", "índice")
    held = lines.groupBy(doc, page).agg(F.count_if(tail).alias("tails"), F.count("*").alias("n"), F.max(heading.cast("int")).alias("heading"))
    good = held.withColumn("good", (F.col("tails") >= F.greatest(F.lit(float(least)), F.col("n") * share)) | (F.col("heading") == 1))
    begin = good.filter((F.col("heading") == 1) & (F.col(page) <= first)).groupBy(doc).agg(F.min(page).alias("begin"))
    after = good.join(begin, doc).filter(F.col(page) >= F.col("begin"))
    bad = F.min(F.when(~F.col("good"), F.col(page))).over(Window.partitionBy(doc))
    gap = F.min(F.when(F.col(page) - F.col("begin") != F.col("__i"), F.col(page))).over(Window.partitionBy(doc))
    placed = after.withColumn("__i", F.row_number().over(ordered(doc, page)) - 1).withColumn("__bad", bad).withColumn("__gap", gap)
    stop = F.least(F.coalesce("__bad", F.lit(2**31 - 1)), F.coalesce("__gap", F.lit(2**31 - 1)))
    return placed.filter(F.col(page) < stop).select(doc, page)


def keyword_hits(entries: DataFrame, pages: DataFrame, doc: str, *, key: str, keywords: str, page: str, text: str = "text", reach: int = 3) -> DataFrame:
    """Per entry: ``exact`` if its page has all but one of its keywords, ``near`` if a page within ``reach`` has, else ``missing``."""
    each = entries.select(doc, key, F.col(page).alias("wanted"), keywords, F.explode(F.sequence(F.col(page) - reach, F.col(page) + reach)).alias(page))
    seen = each.join(pages.select(doc, page, F.lower(text).alias("__t")), [doc, page])
    hits = F.size(F.filter(keywords, lambda k: F.col("__t").contains(F.lower(k))))
    good = seen.filter(hits >= F.greatest(F.lit(1), F.size(keywords) - 1)).groupBy(doc, key).agg(F.min(F.abs(F.col(page) - F.col("wanted"))).alias("d"))
    return entries.join(good, [doc, key], "left").withColumn("landing", F.when(F.col("d") == 0, "exact").when(F.col("d").isNotNull(), "near").otherwise("missing")).drop("d")


def searched_offset(entries: DataFrame, pages: DataFrame, doc: str, *, key: str, title: str, page: str, text: str = "text", most: int = 44) -> DataFrame:
    """doc, offset, votes: each entry whose title is on exactly one page within 0 to ``most`` behind its printed page votes for the difference."""
    window = entries.select(doc, key, F.col(page).alias("printed"), F.lower(title).alias("__title"), F.explode(F.sequence(F.col(page), F.col(page) + most)).alias(page))
    found = window.join(pages.select(doc, page, F.lower(text).alias("__t")), [doc, page]).filter(F.col("__t").contains(F.col("__title")))
    once = found.groupBy(doc, key).agg(F.count("*").alias("n"), F.min(F.col(page) - F.col("printed")).alias("offset")).filter("n = 1")
    votes = once.groupBy(doc, "offset").agg(F.count("*").alias("votes"))
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("votes"), "offset"))
    return votes.withColumn("__r", rank).filter("__r = 1").drop("__r")


def carried_lines(lines: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Lines joined to the next one that ends in a number: the part before a page number may be spread over lines."""
    ends = F.col(text).rlike(r"[0-9]\s*$").cast("int")
    before = F.coalesce(F.sum(ends).over(ordered(doc, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = lines.withColumn("__run", before)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim(text).alias("t")))), lambda r: r["t"]), " ")
    return held.groupBy(doc, "__run").agg(F.min(order).alias(order), joined.alias(text)).drop("__run")
