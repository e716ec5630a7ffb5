"""Ordered scans: window rewrites of left-to-right loops over the rows of a document.

Every operator takes the document key and an explicit order column, adds columns, and needs one shuffle by document; operators that follow
each other on the same key share it. Nulls in an order column sort first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FIRST, _HERE = Window.unboundedPreceding, Window.currentRow


def ordered(doc: str | list[str], *order):
    return Window.partitionBy(*([doc] if isinstance(doc, str) else doc)).orderBy(*order)


def backwards(doc: str | list[str], *order: str):
    """The same rows from the end: frames that reach to the end are worked out anew for each row, frames from the beginning are not."""
    return ordered(doc, *(F.desc_nulls_last(o) for o in order))


def level_clamp(df: DataFrame, doc: str, order: str, raw: str, *, out: str = "level") -> DataFrame:
    """Levels that start at 0 and rise by one at most. With i rows before, ``i + min(0, min over rows so far of (raw - i))``."""
    w = ordered(doc, order)
    held = df.withColumn("__i", F.row_number().over(w) - 1)
    low = F.min(F.greatest(F.lit(0), F.col(raw)) - F.col("__i")).over(w.rowsBetween(_FIRST, _HERE))
    return held.withColumn(out, F.col("__i") + F.least(F.lit(0), low)).drop("__i")


def level_violations(df: DataFrame, doc: str, order: str, level: str, *, out: str = "violation") -> DataFrame:
    """True where a level is more than one below the row before it (before the first row: -1)."""
    before = F.coalesce(F.lag(level).over(ordered(doc, order)), F.lit(-1))
    return df.withColumn(out, F.col(level) > before + 1)


def inherit_pages(df: DataFrame, doc: str, order: str, page: str, *, out: str = "page_inherited", flag: str = "inherited") -> DataFrame:
    """A row without a page takes the next row's that has one, else the last row's before."""
    w = ordered(doc, order)
    after = F.last(page, ignorenulls=True).over(backwards(doc, order).rowsBetween(_FIRST, _HERE))
    before = F.last(page, ignorenulls=True).over(w.rowsBetween(_FIRST, _HERE))
    return df.withColumn(out, F.coalesce(after, before)).withColumn(flag, F.col(page).isNull() & F.col(out).isNotNull())


def forward_fill(df: DataFrame, doc: str, order: str, page: str, *, out: str = "page_filled", least: int = 1) -> DataFrame:
    """Pages below ``least`` or null become the last good page before, at first ``least``."""
    good = F.when(F.col(page) >= least, F.col(page))
    return df.withColumn(out, F.coalesce(F.last(good, ignorenulls=True).over(ordered(doc, order).rowsBetween(_FIRST, _HERE)), F.lit(least)))


def run_starts(df: DataFrame, doc: str, value: str) -> DataFrame:
    """Rows whose value - 1 is not a value of the document: the first of each run of consecutive values."""
    return df.withColumn("__p", F.lag(value).over(ordered(doc, value))).filter(F.col("__p").isNull() | (F.col(value) - 1 > F.col("__p"))).drop("__p")


def next_value(df: DataFrame, doc: str, order: str, value: str, *, out: str = "next_value") -> DataFrame:
    """The next non-null value behind a row."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(backwards(doc, order).rowsBetween(_FIRST, -1)))


def previous_value(df: DataFrame, doc: str, order: str, value: str, *, out: str = "previous_value") -> DataFrame:
    return df.withColumn(out, F.last(value, ignorenulls=True).over(ordered(doc, order).rowsBetween(_FIRST, -1)))


def order_breaks(df: DataFrame, doc: str, order: str, value: str, *, out: str = "out_of_order") -> DataFrame:
    """True for both rows of a neighbouring pair whose values fall."""
    w = ordered(doc, order)
    falls = F.coalesce(F.col(value) < F.lag(value).over(w), F.lit(False))
    fell = F.coalesce(F.lead(value).over(w) < F.col(value), F.lit(False))
    return df.withColumn(out, falls | fell)


def behind_last(df: DataFrame, doc: str, order: str, value: str, *, out: str = "behind") -> DataFrame:
    """True where a value is below the last non-null one before it."""
    before = F.last(value, ignorenulls=True).over(ordered(doc, order).rowsBetween(_FIRST, -1))
    return df.withColumn(out, F.coalesce(F.col(value) < before, F.lit(False)))


def chain_clusters(df: DataFrame, doc: str, value: str, tolerance: float, *, out: str = "cluster") -> DataFrame:
    """Clusters from 0 along the sorted values: a new one where the gap to the previous value is over ``tolerance``."""
    w = ordered(doc, value)
    new = F.coalesce((F.col(value) - F.lag(value).over(w) > tolerance).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn(out, F.sum("__new").over(w.rangeBetween(_FIRST, _HERE))).drop("__new")


def anchor_clusters(df: DataFrame, doc: str, value: str, tolerance: float) -> DataFrame:
    """Per document and distinct value: the cluster (from 0) and its anchor. A new cluster begins where a value is over ``tolerance`` above
    the first value of the current one, so chains do not creep. Each document's distinct values are streamed in order."""
    from quireline.operators.grouped import per_group

    held = df.filter(F.col(value).isNotNull()).select(F.col(doc), F.col(value).alias("value")).distinct()

    def run(rows: list[tuple]) -> list[tuple]:
        out, anchor, number = [], None, -1
        for key, v in rows:
            if anchor is None or v - anchor > tolerance:
                anchor, number = v, number + 1
            out.append((key, v, anchor, number))
        return out

    return per_group(held, [doc], ["value"], run, held.withColumn("anchor", F.col("value") + 0).withColumn("cluster", F.lit(0)).select(doc, "value", F.col("value").alias("anchor"), "cluster").schema)


def widest_cluster(df: DataFrame, doc: str, value: str, tolerance: float) -> DataFrame:
    """Per document, the largest set of rows whose values span at most ``tolerance``: its low and high value and size (ties: lowest)."""
    w = Window.partitionBy(doc).orderBy(value).rangeBetween(0, tolerance)
    each = df.filter(F.col(value).isNotNull()).select(doc, F.col(value).alias("low"), F.count("*").over(w).alias("size"), F.max(value).over(w).alias("high"))
    best = F.max_by(F.struct("low", "high", "size"), F.struct(F.col("size"), -F.col("low")))
    return each.groupBy(doc).agg(best.alias("b")).select(doc, "b.low", "b.high", "b.size")


def gaps(df: DataFrame, doc: str, value: str, factor: float = 1.2, *, out: str = "gap") -> DataFrame:
    """True where the step from the row before is over ``factor`` times the document's median step."""
    stepped = df.withColumn("__step", F.col(value) - F.lag(value).over(ordered(doc, value)))
    middle = F.median("__step").over(Window.partitionBy(doc))
    return stepped.withColumn(out, F.coalesce(F.col("__step") > factor * middle, F.lit(False))).drop("__step")


def column_order(df: DataFrame, doc: str, line: str, part: str, parts_in_line: str) -> DataFrame:
    """``reading_order``: in each run of two-part lines the left halves come first, then the right halves; one-part lines end a run."""
    w = ordered(doc, line, part)
    breaks = F.sum((F.col(parts_in_line) == 1).cast("int")).over(w.rowsBetween(_FIRST, _HERE))
    run = breaks * 2 + F.when(F.col(parts_in_line) == 1, -1).otherwise(0)
    return df.withColumn("__run", run).withColumn("reading_order", F.row_number().over(ordered(doc, "__run", part, line))).drop("__run")


def rotate(df: DataFrame, doc: str, pos: str, focus: str, *, out: str = "queue") -> DataFrame:
    """A review queue: rows behind the focus first, then those up to it."""
    return df.withColumn(out, F.row_number().over(ordered(doc, F.col(pos) <= F.col(focus), pos)))


def rank_levels(df: DataFrame, doc: str, order: str, rank: str, *, out: str = "level") -> DataFrame:
    """Depth of a stack that pops ranks not below the row's own; the rows of each document are streamed in order."""
    from quireline.operators.grouped import per_group

    held = df.select(doc, order, rank)

    def run(rows: list[tuple]) -> list[tuple]:
        stack, made = [], []
        for key, at, own in rows:
            while stack and (own is None or stack[-1] is None or not stack[-1] < own):
                stack.pop()
            made.append((key, at, own, len(stack)))
            stack.append(own)
        return made

    return per_group(held, [doc], [order], run, held.withColumn(out, F.lit(0)).schema)


def longest_nondecreasing(df: DataFrame, doc: str, order: str, value: str) -> DataFrame:
    """Per row, whether it is kept by the longest non-decreasing subsequence of its document (one that binary search over tails finds: equal
    values extend, and ties go to the latest tail). Null values are not kept. The rows of each document are streamed in order."""
    from bisect import bisect_right

    from quireline.operators.grouped import per_group

    def run(rows: list[tuple]) -> list[tuple]:
        tails, ends, before, kept = [], [], {}, set()
        for i, (_, _, v) in enumerate(rows):
            if v is None or v != v:
                continue
            at = bisect_right(tails, v)
            before[i] = ends[at - 1] if at else None
            tails[at : at + 1], ends[at : at + 1] = [v], [i]
        at = ends[-1] if ends else None
        while at is not None:
            kept.add(at)
            at = before[at]
        return [(*row, i in kept) for i, row in enumerate(rows)]

    held = df.select(doc, order, value)
    return per_group(held, [doc], [order], run, held.withColumn("kept", F.lit(True)).schema)
