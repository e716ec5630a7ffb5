"""Trees kept as preorder rows (document, position, level), where a level is at most one below the row before.

Positions are consecutive from 0. Depth has no limit: a row's parent is the last row before it one level up, and its block ends at the first
row behind it that closes its level. Both are as-of matches on (document, level), so that work grows with the rows only: a row closes the
levels from its own to that of the row before it, and each of those was opened by one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireline.operators.grouped import per_group
from quireline.operators.matching import as_of
from quireline.operators.scans import ordered


def _before(doc: str, pos: str):
    return ordered(doc, pos).rowsBetween(Window.unboundedPreceding, -1)


def parent(df: DataFrame, doc: str, pos: str, level: str, *, out: str = "parent") -> DataFrame:
    """Position of the nearest earlier row one level up; null for level 0."""
    below = df.select(F.col(doc), (F.col(level) + 1).alias("__key"), F.col(pos), F.col(pos).alias("__p"))
    return as_of(df.withColumn("__key", F.col(level) + 0), below, [doc, "__key"], pos, "__p", out=out).drop("__key")


def ancestors(df: DataFrame, doc: str, pos: str, level: str, *, out: str = "ancestors") -> DataFrame:
    """Positions from the root down to the parent."""
    names = df.columns
    where, at = names.index(pos), names.index(level)

    def run(rows: list[tuple]) -> list[tuple]:
        path, made = [], []
        for row in rows:
            del path[row[at] :]
            made.append((*row, list(path)))
            path.append(row[where])
        return made

    return per_group(df, [doc], [pos], run, df.withColumn(out, F.array(F.col(pos))).schema)


def block_end(df: DataFrame, doc: str, pos: str, level: str, *, out: str = "block_end") -> DataFrame:
    """Position of the first later row that is not below this one, else the number of rows."""
    held = df.withColumn("__was", F.lag(level).over(ordered(doc, pos))).withColumn("__n", F.count("*").over(Window.partitionBy(doc)))
    closed = held.filter(F.col("__was") >= F.col(level)).select(doc, F.explode(F.sequence(F.col(level), F.col("__was"))).alias("__key"), (1 - 2 * F.col(pos)).alias("__at"), F.col(pos).alias("__end"))
    rows = held.drop("__was").withColumn("__key", F.col(level) + 0).withColumn("__at", -2 * F.col(pos))
    found = as_of(rows, closed, [doc, "__key"], "__at", "__end", out=out)
    return found.withColumn(out, F.coalesce(out, "__n")).drop("__key", "__at", "__n")


def links(df: DataFrame, doc: str, pos: str, level: str) -> DataFrame:
    """parent, block_end, descendants, first_child, next_sibling, previous_sibling (positions or null)."""
    held = block_end(parent(df, doc, pos, level), doc, pos, level)
    held = held.withColumn("descendants", F.col("block_end") - F.col(pos) - 1)
    held = held.withColumn("first_child", F.when(F.col("descendants") > 0, F.col(pos) + 1))
    siblings = Window.partitionBy(doc, F.coalesce("parent", F.lit(-1)), level).orderBy(pos)
    return held.withColumn("next_sibling", F.lead(pos).over(siblings)).withColumn("previous_sibling", F.lag(pos).over(siblings))


def covered(df: DataFrame, doc: str, pos: str, chosen: Column, *, end: str = "block_end", out: str = "covered") -> DataFrame:
    """True for rows inside the block of an earlier chosen row. ``df`` has block ends; blocks nest, so the furthest end so far decides."""
    reach = F.max(F.when(chosen, F.col(end))).over(_before(doc, pos))
    return df.withColumn(out, F.coalesce(F.col(pos) < reach, F.lit(False)))


def visible(df: DataFrame, doc: str, pos: str, collapsed: Column, *, end: str = "block_end") -> DataFrame:
    """Rows that no collapsed row hides."""
    return covered(df, doc, pos, collapsed, end=end, out="__c").filter(~F.col("__c")).drop("__c")


def block_heads(df: DataFrame, doc: str, pos: str, chosen: Column, *, end: str = "block_end") -> DataFrame:
    """Chosen rows that no other chosen row covers."""
    return covered(df, doc, pos, chosen, end=end, out="__c").filter(chosen & ~F.col("__c")).drop("__c")


def in_blocks(df: DataFrame, doc: str, pos: str, chosen: Column, *, end: str = "block_end", out: str = "in_block") -> DataFrame:
    """True for chosen rows and all below them."""
    return covered(df, doc, pos, chosen, end=end, out="__c").withColumn(out, chosen | F.col("__c")).drop("__c")


def delete_blocks(df: DataFrame, doc: str, pos: str, chosen: Column, *, end: str = "block_end") -> DataFrame:
    """Without the chosen rows and all below them; positions are closed up."""
    left = in_blocks(df, doc, pos, chosen, end=end, out="__b").filter(~F.col("__b")).drop("__b")
    return left.withColumn(pos, F.row_number().over(ordered(doc, pos)).cast("long") - 1)


def delete_rows(df: DataFrame, doc: str, pos: str, level: str, chosen: Column) -> DataFrame:
    """Without the chosen rows only; what was below moves up by the number of deleted rows above it."""
    held = block_end(df.withColumn("__x", F.coalesce(chosen, F.lit(False))), doc, pos, level, out="__end")
    # a deleted row counts from behind itself to the end of its block
    marks = F.inline(F.array(F.struct((2 * F.col(pos) + 1).alias("__at"), F.lit(1).alias("__d")), F.struct((2 * F.col("__end") - 1).alias("__at"), F.lit(-1).alias("__d"))))
    steps = held.filter("__x").select(doc, marks)
    both = held.drop("__end").withColumn("__at", 2 * F.col(pos)).withColumn("__d", F.lit(0)).unionByName(steps, allowMissingColumns=True)
    above = F.sum("__d").over(ordered(doc, "__at").rowsBetween(Window.unboundedPreceding, 0))
    left = both.withColumn("__up", above).filter("NOT __x").withColumn(level, F.col(level) - F.col("__up")).drop("__x", "__at", "__d", "__up")
    return left.withColumn(pos, F.row_number().over(ordered(doc, pos)).cast("long") - 1)


def shift_pages(df: DataFrame, doc: str, pos: str, chosen: Column, delta: int, *, manual: str = "manual_page", shift: str = "section_shift", printed: str = "printed_page", end: str = "block_end") -> DataFrame:
    """Blocks of chosen rows move by ``delta``: a manual page moves itself, else the section shift does; rows without a page stay."""
    inside = in_blocks(df, doc, pos, chosen, end=end, out="__b")
    moved = F.when(F.col("__b") & F.col(manual).isNotNull(), F.col(manual) + delta).otherwise(F.col(manual))
    shifted = F.when(F.col("__b") & F.col(manual).isNull() & F.col(printed).isNotNull(), F.col(shift) + delta).otherwise(F.col(shift))
    return inside.withColumn(manual + "_new", moved).withColumn(shift + "_new", shifted).drop("__b")


def calibrate_from(df: DataFrame, pos: str, start: Column, delta: Column, *, follows: Column, shift: str = "section_shift") -> DataFrame:
    """From position ``start`` on, rows that follow the offset move by ``delta``."""
    return df.withColumn(shift, F.col(shift) + F.when((F.col(pos) >= start) & follows, delta).otherwise(0))


def calibrate_offset(physical: Column, printed: Column, shift: Column) -> Column:
    return physical - printed - shift


def differs(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of either side that the other has not as often; ``side`` names it."""
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
