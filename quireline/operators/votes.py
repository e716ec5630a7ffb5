"""Votes for the offset between printed and physical pages, with the rules by which an unsure result is refused.

Samples are rows of (document, page, printed numbers, those that stand alone). Pages vote, not readings: each page votes once for each
distinct ``page - printed``. All counts are aggregates with a map-side part; per document a handful of rows is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireline.functions.text import is_digit_slip

#: Agreeing pages, their share of all samples, and how often the runner-up has to fit into the winner.
LEAST_AGREEING, LEAST_SHARE, LEAD = 6, 0.4, 3


def offset_votes(samples: DataFrame, doc: str = "doc_id", *, page: str = "page", printed: str = "printed", standalone: str | None = None) -> DataFrame:
    """doc, offset, votes, alone (votes from numbers that stand alone), rank."""
    own = F.array_distinct(F.transform(printed, lambda p: F.col(page) - p))
    lone = F.array_distinct(F.transform(standalone, lambda p: F.col(page) - p)) if standalone else F.array().cast("array<bigint>")
    each = samples.select(doc, lone.alias("__lone"), F.explode(own).alias("offset"))
    counts = each.groupBy(doc, "offset").agg(F.count("*").alias("votes"), F.count_if(F.array_contains("__lone", F.col("offset"))).alias("alone"))
    order = Window.partitionBy(doc).orderBy(F.desc("votes"), F.desc("alone"), F.abs("offset"), F.desc("offset"))
    return counts.withColumn("rank", F.row_number().over(order))


def runner_up(samples: DataFrame, votes: DataFrame, doc: str = "doc_id", *, page: str = "page", printed: str = "printed") -> DataFrame:
    """doc, offset, runner_offset, runner_votes: the most voted other offset, where votes that are digit slips of the expected number on a page
    between agreeing ones do not count. Ties go to the smaller offset."""
    best = votes.filter("rank = 1").select(doc, F.col("offset").alias("best"))
    held = samples.select(doc, page, F.array_distinct(printed).alias("printed")).join(best, doc)
    agrees = F.array_contains("printed", F.col(page) - F.col("best"))
    span = Window.partitionBy(doc)
    held = held.withColumn("low", F.min(F.when(agrees, F.col(page))).over(span)).withColumn("high", F.max(F.when(agrees, F.col(page))).over(span))
    each = held.select(doc, "best", page, "low", "high", F.explode("printed").alias("read")).filter(F.col(page) - F.col("read") != F.col("best"))
    slip = is_digit_slip(F.col("read"), F.col(page) - F.col("best")) & (F.col(page) > F.col("low")) & (F.col(page) < F.col("high"))
    counted = each.filter(~slip).select(doc, "best", page, (F.col(page) - F.col("read")).alias("other")).distinct().groupBy(doc, "best", "other").count()
    top = F.max_by(F.struct("other", "count"), F.struct(F.col("count"), -F.col("other")))
    return counted.groupBy(doc, F.col("best").alias("offset")).agg(top.alias("t")).select(doc, "offset", F.col("t.other").alias("runner_offset"), F.col("t.count").alias("runner_votes"))


def edge_run(samples: DataFrame, votes: DataFrame, doc: str = "doc_id", *, page: str = "page", printed: str = "printed", from_end: bool = False) -> DataFrame:
    """doc, run_offset, run_pages, run_last: pages with readings, from one end on, that share an offset other than the winner; two at least.
    Of several shared offsets the nearest to the winner counts, then the smaller."""
    best = votes.filter("rank = 1").select(doc, F.col("offset").alias("best"))
    held = samples.filter(F.size(printed) > 0).join(best, doc)
    offsets = F.array_except(F.transform(printed, lambda p: (F.col(page) - p).cast("bigint")), F.array("best"))
    agrees = F.array_contains(printed, F.col(page) - F.col("best"))
    rows = F.sort_array(F.collect_list(F.struct(F.col(page).alias("page"), F.when(agrees, F.array().cast("array<bigint>")).otherwise(offsets).alias("offsets"))), asc=not from_end)
    start = F.struct(F.lit(None).cast("array<bigint>").alias("left"), F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("last"), F.lit(False).alias("over"))

    def step(acc: Column, row: Column) -> Column:
        left = F.when(acc["left"].isNull(), row["offsets"]).otherwise(F.array_intersect(acc["left"], row["offsets"]))
        stop = acc["over"] | (F.size(left) == 0)
        return F.when(stop, F.struct(acc["left"].alias("left"), acc["n"].alias("n"), acc["last"].alias("last"), F.lit(True).alias("over"))).otherwise(F.struct(left.alias("left"), (acc["n"] + 1).alias("n"), row["page"].cast("bigint").alias("last"), F.lit(False).alias("over")))

    folded = held.groupBy(doc, "best").agg(rows.alias("rows")).select(doc, "best", F.aggregate("rows", start, step).alias("r")).filter("r.n >= 2")
    nearest = F.array_min(F.transform("r.left", lambda o: F.struct(F.abs(o - F.col("best")).alias("d"), o.alias("o"))))
    return folded.select(doc, nearest["o"].alias("run_offset"), F.col("r.n").cast("long").alias("run_pages"), F.col("r.last").alias("run_last"))


def offset_decision(samples: DataFrame, doc: str = "doc_id", *, page: str = "page", printed: str = "printed", standalone: str | None = None) -> DataFrame:
    """One row per document: best_guess, offset (null if refused), agreeing, samples, readable, confidence, runner_offset, runner_votes, late_run, status."""
    votes = offset_votes(samples, doc, page=page, printed=printed, standalone=standalone)
    totals = samples.groupBy(doc).agg(F.count("*").alias("samples"), F.count_if(F.size(printed) > 0).alias("readable"))
    best = votes.filter("rank = 1").select(doc, F.col("offset").alias("best_guess"), F.col("votes").alias("agreeing"))
    other = runner_up(samples, votes, doc, page=page, printed=printed).drop("offset")
    late = edge_run(samples, votes, doc, page=page, printed=printed, from_end=True).select(doc, F.col("run_offset").alias("late_run"))
    held = totals.join(best, doc, "left").join(other, doc, "left").join(late, doc, "left").fillna(0, ["agreeing", "runner_votes"])
    held = held.withColumn("confidence", F.round(F.col("agreeing") / F.col("samples"), 6))
    status = (
        F.when(F.col("best_guess").isNull(), "unreadable")
        .when((F.col("agreeing") < LEAST_AGREEING) | (F.col("confidence") < LEAST_SHARE), "low_confidence")
        .when((F.col("runner_votes") * LEAD > F.col("agreeing")) | F.col("late_run").isNotNull(), "conflict")
        .otherwise("ok")
    )
    return held.withColumn("status", status).withColumn("offset", F.when(F.col("status") == "ok", F.col("best_guess")))


def roman_vote(samples: DataFrame, doc: str = "doc_id", *, page: str = "page", printed: str = "printed") -> DataFrame:
    """doc, roman_offset, votes: at least two pages agree, twice as many as for any other offset, and the offset is not negative."""
    votes = offset_votes(samples, doc, page=page, printed=printed).filter("offset >= 0")
    w = Window.partitionBy(doc).orderBy(F.desc("votes"), "offset")
    ranked = votes.withColumn("place", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("votes").over(w), F.lit(0)))
    return ranked.filter("place = 1 AND votes >= 2 AND votes >= 2 * next").select(doc, F.col("offset").alias("roman_offset"), "votes")


def sample_positions(count: Column, wanted: int) -> Column:
    """``wanted`` positions spread over 1 to ``count``, without a twentieth at either end; all of them if there are no more."""
    skip = F.floor(count / 20).cast("int")
    low, span = skip + 1, (count - 2 * skip).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda k: (low + F.floor(k * (span - 1) / F.lit(float(wanted - 1)) + 0.5)).cast("int"))
    return F.when(count <= 0, F.array().cast("array<int>")).when(span <= wanted, F.sequence(low, low + span - 1)).otherwise(F.array_distinct(spread))


def spread_pick(df: DataFrame, doc: str, order, picks: int = 4) -> DataFrame:
    """The rows at positions k (n - 1) / (picks - 1), rounded down; all rows if there are no more than ``picks``."""
    w = Window.partitionBy(doc)
    held = df.withColumn("__i", F.row_number().over(w.orderBy(*order if isinstance(order, list) else [order])) - 1).withColumn("__n", F.count("*").over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(picks - 1)), lambda k: F.floor(k * (F.col("__n") - 1) / F.lit(picks - 1)).cast("long"))
    return held.filter((F.col("__n") <= picks) | F.array_contains(wanted, F.col("__i").cast("long"))).drop("__i", "__n")
