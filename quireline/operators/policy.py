"""Refuse rather than guess: entries, offsets and headings of a document to one status and its reason.

Rules are columns over one row per document; the first that applies is the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed limits: entries with arabic pages, mapped entries, share of unsure entries, share of doubtful ones, confidence that is low.
LEAST_ENTRIES, LEAST_MAPPED, UNSURE_SHARE, DOUBTFUL_SHARE, LOW = 3, 3, 0.5, 0.15, 0.75


def doubtful(confidence: Column, physical: Column, style: Column, notes: Column, *, roman_left_out: bool = True) -> Column:
    """Why an entry needs a look: its first reason, or null. Roman pages that are left out on purpose need none."""
    exempt = (style == "roman") & physical.isNull() & F.lit(roman_left_out)
    return (
        F.when(exempt, None)
        .when(notes.contains("page order"), "order")
        .when(physical.isNull(), "no_page")
        .when(confidence < LOW, "low_confidence")
    )


def document_status(entries: DataFrame, offsets: DataFrame, doc: str = "doc_id", *, last_page: str | None = None) -> DataFrame:
    """``entries``: rows of the parse with offset 0; ``offsets``: rows of the vote (status, offset, best_guess). Per document: entries, low,
    doubtful, mapped, status (ok or refused), reason."""
    held = entries.join(offsets.select(doc, F.col("status").alias("vote"), "offset", *([last_page] if last_page else [])), doc, "left")
    physical = F.when(F.col("page_style") == "arabic", F.col("printed_page") + F.col("offset"))
    held = held.withColumn("__physical", physical).withColumn("__why", doubtful(F.col("confidence"), physical, F.col("page_style"), F.col("notes")))
    beyond = F.count_if(F.col("__physical") > F.col(last_page)) if last_page else F.lit(0)
    counts = held.groupBy(doc).agg(
        F.count("*").alias("entries"),
        F.count_if((F.col("page_style") == "arabic") & ~F.col("inherited")).alias("arabic"),
        F.count_if(F.col("confidence") < LOW).alias("low"),
        F.count_if(F.col("__why").isNotNull()).alias("doubtful"),
        F.count_if(F.col("__physical") >= 1).alias("mapped"),
        beyond.alias("beyond"),
        F.first("vote", ignorenulls=True).alias("vote"),
    )
    allowed = F.greatest(F.lit(1), F.floor(F.col("entries") * DOUBTFUL_SHARE))
    reason = (
        F.when(F.col("arabic") < LEAST_ENTRIES, "too few entries with pages")
        .when(F.col("low") > UNSURE_SHARE * F.col("entries"), "most entries are unsure")
        .when(F.coalesce("vote", F.lit("unreadable")) != "ok", F.concat(F.lit("offset: "), F.coalesce("vote", F.lit("unreadable"))))
        .when(F.col("beyond") * 2 > F.col("entries"), "most entries lie beyond the last page")
        .when(F.col("doubtful") > allowed, "too many doubtful entries")
        .when(F.col("mapped") < LEAST_MAPPED, "too few mapped entries")
    )
    return counts.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "ok").otherwise("refused")).drop("vote")


def row_issues(df: DataFrame, doc: str, pos: str, *, title: str, page: str, pages: Column) -> DataFrame:
    """``issues`` of draft rows: empty title, no page, page out of range, page before the one above, hash in front of a top title."""
    from pyspark.sql import Window

    before = F.last(F.col(page), ignorenulls=True).over(Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    found = F.array(
        F.when(F.trim(F.coalesce(title, F.lit(""))) == "", "empty_title"),
        F.when(F.col(page).isNull(), "no_page"),
        F.when((F.col(page) < 1) | (F.col(page) > pages), "out_of_range"),
        F.when(F.col(page) < before, "before_previous"),
        F.when(F.col(title).startswith("#") & (F.col("level") == 0), "leading_hash"),
    )
    return df.withColumn("issues", F.filter(found, lambda x: x.isNotNull()))


def row_status(issues: Column, confirmed: Column, doubts: Column) -> Column:
    """error, confirmed, doubtful or ok, in this order."""
    errors = F.exists(issues, lambda i: i.isin("empty_title", "no_page", "out_of_range"))
    return F.when(errors, "error").when(confirmed, "confirmed").when((F.size(doubts) > 0) | (F.size(issues) > 0), "doubtful").otherwise("ok")


def write_readiness(rows: DataFrame, doc: str) -> DataFrame:
    """Counts that decide whether a draft may be written: errors, unconfirmed doubtful rows, order warnings."""
    return rows.groupBy(doc).agg(
        F.count_if(F.col("status") == "error").alias("blockers"),
        F.count_if(F.col("status") == "doubtful").alias("unconfirmed"),
        F.count_if(F.array_contains("issues", "before_previous")).alias("order_warnings"),
    ).withColumn("ready", F.col("blockers") == 0)
