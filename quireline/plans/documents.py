"""Queries on whole outlines: files of every format, printed tables of contents, PDF updates, decisions, sessions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quireline.operators import parse, policy, votes
from quireline.plans.ordered import _outline
from quireline.sources import formats
from quireline.streaming import flows


def _drafts(spark, sf_dir):
    rows = _outline(spark, sf_dir).select("conv_id", "pos", F.concat(F.lit("Entry "), F.col("turn"), F.when(F.col("turn") % 4 == 3, F.lit("  &\t<b>")).otherwise(F.lit(""))).alias("title"), "level", (F.col("turn") * 3 + 1).alias("page"))
    return rows


def toc_text_sink(spark, sf_dir):
    return formats.text_sink(_drafts(spark, sf_dir), "conv_id", "pos")


def file_sinks(spark, sf_dir):
    """Each outline written in every format and read again: equal or not."""
    drafts = _drafts(spark, sf_dir)
    wanted = drafts.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"), F.col("level").cast("int").alias("level"), F.col("page").cast("int").alias("page")))), lambda r: F.struct(r["title"].alias("title"), r["level"].alias("level"), r["page"].alias("page"))).alias("wanted"))
    out = None
    for kind in ("text", "json", "opml", "xml"):
        made = formats.file_sink(drafts, "conv_id", "pos", kind).select("conv_id", formats.read_column(F.encode("text", "UTF-8"), kind=kind).alias("o"))
        got = F.transform("o.items", lambda r: F.struct(r["title"].alias("title"), r["level"].alias("level"), r["page"].alias("page")))
        rows = made.join(wanted, "conv_id").select("conv_id", F.lit(kind).alias("format"), (got == F.col("wanted")).alias("equal"))
        out = rows if out is None else out.unionByName(rows)
    return out


def space_levels(spark, sf_dir):
    lines = _outline(spark, sf_dir).select("conv_id", "pos", F.concat(F.repeat(F.lit(" "), (F.col("raw") * 2).cast("int")), F.lit("t")).alias("line"))
    return formats.space_levels(lines, "conv_id", "pos", "line").select("conv_id", "pos", F.col("level").cast("long").alias("level"))


def _toc_lines(spark, sf_dir):
    """A printed table of contents for each customer's orders: chapters with sections, wrapped titles, front matter, a misread page here and there."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), "o_orderkey")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("o_orderkey"))
    rows = orders.withColumn("n", n).withColumn("chapter", F.floor((F.col("n") - 1) / 4) + 1).withColumn("part", (F.col("n") - 1) % 4)
    page = (F.col("n") * 7).cast("string")
    shown = F.when(F.col("o_orderkey") % 11 == 0, F.replace(page, F.lit("1"), F.lit("l"))).otherwise(page)
    head = F.concat(F.lit("Chapter "), F.col("chapter"), F.lit(" Matters of order "), F.col("o_orderkey"), F.lit(" and more ........ "), shown)
    section = F.concat(F.lit("    "), F.col("chapter"), F.lit("."), F.col("part"), F.lit(" Details and "), F.when(F.col("o_orderkey") % 5 == 0, F.lit("\n      the rest of them")).otherwise(F.lit("figures")), F.lit(" ..... "), shown)
    line = F.when(F.col("part") == 0, head).otherwise(section)
    lines = rows.select("doc_id", F.col("n").alias("entry"), F.posexplode(F.split(line, "\n")).alias("k", "text"))
    first = orders.select("doc_id").distinct().select("doc_id", F.lit(0).alias("entry"), F.posexplode(F.array(F.lit("Contents"), F.lit("Preface ...... iv"))).alias("k", "text"))
    both = lines.unionByName(first)
    return both.select("doc_id", (F.col("entry") * 2 + F.col("k")).alias("line_no"), "text")


def printed_toc(spark, sf_dir):
    """What the parse of those lines finds."""
    found = parse.printed_toc(_toc_lines(spark, sf_dir), "doc_id", line_no="line_no", text="text")
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "title", F.col("level").cast("long").alias("level"), "kind", "page_style", F.col("printed_page").cast("long").alias("printed_page"), "inherited")


def outline_policy(spark, sf_dir):
    """Which documents' outlines may be written, with the reason where not."""
    lines = _toc_lines(spark, sf_dir)
    entries = parse.printed_toc(lines, "doc_id", line_no="line_no", text="text")
    docs = lines.select("doc_id").distinct()
    page = F.explode(F.sequence(F.lit(10), F.lit(40), F.lit(3)))
    samples = docs.select("doc_id", page.alias("page")).withColumn("printed", F.when((F.col("page") + F.col("doc_id")) % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array((F.col("page") - 6).cast("bigint"))))
    decided = votes.offset_decision(samples.withColumn("page", F.col("page").cast("bigint")), "doc_id").withColumn("last_page", F.lit(400))
    return policy.document_status(entries, decided, "doc_id", last_page="last_page")


def draft_issues(spark, sf_dir):
    drafts = _drafts(spark, sf_dir).withColumn("page", F.when(F.col("pos") % 5 == 4, F.lit(None)).when(F.col("pos") % 3 == 2, F.col("page") - 5).otherwise(F.col("page")))
    held = policy.row_issues(drafts, "conv_id", "pos", title="title", page="page", pages=F.lit(16))
    held = held.withColumn("status", policy.row_status(F.col("issues"), F.col("pos") % 7 == 2, F.array().cast("array<string>")))
    return held.select("conv_id", "pos", F.array_join("issues", ",").alias("issues"), "status")


def pdf_roundtrip(spark, sf_dir):
    """A blank PDF for each conversation gets its outline and is read again."""
    from quireline.sources.pdf import tables
    from quireline.sources.pdf.update import blank_document

    drafts = _drafts(spark, sf_dir).withColumn("title", F.trim(F.regexp_replace("title", r"\s+", " ")))
    items = drafts.groupBy("conv_id").agg(F.max("page").alias("pages"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "title", "level", "page"))), lambda r: F.struct(r["title"].alias("title"), r["level"].alias("level"), r["page"].alias("page"))).alias("items"))

    @F.pandas_udf("binary")
    def blank(pages: pd.Series) -> pd.Series:
        return pages.map(lambda n: blank_document(int(n)))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = items.repartition(tasks, F.xxhash64("conv_id")).select(F.col("conv_id").cast("string").alias("path"), blank("pages").alias("content"), "items", F.lit(0).alias("offset"))
    made = tables.updated(files).filter("problem IS NULL")
    return tables.outlines(made).select(F.col("path").cast("long").alias("conv_id"), F.col("pos").cast("long").alias("pos"), "title", F.col("level").cast("long").alias("level"), F.col("page_index").cast("long").alias("page_index"))


def event_sessions(spark, sf_dir):
    """Sessions of a user: events less than an hour apart. The streams' own function, over all events at once."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return flows.sessions(events, "ts", "user_id", gap="1 hour").select("user_id", F.unix_timestamp("start").alias("start"), "n")


def event_windows(spark, sf_dir):
    """Events of a day by type, likewise."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return flows.tumbling_counts(events, "ts", "event_type", width="1 day").select("event_type", F.unix_timestamp("start").alias("start"), "n")


QUERIES = {f.__name__: f for f in (toc_text_sink, file_sinks, space_levels, printed_toc, outline_policy, draft_issues, pdf_roundtrip, event_sessions, event_windows)}

_DRAFTS = """
placed AS (SELECT conv_id, turn, length(text) % 6 AS raw, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
outline AS (SELECT conv_id, turn, raw, pos, pos + least(0, min(raw - pos) OVER (PARTITION BY conv_id ORDER BY pos)) AS level FROM placed),
drafts AS (SELECT conv_id, pos, 'Entry ' || turn || CASE WHEN turn % 4 = 3 THEN ' & <b>' ELSE '' END AS title, level, turn * 3 + 1 AS page FROM outline)"""

ORACLES = {
    "toc_text_sink": f"WITH {_DRAFTS} SELECT conv_id, string_agg(repeat(chr(9), level::INT) || title || chr(9) || page || chr(10), '' ORDER BY pos) AS text FROM drafts GROUP BY 1",
    "file_sinks": "SELECT DISTINCT conv_id, format, true AS equal FROM conversations, (VALUES ('text'), ('json'), ('opml'), ('xml')) f(format)",
    "space_levels": f"WITH {_DRAFTS} SELECT conv_id, pos, least(5, dense_rank() OVER (PARTITION BY conv_id ORDER BY raw) - 1) AS level FROM outline",
    "printed_toc": """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), p AS (SELECT *, (n - 1) // 4 + 1 AS chapter, (n - 1) % 4 AS part FROM o)
SELECT doc_id, n AS pos, CASE WHEN part = 0 THEN 'Chapter ' || chapter || ' Matters of order ' || o_orderkey || ' and more' ELSE chapter || '.' || part || ' Details and ' || CASE WHEN o_orderkey % 5 = 0 THEN 'the rest of them' ELSE 'figures' END END AS title,
  CASE WHEN part = 0 THEN 0 ELSE 1 END::BIGINT AS level, CASE WHEN part = 0 THEN 'chapter' ELSE 'dotted' END AS kind, 'arabic' AS page_style, n * 7 AS printed_page, false AS inherited FROM p
UNION ALL SELECT DISTINCT doc_id, 0, 'Preface', 0, 'matter', 'roman', 4, false FROM o""",
    "outline_policy": """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
u AS (SELECT doc_id, count(*) AS n, count(*) FILTER (o_orderkey % 11 = 0 AND contains((n * 7)::VARCHAR, '1')) AS unsure FROM o GROUP BY 1),
c AS (SELECT doc_id, n + 1 AS entries, n AS arabic, unsure + 1 AS low, unsure AS doubtful, n AS mapped, 0::BIGINT AS beyond FROM u)
SELECT *, CASE WHEN arabic < 3 THEN 'too few entries with pages' WHEN low > 0.5 * entries THEN 'most entries are unsure' WHEN doubtful > greatest(1, floor(entries * 0.15::DOUBLE)) THEN 'too many doubtful entries' END AS reason,
  CASE WHEN reason IS NULL THEN 'ok' ELSE 'refused' END AS status FROM c""",
    "draft_issues": f"""WITH {_DRAFTS}, p AS (SELECT conv_id, pos, CASE WHEN pos % 5 = 4 THEN NULL WHEN pos % 3 = 2 THEN page - 5 ELSE page END AS page FROM drafts),
b AS (SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
i AS (SELECT conv_id, pos, concat_ws(',', CASE WHEN page IS NULL THEN 'no_page' END, CASE WHEN page < 1 OR page > 16 THEN 'out_of_range' END, CASE WHEN page < before THEN 'before_previous' END) AS issues FROM b)
SELECT conv_id, pos, issues, CASE WHEN issues LIKE '%no_page%' OR issues LIKE '%out_of_range%' THEN 'error' WHEN pos % 7 = 2 THEN 'confirmed' WHEN issues <> '' THEN 'doubtful' ELSE 'ok' END AS status FROM i""",
    "pdf_roundtrip": f"WITH {_DRAFTS} SELECT conv_id, pos, title, level, page - 1 AS page_index FROM drafts",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "event_windows": "SELECT event_type, epoch(date_trunc('day', ts))::BIGINT AS start, count(*) AS n FROM events GROUP BY 1, 2",
}
