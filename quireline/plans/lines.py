"""Queries on the lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireline.functions import text as T

_LINES = r"""
pieces AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS l FROM documents)
)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return T.lines(docs, "text", keep=("doc_id",)).withColumn("line_no", F.col("line_no").cast("long"))


def doc_lines(spark, sf_dir):
    return _lines(spark, sf_dir)


def doc_trailing_page(spark, sf_dir):
    held = T.entry_lines(_lines(spark, sf_dir), "line")
    return held.select("doc_id", "line_no", T.trailing_number(F.col("line")).alias("page")).filter("page <> ''")


def leader_strip(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", T.strip_trailing_leaders(F.col("line")).alias("stripped"))


def fullwidth_fold(spark, sf_dir):
    wide = F.translate("line", "abc 123", "ａｂｃ　１２３")
    return _lines(spark, sf_dir).select("doc_id", "line_no", T.half_width(wide).alias("folded"), T.has_digit(wide).alias("has_digit"))


def display_width(spark, sf_dir):
    mixed = F.translate("line", "aeo", "中文字")
    return _lines(spark, sf_dir).select("doc_id", "line_no", T.display_width(mixed).cast("long").alias("width"), T.has_cjk(mixed).alias("has_cjk"))


def indent_measure(spark, sf_dir):
    indented = F.concat(F.substring(F.lit("\t 　 \t"), 1, (F.col("line_no") % 6).cast("int")), F.col("line"))
    return _lines(spark, sf_dir).select("doc_id", "line_no", T.measure_indent(indented).cast("long").alias("indent"))


def one_line_title(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.length(T.one_line(F.col("text"))).cast("long").alias("chars"), F.md5(T.one_line(F.col("text"))).alias("digest"))


def repeat_header_filter(spark, sf_dir):
    """Lines that occur at least twice in a document, with their count."""
    return T.repeated_lines(_lines(spark, sf_dir), "doc_id", "line", "line_no")


def sanity_penalties(spark, sf_dir):
    """Confidence of a line as a title: halved without letters, 0.6 for a single character."""
    kept = _lines(spark, sf_dir).filter("trim(line) <> ''")
    return kept.select("doc_id", "line_no", F.round(T.title_confidence(F.trim("line")), 2).alias("confidence"))


def page_specs(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    low = F.col("o_orderkey") % 7 + 1
    spec = F.concat(low, F.lit("-"), low + F.col("o_custkey") % 4, F.lit(", "), (F.col("o_custkey") % 9 + 1), F.lit("，"), (F.col("o_orderkey") % 3 + 9), F.lit("-"))
    pages = T.page_spec(spec, F.lit(12))
    return orders.select("o_orderkey", F.array_join(pages, ",").alias("pages"), F.size(pages).cast("long").alias("n_pages"))


def heading_kind(spark, sf_dir):
    """Kind of the numbering in front of a turn's first line, by pattern."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    first = F.substring_index("text", "\n", 1)
    head = F.element_at(F.array(F.lit("Chapter 4 "), F.lit("Part IV "), F.lit("3.2 "), F.lit("12 "), F.lit("Appendix B "), F.lit("(3) "), F.lit("Preface"), F.lit("")), (F.col("turn") % 8 + 1).cast("int"))
    line = F.concat(head, first)
    kind = (
        F.when(line.rlike("^(?i)(chapter|lecture|lesson) +([0-9]+|[ivxlcdm]+)( |$)"), "chapter")
        .when(line.rlike("^(?i)(part|book|volume|unit) +([0-9]+|[ivxlcdm]+)( |$)"), "part")
        .when(line.rlike("^(?i)(appendix|annex) +[a-z0-9]( |$)"), "appendix")
        .when(line.rlike("^[0-9]+([.][0-9]+)+"), "dotted")
        .when(line.rlike("^[0-9]+ "), "arabic")
        .when(line.rlike("^[(][0-9]+[)]"), "parenthesised")
        .when(line.rlike("^(?i)(preface|foreword|index|glossary|references)"), "matter")
        .otherwise("none")
    )
    return turns.select("conv_id", "turn", kind.alias("kind"))


def roman_lookup(spark, sf_dir):
    """Numbers 1 to 3999 as Roman numerals and back, for the quantities of line items."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.floor(F.col("l_extendedprice") % 3999 + 1).cast("int").alias("n")).groupBy("n").count()
    numeral = T.roman_string(F.col("n"))
    return items.select(F.col("n").cast("long").alias("n"), F.col("count").alias("items"), numeral.alias("numeral"), T.roman_value(numeral).cast("long").alias("value"))


def html_outline(spark, sf_dir):
    """Headings h1 to h6 of pages as rows with clamped levels."""
    from quireline.operators.scans import level_clamp

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = F.regexp_extract_all("html", F.lit("<h([1-6])[^>]*>"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "tag")).withColumn("raw", F.col("tag").cast("int") - 1)
    return level_clamp(rows, "page_id", "pos", "raw").select("page_id", F.col("pos").cast("long").alias("pos"), F.col("tag").cast("long").alias("tag"), F.col("level").cast("long").alias("level"))


def json_props(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def index_lines(spark, sf_dir):
    held = _lines(spark, sf_dir).withColumn("probe", F.concat(F.col("line"), F.when(F.col("line_no") % 3 == 0, F.lit(" 12, 15, 20-22")).otherwise(F.lit(" 7"))))
    return held.select("doc_id", "line_no", T.is_index_line(F.col("probe")).alias("is_index"))


_CLASS = "[ \\t\\n\\x0B\\f\\r　:：,，;；.．·•…‥・∙⋯‧_\\-—–─=~]"

QUERIES = {f.__name__: f for f in (doc_lines, doc_trailing_page, leader_strip, fullwidth_fold, display_width, indent_measure, one_line_title, repeat_header_filter, sanity_penalties, page_specs, heading_kind, roman_lookup, html_outline, json_props, index_lines)}

ORACLES = {
    "doc_lines": f"WITH {_LINES} SELECT doc_id, line_no, line FROM pieces",
    "doc_trailing_page": f"WITH {_LINES} SELECT * FROM (SELECT doc_id, line_no, regexp_extract(line, '([0-9]{{1,4}})[ .,;:]*$', 1) AS page FROM pieces WHERE NOT starts_with(line, '#') AND regexp_matches(line, '\\S')) WHERE page <> ''",
    "leader_strip": f"WITH {_LINES} SELECT doc_id, line_no, regexp_replace(line, '{_CLASS}+$', '') AS stripped FROM pieces",
    "fullwidth_fold": f"WITH {_LINES} SELECT doc_id, line_no, line AS folded, regexp_matches(line, '[0-9]|[123]') AS has_digit FROM pieces",
    "display_width": f"WITH {_LINES} SELECT doc_id, line_no, length(line) + length(regexp_replace(line, '[^aeo]', '', 'g')) AS width, regexp_matches(line, '[aeo]') AS has_cjk FROM pieces",
    "indent_measure": rf"""WITH {_LINES}, lead AS (SELECT doc_id, line_no, regexp_extract(substr(chr(9) || ' ' || chr(12288) || ' ' || chr(9), 1, (line_no % 6)::INT) || line, '^[\t\n\x0B\f\r 　]*') AS s FROM pieces)
SELECT doc_id, line_no, length(s) + 3 * (length(s) - length(replace(s, chr(9), ''))) + (length(s) - length(replace(s, chr(12288), ''))) AS indent FROM lead""",
    "one_line_title": r"""SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(text, '[\x00-\x20\x7F\x{85}\x{2028}\x{2029}]+', ' ', 'g'), ' ') AS t FROM documents)""",
    "repeat_header_filter": f"WITH {_LINES} SELECT doc_id, line, count(*) AS n, min(line_no) AS first_line FROM pieces WHERE trim(line, ' ') <> '' GROUP BY doc_id, line HAVING count(*) >= 2",
    "sanity_penalties": rf"WITH {_LINES} SELECT doc_id, line_no, round((CASE WHEN regexp_matches(line, '\p{{L}}') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) * (CASE WHEN length(trim(line, ' ')) = 1 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END), 2) AS confidence FROM pieces WHERE trim(line, ' ') <> ''",
    "page_specs": """WITH p AS (SELECT o_orderkey, list_concat(list_concat(range(o_orderkey % 7 + 1, o_orderkey % 7 + 1 + o_custkey % 4 + 1), [o_custkey % 9 + 1]), range(o_orderkey % 3 + 9, 13)) AS l FROM orders),
d AS (SELECT o_orderkey, list_filter(l, lambda x, i: list_position(l, x) = i) AS u FROM p) SELECT o_orderkey, array_to_string(list_transform(u, lambda x: x::VARCHAR), ',') AS pages, len(u) AS n_pages FROM d""",
    "heading_kind": r"""WITH t AS (SELECT conv_id, turn, ['Chapter 4 ', 'Part IV ', '3.2 ', '12 ', 'Appendix B ', '(3) ', 'Preface', ''][turn % 8 + 1] || split_part(text, chr(10), 1) AS line FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(line, '^(?i)(chapter|lecture|lesson) +([0-9]+|[ivxlcdm]+)( |$)') THEN 'chapter' WHEN regexp_matches(line, '^(?i)(part|book|volume|unit) +([0-9]+|[ivxlcdm]+)( |$)') THEN 'part'
WHEN regexp_matches(line, '^(?i)(appendix|annex) +[a-z0-9]( |$)') THEN 'appendix' WHEN regexp_matches(line, '^[0-9]+([.][0-9]+)+') THEN 'dotted' WHEN regexp_matches(line, '^[0-9]+ ') THEN 'arabic'
WHEN regexp_matches(line, '^[(][0-9]+[)]') THEN 'parenthesised' WHEN regexp_matches(line, '^(?i)(preface|foreword|index|glossary|references)') THEN 'matter' ELSE 'none' END AS kind FROM t""",
    "roman_lookup": """SELECT n, items, ['','m','mm','mmm'][n // 1000 + 1] || ['','c','cc','ccc','cd','d','dc','dcc','dccc','cm'][n // 100 % 10 + 1] || ['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'][n // 10 % 10 + 1]
|| ['','i','ii','iii','iv','v','vi','vii','viii','ix'][n % 10 + 1] AS numeral, n AS value FROM (SELECT floor(l_extendedprice % 3999 + 1)::BIGINT AS n, count(*) AS items FROM lineitem GROUP BY 1)""",
    "html_outline": """WITH h AS (SELECT page_id, unnest(l)::BIGINT AS tag, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '<h([1-6])[^>]*>', 1) AS l FROM pages))
SELECT page_id, pos, tag, pos + least(0, min(tag - 1 - pos) OVER (PARTITION BY page_id ORDER BY pos)) AS level FROM h""",
    "json_props": "SELECT event_type, (props->>'$.k')::BIGINT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "index_lines": f"WITH {_LINES} SELECT doc_id, line_no, line_no % 3 = 0 AS is_index FROM pieces",
}
