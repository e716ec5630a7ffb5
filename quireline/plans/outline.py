"""The flagship: lines of documents to headings, levels and a summary per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireline.functions import text as T
from quireline.operators import scans


def doc_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a rank from their length stand for headings; ranks become levels, and each document is summed up."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lines = T.lines(docs, "text", keep=("doc_id",)).filter(F.trim("line") != "")
    headed = lines.withColumn("raw_level", (F.length("line") % 6).cast("int")).withColumn("page_text", T.trailing_number(F.col("line")))
    levels = scans.level_clamp(headed, "doc_id", "line_no", "raw_level")
    return levels.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"),
        F.max("level").cast("long").alias("max_level"),
        F.sum("level").cast("long").alias("sum_level"),
        F.count_if(F.col("page_text") != "").alias("n_paged"),
    )


DOC_OUTLINE = r"""
WITH pieces AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS l FROM documents)
), kept AS (
  SELECT doc_id, line_no, line, greatest(0, length(line) % 6) AS raw, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS i FROM pieces WHERE trim(line, ' ') <> ''
), levels AS (
  SELECT doc_id, line, i + least(0, min(raw - i) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS level FROM kept
)
SELECT doc_id, count(*) AS n_lines, max(level)::BIGINT AS max_level, sum(level)::BIGINT AS sum_level,
       count(*) FILTER (regexp_extract(line, '([0-9]{1,4})[ .,;:]*$', 1) <> '') AS n_paged
FROM levels GROUP BY doc_id
"""

QUERIES = {"doc_outline": doc_outline}
ORACLES = {"doc_outline": DOC_OUTLINE}
