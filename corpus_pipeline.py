"""Training corpus pipeline: language, near copies, benchmark passages, tokens.

Each stage is (name, function of (spark, docs, folder of tables)); what it returns is written as Parquet and read as the next one's docs. All
but the last return the columns of ``documents``; the last returns doc_id and the digests of ids and decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireline.llm import bpe_stream, decontaminate, jaccard_join, language_id
from quireline.llm.columns import named
from quireline.llm.queries import table, vocabulary_path
from quireline.llm.storage import written

#: Words of a shingle and the percentage of similarity from which documents are near copies; a text whose best cosine with a language is not
#: above the score is in none of the languages.
SHINGLE_WORDS, SIMILARITY, SCORE = 5, 80, 0.0


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one, ``row``, where their names clash with nothing."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("0"), *(named(c) for c in docs.columns if c not in ("doc_id", "text"))).alias("row"))


def _together(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return rows.select(*(named(c) if c in ("doc_id", "text") else F.col("row").getField(c).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined go: null text, no letter in it, or no likeness to any language learnt from ``docs``. If nothing
    can be learnt (no row has a language), all documents with a letter stay."""
    profiles = language_id.train(docs)
    if not profiles.names:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    judged = language_id.predict(_apart(docs), profiles, keep=("doc_id", "text", "row"))
    return _together(judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") > SCORE)), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that near copies connect, the one with the smallest doc_id stays (a null one counts as largest); of several with that doc_id
    the one with the smallest hash, and of rows equal in doc_id and text one. Rows without words are linked with nothing and stay."""
    found = jaccard_join.jaccard_components(docs, k=SHINGLE_WORDS, threshold=SIMILARITY).filter("group_id IS NOT NULL")
    rows = written(found.select("doc_id", "row_hash", "group_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("first")), "near-copies-rows")
    first = rows.filter("first").groupBy("group_id", "doc_id", "row_hash").agg(F.count("*").alias("copies"))
    least = first.groupBy("group_id").agg(F.min("row_hash").alias("least"))
    ranked = first.join(least, "group_id").select("doc_id", "row_hash", F.when(F.col("row_hash") > F.col("least"), "gone").when(F.col("copies") > 1, "again").alias("mark")).filter("mark IS NOT NULL")
    gone = rows.filter("NOT first").select("doc_id", "row_hash").distinct().withColumn("mark", F.lit("gone"))
    marks = written(gone.unionByName(ranked).select(F.col("doc_id").alias("m"), F.col("row_hash").alias("h"), "mark"), "near-copies")
    keyed = _apart(docs).withColumn("hash", jaccard_join.row_hash())
    # marks grow with the documents, so they are never broadcast: small tables take the plan of large ones
    marked = keyed.join(marks.hint("merge"), keyed["doc_id"].eqNullSafe(marks["m"]) & (keyed["hash"] == marks["h"]), "left")
    kept = marked.filter("mark IS NULL").select("doc_id", "text", "row")
    if not marks.filter("mark = 'again'").isEmpty():
        once = marked.filter("mark = 'again'").groupBy("doc_id", "h").agg(F.first(F.struct("text", "row")).alias("one"))
        kept = kept.unionByName(once.select("doc_id", "one.text", "one.row"))
    return _together(kept, docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark window go."""
    judged = decontaminate.decontaminate(_apart(docs), table(spark, sf_dir, "benchmark"), keep=("row",))
    return _together(judged.filter("hits IS NULL"), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_stream.digests(docs, vocabulary_path())


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_passages", benchmark_passages), ("tokens", tokens)]

#: Byte-pair encoding and prototypes are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
