"""The queries of the corpus operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireline.llm import arc_convert, bpe_stream, chat_format, decontaminate, jaccard_join, language_id, license_scan, media_png, token_planes, url_rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.sql("SELECT -7L AS conv_id, n AS turn, if(n = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM (SELECT explode(array(0L, 1L)) AS n)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.report(chat_format.expand(turns))


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, 23 + length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g'))
            + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) AS chars FROM turns
), placed AS (
  SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS m, sum(chars) OVER w AS upto
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR n = m))::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(license_scan.scan(table(spark, sf_dir, "documents")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(judged)


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
spans AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS span FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS span FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM spans) WHERE len(w) >= size)),
found AS (SELECT doc_id, size, i, item FROM places JOIN spans USING (size, span)),
hits AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS spot FROM (SELECT DISTINCT doc_id, size, i FROM found)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: The end id and the vocabulary file that the token queries use.
END_ID, VOCABULARY = 1, "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shards = token_planes.write_shards(docs, vocabulary_path(), end_id=END_ID)
    return token_planes.read_documents(token_planes.shard_rows(spark, shards), docs.schema["doc_id"].dataType.simpleString())


def op5_arc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = arc_convert.scan_arcs(arc_convert.write_arcs(table(spark, sf_dir, "pages")))
    archives = arc_convert.convert_arcs(arc_convert.choose(records, least_bytes=0))
    return arc_convert.read_warcs(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last, sha1(html) AS h FROM p),
g AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, 1 + 5 * i, 5))::INTEGER) AS v FROM k)
SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> s & 31) + 1, 1)), '')), '') AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM g
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = language_id.held_out_fold(F.col("doc_id"))
    profiles = language_id.train(docs.filter(fold != 1))
    return language_id.predict(docs.withColumn("held_out", fold == 1), profiles, keep=("doc_id", "held_out"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, threshold=85).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w) - 1)], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(2, len(w) - 2) END)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, y.b FROM reach r JOIN sym y ON r.b = y.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY 1) USING (doc_id)
"""


def op8_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireline.llm.storage import written

    stored = written(media_png.encode_column(table(spark, sf_dir, "documents"), "text", keep=("doc_id",)), "op9")
    return media_png.decode_column(stored).drop("problem")


#: host, path, verdict
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


OP10_SQL = """
WITH parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages)
), rules(rule_host, rule_path, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT page_id, rule_host || rule_path AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, v DESC) AS n
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT parts.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND n = 1
"""

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_license_scan": op2_license_scan,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_planes": op4_token_planes,
    "op5_arc_convert": op5_arc_convert,
    "op6_language_id": op6_language_id,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_bpe_stream": op8_bpe_stream,
    "op9_media_png": op9_media_png,
    "op10_url_rules": op10_url_rules,
}

ORACLES = {
    "op1_chat_format": OP1_SQL,
    "op3_decontaminate": OP3_SQL,
    "op5_arc_convert": OP5_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op10_url_rules": OP10_SQL,
}
