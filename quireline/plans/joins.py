"""Queries of matching joins, layout and scores; tables of the test data stand in for titles, boxes and outlines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quireline.functions import text as T
from quireline.operators import evaluate, layout, matching


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def title_fuzzy(spark, sf_dir):
    """Pairs of different names of one brand's parts that are within the edit limit of the first, with how many parts have each."""
    parts = _table(spark, sf_dir, "part").select("p_brand", "p_name")
    counts = parts.groupBy("p_brand", "p_name").agg(F.count("*").alias("n"))
    named = lambda name, n: counts.select("p_brand", F.col("p_name").alias(name), F.col("n").alias(n))
    pairs = matching.similar_titles(parts, ["p_brand"], "p_name")
    return pairs.join(named("title", "n_parts"), ["p_brand", "title"]).join(named("other", "n_others"), ["p_brand", "other"]).select("p_brand", "title", "n_parts", "other", "n_others")


def range_window(spark, sf_dir):
    """Orders of a customer within three days of an event of the user of the same number."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01")).cast("long")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.pmod(day("o_orderdate"), F.lit(365)).alias("o_day"))
    events = _table(spark, sf_dir, "events").select("user_id", F.pmod(F.col("event_id"), F.lit(365)).alias("e_day")).distinct()
    return matching.range_join(orders, events, "o_day", "e_day", 3, key=["user_id"]).groupBy("o_orderkey").agg(F.count("*").alias("n"))


def first_title(spark, sf_dir):
    lines, orders = _table(spark, sf_dir, "lineitem").withColumn("place", F.struct("l_linenumber", "l_partkey")), _table(spark, sf_dir, "orders")
    return matching.first_match(orders.select(F.col("o_orderkey").alias("l_orderkey")), lines, ["l_orderkey"], "place", "l_partkey", out="first_part")


def unique_line(spark, sf_dir):
    lines, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    return matching.unique_match(orders.select(F.col("o_orderkey").alias("l_orderkey")), lines, ["l_orderkey"], "l_partkey", out="only_part")


def neighbour_range(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long").alias("line"), F.floor("l_quantity").cast("long").alias("page"))
    return matching.neighbour_spans(rows, "l_orderkey", "line", "page", F.col("line") % 3 != 0).select("l_orderkey", "line", "low", "high")


def as_of_price(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    marks = _table(spark, sf_dir, "events").filter("event_id % 5 = 0").select("user_id", "ts", F.col("event_id").alias("mark"))
    last = marks.groupBy("user_id", "ts").agg(F.max("mark").alias("mark"))
    return matching.as_of(events, last, ["user_id"], "ts", "mark", out="last_mark").select("user_id", "event_id", "last_mark")


def containment_dedupe(spark, sf_dir):
    """Documents whose text is not part of another's of their language and source."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    boxed = docs.withColumns({"min_x": F.lit(0.0), "min_y": F.lit(0.0), "max_x": F.lit(1.0), "max_y": F.lit(1.0)})
    return layout.drop_contained(boxed, ["lang", "source"], "doc_id", "text").select("doc_id")


def column_histogram(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") / 64).alias("a"), (F.col("l_quantity") / 64 + F.col("l_discount")).alias("b"))
    return layout.cover_histogram(items, ["l_returnflag"], F.col("a"), F.col("b"), 64).withColumn("bin", F.col("bin").cast("long"))


def hist_percentile(spark, sf_dir):
    counts = _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.floor("l_quantity").cast("long").alias("v")).agg(F.count("*").alias("n"))
    return layout.histogram_percentile(counts, ["l_returnflag"], "v", "n", 0.9)


def mode_tie(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.floor("l_quantity") % 4).cast("long").alias("rank"))
    return layout.mode_smallest(items, ["l_orderkey"], "rank").withColumn("purity", F.round("purity", 6))


def theil_sen(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    return layout.theil_sen(items, ["l_orderkey"], "k", "l_extendedprice", "k").withColumn("slope", F.floor(F.col("slope") * 10 + 0.5).cast("long"))


def digit_slip(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 997).alias("expected"), F.when(F.col("o_orderkey") % 3 == 0, F.floor((F.col("o_orderkey") % 997) / 10)).when(F.col("o_orderkey") % 3 == 1, F.col("o_orderkey") % 997 + 3).otherwise(F.col("o_orderkey") % 991).cast("bigint").alias("read"))
    return orders.select("o_orderkey", T.is_digit_slip(F.col("read"), F.col("expected")).alias("slip"))


def cer_score(spark, sf_dir):
    """Error rate of each benchmark text as a reading of the one with the next number."""
    items = _table(spark, sf_dir, "benchmark")
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    return items.join(after, "item_id").select("item_id", F.round(T.error_rate(F.col("text"), F.col("next")), 6).alias("cer"))


def _outlines(spark, sf_dir):
    """The first line of each turn is a title; every fifth is lost, and every second gets a letter too many."""
    truth = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring_index("text", "\n", 1).alias("title"))
    got = truth.filter("turn % 5 <> 3").withColumn("title", F.when(F.col("turn") % 2 == 0, F.concat("title", F.lit("x"))).otherwise(F.col("title")))
    return got, truth


def align_entries(spark, sf_dir):
    got, truth = _outlines(spark, sf_dir)
    return evaluate.align_entries(got, truth, "conv_id", "turn", "title").withColumn("cer", F.round("cer", 6))


def sequential_matches(spark, sf_dir):
    got, truth = _outlines(spark, sf_dir)
    return evaluate.sequential_matches(got, truth, "conv_id", "turn", "title")


def _scored(spark, sf_dir):
    got, truth = _outlines(spark, sf_dir)
    a = got.select("conv_id", "turn", F.col("title").alias("got_title"), (F.col("turn") * 2).alias("got_page"), (F.col("turn") % 3).alias("got_level"))
    b = truth.select("conv_id", "turn", F.col("title").alias("truth_title"), (F.col("turn") * 2 + (F.col("turn") % 7 == 5).cast("int")).alias("truth_page"), (F.col("turn") % 4 % 3).alias("truth_level"))
    names = {f"{side}_{c}": f"{side}_{c}" for side in ("got", "truth") for c in ("title", "page", "level")}
    return evaluate.outline_score(a.join(b, ["conv_id", "turn"], "full"), "conv_id", **names)


def outline_score(spark, sf_dir):
    return _scored(spark, sf_dir)


def suite_summary(spark, sf_dir):
    return evaluate.suite_summary(_scored(spark, sf_dir))


def outline_difference(spark, sf_dir):
    got, truth = _outlines(spark, sf_dir)
    return evaluate.first_difference(got, truth, "conv_id", "turn", ["title"])


QUERIES = {f.__name__: f for f in (title_fuzzy, range_window, first_title, unique_line, neighbour_range, as_of_price, containment_dedupe, column_histogram, hist_percentile, mode_tie, theil_sen, digit_slip, cer_score, align_entries, sequential_matches, outline_score, suite_summary, outline_difference)}

#: Edit distances in SQL count bytes, so there each letter beyond ASCII is one control character instead.
_LETTERS = "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜßàáâäçèéêëíîïñóôöùúûüœæ¿¡"
_ONE_BYTE = "[" + ", ".join(f"chr({n})" for n in [*range(1, 9), 11, 12, *range(14, 32), 127, *map(ord, "^`{|}~_@#%&*=+<>")][: len(_LETTERS)]) + "]"


def _bytes(text):
    return f"translate({text}, '{_LETTERS}', array_to_string({_ONE_BYTE}, ''))"


_SCORES = f"""
a AS (SELECT conv_id, turn, t AS truth_title, turn * 2 + CASE WHEN turn % 7 = 5 THEN 1 ELSE 0 END AS truth_page, turn % 4 % 3 AS truth_level,
  CASE WHEN turn % 5 <> 3 THEN t || CASE WHEN turn % 2 = 0 THEN 'x' ELSE '' END END AS got_title, turn * 2 AS got_page, turn % 3 AS got_level FROM (SELECT conv_id, turn, {_bytes("split_part(text, chr(10), 1)")} AS t FROM conversations)),
c AS (SELECT *, CASE WHEN got_title IS NULL THEN 1.0 WHEN length(truth_title) = 0 THEN CASE WHEN length(got_title) = 0 THEN 0.0 ELSE 1.0 END ELSE least(1.0, levenshtein(got_title, truth_title) / length(truth_title)) END AS cer FROM a),
scores AS (SELECT conv_id, count(*) AS entries, count(got_title) AS found, count(*) FILTER (got_title IS NOT NULL AND got_page = truth_page AND cer <= 0.05) AS correct, 0::BIGINT AS extras, round(avg(cer), 6) AS mean_cer,
  round(count(*) FILTER (got_title IS NOT NULL AND got_page = truth_page) / count(*), 6) AS page_share, round(count(*) FILTER (got_title IS NOT NULL AND got_level = truth_level) / count(*), 6) AS level_share, correct = entries AS exact FROM c GROUP BY conv_id)"""

ORACLES = {
    "title_fuzzy": """WITH n AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2) SELECT a.p_brand, a.p_name AS title, a.n AS n_parts, b.p_name AS other, b.n AS n_others
FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_name <> b.p_name WHERE levenshtein(a.p_name, b.p_name) <= CASE WHEN length(a.p_name) <= 3 THEN 0 ELSE floor(length(a.p_name) * 0.2::DOUBLE) END""",
    "range_window": """SELECT o_orderkey, count(*) AS n FROM (SELECT o_orderkey, o_custkey, (o_orderdate::DATE - DATE '1970-01-01') % 365 AS o_day FROM orders) o
JOIN (SELECT DISTINCT user_id, event_id % 365 AS e_day FROM events) e ON e.user_id = o.o_custkey AND abs(o_day - e_day) <= 3 GROUP BY 1""",
    "first_title": "SELECT o_orderkey AS l_orderkey, (SELECT l_partkey FROM lineitem WHERE l_orderkey = o_orderkey ORDER BY l_linenumber, l_partkey LIMIT 1) AS first_part FROM orders",
    "unique_line": "SELECT o_orderkey AS l_orderkey, p AS only_part FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem GROUP BY 1 HAVING count(*) = 1) u ON u.l_orderkey = o_orderkey",
    "neighbour_range": """WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line, floor(l_quantity)::BIGINT AS page FROM lineitem),
s AS (SELECT a.l_orderkey, a.line, (SELECT arg_max(b.page, b.line) FROM r b WHERE b.l_orderkey = a.l_orderkey AND b.line < a.line AND b.line % 3 <> 0) AS low, (SELECT arg_min(b.page, b.line) FROM r b WHERE b.l_orderkey = a.l_orderkey AND b.line > a.line AND b.line % 3 <> 0) AS high FROM r a WHERE a.line % 3 = 0)
SELECT * FROM s WHERE high >= low AND high - low <= 12""",
    "as_of_price": "SELECT e.user_id, e.event_id, m.mark AS last_mark FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS mark FROM events WHERE event_id % 5 = 0 GROUP BY 1, 2) m ON e.user_id = m.user_id AND e.ts >= m.ts",
    "containment_dedupe": "SELECT doc_id FROM documents a WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE a.lang = b.lang AND a.source = b.source AND a.doc_id <> b.doc_id AND contains(b.text, a.text) AND (a.text <> b.text OR b.doc_id < a.doc_id))",
    "column_histogram": "SELECT l_returnflag, bin, count(*) AS n FROM (SELECT l_returnflag, unnest(range(greatest(0, floor(l_quantity / 64 * 64)::BIGINT), least(63, floor((l_quantity / 64 + l_discount) * 64)::BIGINT) + 1)) AS bin FROM lineitem) GROUP BY 1, 2",
    "hist_percentile": """SELECT l_returnflag, min(v) AS percentile FROM (SELECT l_returnflag, v, sum(n) OVER (PARTITION BY l_returnflag ORDER BY v) AS c, sum(n) OVER (PARTITION BY l_returnflag) AS t FROM (SELECT l_returnflag, floor(l_quantity)::BIGINT AS v, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE c > 0.9 * t GROUP BY 1""",
    "mode_tie": """SELECT l_orderkey, mode, n, round(n / t, 6) AS purity FROM (SELECT l_orderkey, rank AS mode, n, (sum(n) OVER (PARTITION BY l_orderkey))::BIGINT AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, rank) AS r FROM (SELECT l_orderkey, floor(l_quantity)::BIGINT % 4 AS rank, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE r = 1""",
    "theil_sen": """WITH r AS (SELECT l_orderkey, l_extendedprice AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)
SELECT a.l_orderkey, floor(median((b.y - a.y) / (b.k - a.k)) * 10 + 0.5)::BIGINT AS slope, count(*) AS n_pairs FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.k < b.k GROUP BY 1""",
    "digit_slip": """WITH p AS (SELECT o_orderkey, (o_orderkey % 997)::VARCHAR AS e, (CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 997) // 10 WHEN o_orderkey % 3 = 1 THEN o_orderkey % 997 + 3 ELSE o_orderkey % 991 END)::VARCHAR AS r FROM orders)
SELECT o_orderkey, r <> e AND ((length(r) = length(e) - 1 AND list_contains(list_transform(range(1, length(e) + 1), lambda i: substr(e, 1, (i - 1)::INT) || substr(e, (i + 1)::INT)), r)) OR (length(r) = length(e) AND length(e) >= 2 AND left(r, length(r)::INT - 1) = left(e, length(e)::INT - 1))) AS slip FROM p""",
    "cer_score": f"SELECT a.item_id, round(least(1.0, levenshtein(a.t, b.t) / length(b.t)), 6) AS cer FROM (SELECT item_id, {_bytes('text')} AS t FROM benchmark) a JOIN (SELECT item_id, {_bytes('text')} AS t FROM benchmark) b ON b.item_id = a.item_id + 1",
    "sequential_matches": f"""WITH RECURSIVE t AS (SELECT conv_id, turn, {_bytes("split_part(text, chr(10), 1)")} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
g AS (SELECT conv_id, turn, t || CASE WHEN turn % 2 = 0 THEN 'x' ELSE '' END AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS j FROM t WHERE turn % 5 <> 3),
near AS (SELECT t.conv_id, t.i, list(g.j ORDER BY g.j) AS fits FROM t JOIN g ON g.conv_id = t.conv_id AND CASE WHEN t.t = '' THEN g.t = '' ELSE levenshtein(g.t, t.t) <= 0.5::DOUBLE * length(t.t) END GROUP BY 1, 2),
steps AS (SELECT t.conv_id, t.i, t.turn, coalesce(fits, []) AS fits FROM t LEFT JOIN near USING (conv_id, i)),
walk AS (SELECT conv_id, i, turn, list_filter(fits, lambda x: x < 6)[1] AS hit, coalesce(list_filter(fits, lambda x: x < 6)[1] + 1, 0) AS at FROM steps WHERE i = 0
UNION ALL SELECT s.conv_id, s.i, s.turn, list_filter(s.fits, lambda x: x >= w.at AND x < w.at + 6)[1], coalesce(list_filter(s.fits, lambda x: x >= w.at AND x < w.at + 6)[1] + 1, w.at) FROM walk w JOIN steps s ON s.conv_id = w.conv_id AND s.i = w.i + 1)
SELECT w.conv_id, w.turn AS truth_pos, g.turn AS got_pos FROM walk w LEFT JOIN g ON g.conv_id = w.conv_id AND g.j = w.hit""",
    "outline_score": f"WITH {_SCORES} SELECT * FROM scores",
    "suite_summary": f"""WITH {_SCORES} SELECT count(*) AS documents, count(*) FILTER (exact) AS exact, count(*) FILTER (page_share < 0.97 OR level_share < 0.95 OR mean_cer > 0.03) AS missed, round(avg(mean_cer), 6) AS mean_cer, round(avg(page_share), 6) AS page_share, round(avg(level_share), 6) AS level_share,
CASE WHEN count(*) FILTER (page_share < 0.97 OR level_share < 0.95 OR mean_cer > 0.03) = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM scores""",
    "outline_difference": "SELECT conv_id, min(CASE WHEN turn % 5 = 3 OR turn % 2 = 0 THEN turn END) AS first_difference FROM conversations GROUP BY 1",
}
