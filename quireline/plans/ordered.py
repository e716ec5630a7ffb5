"""Queries of ordered scans, trees and votes; tables of the test data stand in for outlines and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireline.operators import scans, tree, votes


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as preorder rows: pos from 0, level by clamping."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", (F.length("text") % 6).alias("raw"))
    placed = turns.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long") - 1)
    return scans.level_clamp(placed, "conv_id", "turn", "raw").withColumn("level", F.col("level").cast("long"))


_OUTLINE = """
placed AS (SELECT conv_id, turn, length(text) % 6 AS raw, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
outline AS (SELECT conv_id, turn, raw, pos, pos + least(0, min(raw - pos) OVER (PARTITION BY conv_id ORDER BY pos)) AS level FROM placed),
tree AS (SELECT o.*, (SELECT max(p.pos) FROM outline p WHERE p.conv_id = o.conv_id AND p.pos < o.pos AND p.level = o.level - 1) AS parent,
  coalesce((SELECT min(p.pos) FROM outline p WHERE p.conv_id = o.conv_id AND p.pos > o.pos AND p.level <= o.level), (SELECT count(*) FROM outline p WHERE p.conv_id = o.conv_id)) AS block_end FROM outline o)"""


def level_clamp(spark, sf_dir):
    return _outline(spark, sf_dir).select("conv_id", "turn", F.col("raw").cast("long").alias("raw"), "level")


def level_violation(spark, sf_dir):
    return scans.level_violations(_outline(spark, sf_dir).drop("level"), "conv_id", "turn", "raw").select("conv_id", "turn", "violation")


def tree_parent(spark, sf_dir):
    return tree.parent(_outline(spark, sf_dir), "conv_id", "pos", "level").select("conv_id", "pos", "level", "parent")


def tree_ancestors(spark, sf_dir):
    held = tree.ancestors(_outline(spark, sf_dir), "conv_id", "pos", "level")
    return held.select("conv_id", "pos", F.array_join("ancestors", ",").alias("path"))


def tree_block_end(spark, sf_dir):
    return tree.block_end(_outline(spark, sf_dir), "conv_id", "pos", "level").select("conv_id", "pos", "block_end")


def tree_links(spark, sf_dir):
    return tree.links(_outline(spark, sf_dir), "conv_id", "pos", "level").select("conv_id", "pos", "parent", "descendants", "first_child", "next_sibling", "previous_sibling")


def _blocks(spark, sf_dir):
    return tree.block_end(_outline(spark, sf_dir), "conv_id", "pos", "level")


def tree_visible(spark, sf_dir):
    return tree.visible(_blocks(spark, sf_dir), "conv_id", "pos", F.col("turn") % 4 == 0).select("conv_id", "pos", "level")


def tree_heads(spark, sf_dir):
    return tree.block_heads(_blocks(spark, sf_dir), "conv_id", "pos", F.col("turn") % 3 == 1).select("conv_id", "pos", "level")


def tree_delete(spark, sf_dir):
    return tree.delete_blocks(_blocks(spark, sf_dir), "conv_id", "pos", F.col("turn") % 5 == 2).select("conv_id", "turn", "pos", "level")


def tree_lift(spark, sf_dir):
    return tree.delete_rows(_outline(spark, sf_dir), "conv_id", "pos", "level", F.col("turn") % 5 == 2).select("conv_id", "turn", "pos", "level")


def _deep(spark, sf_dir):
    """Events of a user as rows of a tree of up to 40 levels."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("n"))
    held = events.withColumn("pos", F.col("n") - 1).withColumn("raw", F.when(F.col("event_id") % 7 == 0, F.floor(F.col("n") % 40 / 2)).otherwise(F.col("n") % 40))
    return scans.level_clamp(held, "user_id", "pos", "raw").withColumn("level", F.col("level").cast("long"))


def tree_deep(spark, sf_dir):
    held = tree.links(_deep(spark, sf_dir), "user_id", "pos", "level")
    return held.select("user_id", "pos", "level", "parent", "block_end", "first_child", "next_sibling", "previous_sibling")


def tree_deep_lift(spark, sf_dir):
    return tree.delete_rows(_deep(spark, sf_dir), "user_id", "pos", "level", F.col("event_id") % 3 == 1).select("user_id", "event_id", "pos", "level")


def draft_edits(spark, sf_dir):
    """Each conversation's outline after each edit of its fourth row (with what is below it)."""
    from quireline.operators import drafts

    outline = _outline(spark, sf_dir)
    made = [drafts.edited(outline, "conv_id", "pos", "level", edit, F.col("pos") == 3).withColumn("edit", F.lit(edit)) for edit in ("indent", "outdent", "move_up", "move_down", "insert_sibling", "insert_child")]
    both = made[0]
    for one in made[1:]:
        both = both.unionByName(one)
    return both.select("conv_id", "edit", "old_pos", F.col("pos").cast("long").alias("pos"), F.col("level").cast("long").alias("level"), "changed")


def shift_block(spark, sf_dir):
    held = _blocks(spark, sf_dir).withColumn("printed_page", F.when(F.col("turn") % 3 > 0, F.col("turn") * 10)).withColumn("manual_page", F.when(F.col("turn") % 4 == 3, F.col("turn") + 100)).withColumn("section_shift", F.lit(0).cast("long"))
    return tree.shift_pages(held, "conv_id", "pos", F.col("turn") % 4 == 1, 3).select("conv_id", "pos", "manual_page_new", "section_shift_new")


def calibrate_from(spark, sf_dir):
    held = _outline(spark, sf_dir).withColumn("section_shift", F.col("raw").cast("long"))
    return tree.calibrate_from(held, "pos", F.lit(3), F.lit(7), follows=F.col("turn") % 2 == 0).select("conv_id", "pos", "section_shift")


def _paged(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.when(F.get_json_object("props", "$.k").cast("long") % 3 > 0, F.get_json_object("props", "$.k").cast("long")).alias("page"))


def page_inherit(spark, sf_dir):
    return scans.inherit_pages(_paged(spark, sf_dir), "user_id", "event_id", "page").select("user_id", "event_id", F.col("page_inherited"), "inherited")


def forward_fill(spark, sf_dir):
    return scans.forward_fill(_paged(spark, sf_dir), "user_id", "event_id", "page").select("user_id", "event_id", "page_filled")


def neighbour_values(spark, sf_dir):
    held = scans.next_value(scans.previous_value(_paged(spark, sf_dir), "user_id", "event_id", "page"), "user_id", "event_id", "page")
    return held.select("user_id", "event_id", "previous_value", "next_value")


def behind_last(spark, sf_dir):
    return scans.behind_last(_paged(spark, sf_dir), "user_id", "event_id", "page").select("user_id", "event_id", "behind")


def run_collapse(spark, sf_dir):
    pages = _paged(spark, sf_dir).filter("page IS NOT NULL").select("user_id", "page").distinct()
    return scans.run_starts(pages, "user_id", "page")


def _items(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("line"), "l_extendedprice", F.floor("l_quantity").cast("long").alias("quantity"))


_ITEMS = "items AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line, l_extendedprice, floor(l_quantity)::BIGINT AS quantity FROM lineitem)"


def order_breaks(spark, sf_dir):
    return scans.order_breaks(_items(spark, sf_dir), "l_orderkey", "line", "quantity").select("l_orderkey", F.col("line").cast("long").alias("line"), "out_of_order")


def lnds_length(spark, sf_dir):
    kept = scans.longest_nondecreasing(_items(spark, sf_dir), "l_orderkey", "line", "quantity")
    return kept.groupBy("l_orderkey").agg(F.count_if("kept").alias("length"))


def lnds_members(spark, sf_dir):
    return scans.longest_nondecreasing(_items(spark, sf_dir), "l_orderkey", "line", "quantity").withColumn("line", F.col("line").cast("long"))


def rank_stack(spark, sf_dir):
    ranks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", (F.length("text") % 7).cast("int").alias("rank"))
    return scans.rank_levels(ranks, "conv_id", "turn", "rank").select("conv_id", "turn", F.col("level").cast("long").alias("level"))


def chain_cluster(spark, sf_dir):
    return scans.chain_clusters(_items(spark, sf_dir), "l_orderkey", "l_extendedprice", 5000.0).select("l_orderkey", F.col("line").cast("long").alias("line"), "cluster")


def anchor_cluster(spark, sf_dir):
    return scans.anchor_clusters(_items(spark, sf_dir), "l_orderkey", "quantity", 8).select("l_orderkey", F.col("value").alias("quantity"), F.col("cluster").cast("long").alias("cluster"), F.col("anchor").cast("long").alias("anchor"))


def equal_edge_cluster(spark, sf_dir):
    return scans.widest_cluster(_items(spark, sf_dir), "l_orderkey", "quantity", 6)


def gap_detect(spark, sf_dir):
    w = _items(spark, sf_dir).groupBy("l_orderkey", "quantity").count()
    return scans.gaps(w, "l_orderkey", "quantity").select("l_orderkey", "quantity", "gap")


def review_queue(spark, sf_dir):
    return scans.rotate(_outline(spark, sf_dir).withColumn("focus", F.lit(2)), "conv_id", "pos", "focus").select("conv_id", "pos", F.col("queue").cast("long").alias("queue"))


def column_reading_order(spark, sf_dir):
    turns = _outline(spark, sf_dir).withColumn("parts", F.when(F.col("raw") % 3 == 0, 1).otherwise(2)).select("conv_id", "pos", "parts", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part"))
    return scans.column_order(turns, "conv_id", "pos", "part", "parts").select("conv_id", "pos", F.col("part").cast("long").alias("part"), F.col("reading_order").cast("long").alias("reading_order"))


def _samples(spark, sf_dir):
    """Events of a user stand for sampled pages, the last digits of their values for printed numbers."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    page = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    value = F.floor("value").cast("long")
    printed = F.when(value % 5 == 0, F.array().cast("array<bigint>")).when(value % 5 < 4, F.array(page - F.col("user_id") % 7, value)).otherwise(F.array(value, value + 1))
    return events.withColumn("page", page).select("user_id", "page", printed.alias("printed"))


_SAMPLES = """
paged AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, floor(value)::BIGINT AS v FROM events),
samples AS (SELECT user_id, page, CASE WHEN v % 5 = 0 THEN []::BIGINT[] WHEN v % 5 < 4 THEN [page - user_id % 7, v] ELSE [v, v + 1] END AS printed FROM paged),
each AS (SELECT DISTINCT user_id, page, page - unnest(printed) AS "offset" FROM samples),
counted AS (SELECT user_id, "offset", count(*) AS votes FROM each GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, abs("offset"), "offset" DESC) AS rank FROM counted)"""


def offset_vote(spark, sf_dir):
    return votes.offset_votes(_samples(spark, sf_dir), "user_id").select("user_id", "offset", "votes", F.col("rank").cast("long").alias("rank"))


def offset_decision(spark, sf_dir):
    held = votes.offset_decision(_samples(spark, sf_dir), "user_id")
    return held.select("user_id", "best_guess", "agreeing", "samples", "readable", "confidence", "runner_offset", "runner_votes", "late_run", "status", "offset")


def roman_vote(spark, sf_dir):
    return votes.roman_vote(_samples(spark, sf_dir), "user_id")


def sample_pages(spark, sf_dir):
    counts = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return counts.select("o_custkey", F.explode(votes.sample_positions(F.col("n") * 9, 24)).alias("page")).select("o_custkey", F.col("page").cast("long").alias("page"))


def spread_pick(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")
    return votes.spread_pick(orders, "o_custkey", "o_orderkey")


_SCANS = (level_clamp, level_violation, tree_parent, tree_ancestors, tree_block_end, tree_links, tree_visible, tree_heads, tree_delete, tree_lift, tree_deep, tree_deep_lift, draft_edits, shift_block, calibrate_from, page_inherit, forward_fill, neighbour_values, behind_last, run_collapse, order_breaks, lnds_length, lnds_members, rank_stack, chain_cluster, anchor_cluster, equal_edge_cluster, gap_detect, review_queue, column_reading_order, offset_vote, offset_decision, roman_vote, sample_pages, spread_pick)
QUERIES = {f.__name__: f for f in _SCANS}

_PAGED = "paged AS (SELECT user_id, event_id, CASE WHEN (props->>'$.k')::BIGINT % 3 > 0 THEN (props->>'$.k')::BIGINT END AS page FROM events)"
_DEEP = """
numbered AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
raws AS (SELECT user_id, event_id, n - 1 AS pos, CASE WHEN event_id % 7 = 0 THEN n % 40 // 2 ELSE n % 40 END AS raw FROM numbered),
outline AS (SELECT user_id, event_id, pos, pos + least(0, min(raw - pos) OVER (PARTITION BY user_id ORDER BY pos)) AS level FROM raws),
tree AS (SELECT o.*, (SELECT max(p.pos) FROM outline p WHERE p.user_id = o.user_id AND p.pos < o.pos AND p.level = o.level - 1) AS parent,
  coalesce((SELECT min(p.pos) FROM outline p WHERE p.user_id = o.user_id AND p.pos > o.pos AND p.level <= o.level), (SELECT count(*) FROM outline p WHERE p.user_id = o.user_id)) AS block_end FROM outline o)"""
_COVER = "SELECT 1 FROM tree c WHERE c.conv_id = o.conv_id AND c.pos < o.pos AND o.pos < c.block_end AND"

ORACLES = {
    "level_clamp": f"WITH {_OUTLINE} SELECT conv_id, turn, raw, level FROM outline",
    "level_violation": f"WITH {_OUTLINE} SELECT conv_id, turn, raw > coalesce(lag(raw) OVER (PARTITION BY conv_id ORDER BY turn), -1) + 1 AS violation FROM outline",
    "tree_parent": f"WITH {_OUTLINE} SELECT conv_id, pos, level, parent FROM tree",
    "tree_ancestors": f"WITH {_OUTLINE} SELECT conv_id, pos, coalesce((SELECT string_agg(c.pos::VARCHAR, ',' ORDER BY c.pos) FROM tree c WHERE c.conv_id = o.conv_id AND c.pos < o.pos AND o.pos < c.block_end), '') AS path FROM tree o",
    "tree_block_end": f"WITH {_OUTLINE} SELECT conv_id, pos, block_end FROM tree",
    "tree_links": f"""WITH {_OUTLINE} SELECT conv_id, pos, parent, block_end - pos - 1 AS descendants, CASE WHEN block_end > pos + 1 THEN pos + 1 END AS first_child,
(SELECT min(s.pos) FROM tree s WHERE s.conv_id = o.conv_id AND s.pos > o.pos AND s.parent IS NOT DISTINCT FROM o.parent AND s.level = o.level) AS next_sibling,
(SELECT max(s.pos) FROM tree s WHERE s.conv_id = o.conv_id AND s.pos < o.pos AND s.parent IS NOT DISTINCT FROM o.parent AND s.level = o.level) AS previous_sibling FROM tree o""",
    "tree_visible": f"WITH {_OUTLINE} SELECT conv_id, pos, level FROM tree o WHERE NOT EXISTS ({_COVER} c.turn % 4 = 0)",
    "tree_heads": f"WITH {_OUTLINE} SELECT conv_id, pos, level FROM tree o WHERE o.turn % 3 = 1 AND NOT EXISTS ({_COVER} c.turn % 3 = 1)",
    "tree_delete": f"WITH {_OUTLINE} SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS pos, level FROM tree o WHERE o.turn % 5 <> 2 AND NOT EXISTS ({_COVER} c.turn % 5 = 2)",
    "tree_lift": f"WITH {_OUTLINE} SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS pos, level - (SELECT count(*) FROM tree c WHERE c.conv_id = o.conv_id AND c.pos < o.pos AND o.pos < c.block_end AND c.turn % 5 = 2) AS level FROM tree o WHERE o.turn % 5 <> 2",
    "tree_deep": f"""WITH {_DEEP} SELECT user_id, pos, level, parent, block_end, CASE WHEN block_end > pos + 1 THEN pos + 1 END AS first_child, lead(pos) OVER w AS next_sibling, lag(pos) OVER w AS previous_sibling
FROM tree WINDOW w AS (PARTITION BY user_id, parent, level ORDER BY pos)""",
    "tree_deep_lift": f"WITH {_DEEP} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS pos, level - (SELECT count(*) FROM tree c WHERE c.user_id = o.user_id AND c.pos < o.pos AND o.pos < c.block_end AND c.event_id % 3 = 1) AS level FROM tree o WHERE o.event_id % 3 <> 1",
    "draft_edits": f"""WITH {_OUTLINE}, c AS (SELECT conv_id, pos AS s, block_end AS e, level AS l FROM tree WHERE pos = 3),
i AS (SELECT c.*, (SELECT level FROM tree t WHERE t.conv_id = c.conv_id AND t.pos = s - 1) AS before_level, (SELECT max(pos) FROM tree t WHERE t.conv_id = c.conv_id AND t.pos < s AND t.level <= l) AS up,
  (SELECT level FROM tree t WHERE t.conv_id = c.conv_id AND t.pos = e) AS next_level, (SELECT block_end FROM tree t WHERE t.conv_id = c.conv_id AND t.pos = e) AS next_end FROM c),
j AS (SELECT i.*, (SELECT level FROM tree t WHERE t.conv_id = i.conv_id AND t.pos = up) AS up_level FROM i),
r AS (SELECT t.conv_id, t.pos, t.level, coalesce(t.pos >= s AND t.pos < e, false) AS inside, s, e, l, up, next_end, coalesce(l <= before_level, false) AS indents, coalesce(l > 0, false) AS outdents, coalesce(up_level = l, false) AS ups, coalesce(next_level = l, false) AS downs FROM tree t LEFT JOIN j USING (conv_id))
SELECT conv_id, 'indent' AS edit, pos AS old_pos, pos, level + CASE WHEN indents AND inside THEN 1 ELSE 0 END AS level, indents AS changed FROM r
UNION ALL SELECT conv_id, 'outdent', pos, pos, level - CASE WHEN outdents AND inside THEN 1 ELSE 0 END, outdents FROM r
UNION ALL SELECT conv_id, 'move_up', pos, CASE WHEN NOT ups THEN pos WHEN inside THEN pos - (s - up) WHEN pos >= up AND pos < s THEN pos + (e - s) ELSE pos END, level, ups FROM r
UNION ALL SELECT conv_id, 'move_down', pos, CASE WHEN NOT downs THEN pos WHEN inside THEN pos + (next_end - e) WHEN pos >= e AND pos < next_end THEN pos - (e - s) ELSE pos END, level, downs FROM r
UNION ALL SELECT conv_id, 'insert_sibling', pos, pos + CASE WHEN pos >= e THEN 1 ELSE 0 END, level, true FROM r
UNION ALL SELECT conv_id, 'insert_sibling', NULL, coalesce(max(e), count(*)), coalesce(max(l), 0), true FROM r GROUP BY conv_id
UNION ALL SELECT conv_id, 'insert_child', pos, pos + CASE WHEN pos >= e THEN 1 ELSE 0 END, level, s IS NOT NULL FROM r
UNION ALL SELECT conv_id, 'insert_child', NULL, e, l + 1, true FROM c""",
    "shift_block": f"""WITH {_OUTLINE}, marked AS (SELECT conv_id, pos, turn, (turn % 4 = 1 OR EXISTS ({_COVER} c.turn % 4 = 1)) AS inside FROM tree o)
SELECT conv_id, pos, CASE WHEN turn % 4 = 3 THEN turn + 100 + CASE WHEN inside THEN 3 ELSE 0 END END AS manual_page_new, CASE WHEN inside AND turn % 4 <> 3 AND turn % 3 > 0 THEN 3 ELSE 0 END::BIGINT AS section_shift_new FROM marked""",
    "calibrate_from": f"WITH {_OUTLINE} SELECT conv_id, pos, raw + CASE WHEN pos >= 3 AND turn % 2 = 0 THEN 7 ELSE 0 END AS section_shift FROM outline",
    "page_inherit": f"""WITH {_PAGED} SELECT user_id, event_id, coalesce(first_value(page IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(page IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS page_inherited,
page IS NULL AND page_inherited IS NOT NULL AS inherited FROM paged""",
    "forward_fill": f"WITH {_PAGED} SELECT user_id, event_id, coalesce(last_value(CASE WHEN page >= 1 THEN page END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS page_filled FROM paged",
    "neighbour_values": f"WITH {_PAGED} SELECT user_id, event_id, last_value(page IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_value, first_value(page IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_value FROM paged",
    "behind_last": f"WITH {_PAGED} SELECT user_id, event_id, coalesce(page < last_value(page IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS behind FROM paged",
    "run_collapse": f"WITH {_PAGED} SELECT DISTINCT user_id, page FROM paged p WHERE page IS NOT NULL AND NOT EXISTS (SELECT 1 FROM paged q WHERE q.user_id = p.user_id AND q.page = p.page - 1)",
    "order_breaks": f"WITH {_ITEMS} SELECT l_orderkey, line, coalesce(quantity < lag(quantity) OVER w, false) OR coalesce(lead(quantity) OVER w < quantity, false) AS out_of_order FROM items WINDOW w AS (PARTITION BY l_orderkey ORDER BY line)",
    "lnds_length": f"""WITH RECURSIVE {_ITEMS}, best(l_orderkey, line, quantity, n) AS (
SELECT l_orderkey, line, quantity, 1 AS n FROM items UNION SELECT i.l_orderkey, i.line, i.quantity, b.n + 1 FROM best b JOIN items i ON i.l_orderkey = b.l_orderkey AND i.line > b.line AND i.quantity >= b.quantity)
SELECT l_orderkey, max(n)::BIGINT AS length FROM best GROUP BY 1""",
    "lnds_members": f"""WITH RECURSIVE {_ITEMS}, best(l_orderkey, line, quantity, n) AS (
SELECT l_orderkey, line, quantity, 1 AS n FROM items UNION SELECT i.l_orderkey, i.line, i.quantity, b.n + 1 FROM best b JOIN items i ON i.l_orderkey = b.l_orderkey AND i.line > b.line AND i.quantity >= b.quantity),
sized AS (SELECT l_orderkey, line, max(n) AS n FROM best GROUP BY 1, 2),
back AS (SELECT a.l_orderkey, a.line, max(b.line) AS before FROM sized a JOIN sized b ON b.l_orderkey = a.l_orderkey AND b.line < a.line AND b.n = a.n - 1 GROUP BY 1, 2),
walk AS (SELECT l_orderkey, arg_max(line, n * 1000 + line) AS line FROM sized GROUP BY 1 UNION ALL SELECT w.l_orderkey, b.before FROM walk w JOIN back b ON b.l_orderkey = w.l_orderkey AND b.line = w.line)
SELECT i.l_orderkey, i.line, i.quantity, w.line IS NOT NULL AS kept FROM items i LEFT JOIN walk w ON w.l_orderkey = i.l_orderkey AND w.line = i.line""",
    "rank_stack": """WITH r AS (SELECT conv_id, turn, length(text) % 7 AS rank FROM conversations)
SELECT conv_id, turn, (SELECT count(*) FROM r j WHERE j.conv_id = i.conv_id AND j.turn < i.turn AND j.rank < (SELECT min(k.rank) FROM r k WHERE k.conv_id = i.conv_id AND k.turn > j.turn AND k.turn <= i.turn)) AS level FROM r i""",
    "chain_cluster": f"""WITH {_ITEMS}, d AS (SELECT *, CASE WHEN l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) > 5000 THEN 1 ELSE 0 END AS new FROM items)
SELECT l_orderkey, line, (sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice))::BIGINT AS cluster FROM d""",
    "anchor_cluster": f"""WITH RECURSIVE {_ITEMS}, v AS (SELECT l_orderkey, quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY quantity) AS i FROM (SELECT DISTINCT l_orderkey, quantity FROM items)),
f AS (SELECT l_orderkey, quantity, i, 0 AS cluster, quantity AS anchor FROM v WHERE i = 1 UNION ALL SELECT v.l_orderkey, v.quantity, v.i, f.cluster + CASE WHEN v.quantity - f.anchor > 8 THEN 1 ELSE 0 END, CASE WHEN v.quantity - f.anchor > 8 THEN v.quantity ELSE f.anchor END FROM f JOIN v ON v.l_orderkey = f.l_orderkey AND v.i = f.i + 1)
SELECT l_orderkey, quantity, cluster::BIGINT AS cluster, anchor FROM f""",
    "equal_edge_cluster": f"""WITH {_ITEMS}, c AS (SELECT l_orderkey, quantity AS low, count(*) OVER w AS size, max(quantity) OVER w AS high FROM items WINDOW w AS (PARTITION BY l_orderkey ORDER BY quantity RANGE BETWEEN CURRENT ROW AND 6 FOLLOWING))
SELECT DISTINCT l_orderkey, low, high, size FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY size DESC, low) AS n FROM c) WHERE n = 1""",
    "gap_detect": f"""WITH {_ITEMS}, s AS (SELECT l_orderkey, quantity, quantity - lag(quantity) OVER (PARTITION BY l_orderkey ORDER BY quantity) AS step FROM (SELECT DISTINCT l_orderkey, quantity FROM items))
SELECT l_orderkey, quantity, coalesce(step > 1.2 * (median(step) OVER (PARTITION BY l_orderkey)), false) AS gap FROM s""",
    "review_queue": f"WITH {_OUTLINE} SELECT conv_id, pos, row_number() OVER (PARTITION BY conv_id ORDER BY pos <= 2, pos) AS queue FROM outline",
    "column_reading_order": f"""WITH {_OUTLINE}, p AS (SELECT conv_id, pos, raw, unnest(CASE WHEN raw % 3 = 0 THEN [1] ELSE [1, 2] END) AS part FROM outline),
r AS (SELECT *, sum(CASE WHEN raw % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos, part) * 2 - CASE WHEN raw % 3 = 0 THEN 1 ELSE 0 END AS run FROM p)
SELECT conv_id, pos, part::BIGINT AS part, row_number() OVER (PARTITION BY conv_id ORDER BY run, part, pos) AS reading_order FROM r""",
    "offset_vote": f'WITH {_SAMPLES} SELECT user_id, "offset", votes, rank FROM ranked',
    "offset_decision": f"""WITH {_SAMPLES}, best AS (SELECT user_id, "offset" AS b, votes FROM ranked WHERE rank = 1),
totals AS (SELECT user_id, count(*) AS samples, count(*) FILTER (len(printed) > 0) AS readable FROM samples GROUP BY 1),
held AS (SELECT s.user_id, page, printed, b, list_contains(printed, page - b) AS agrees, min(CASE WHEN list_contains(printed, page - b) THEN page END) OVER u AS low, max(CASE WHEN list_contains(printed, page - b) THEN page END) OVER u AS high
  FROM samples s JOIN best USING (user_id) WINDOW u AS (PARTITION BY s.user_id)),
reads AS (SELECT DISTINCT user_id, page, b, low, high, unnest(printed) AS v FROM held),
texts AS (SELECT *, v::VARCHAR AS r, (page - b)::VARCHAR AS e FROM reads WHERE page - v <> b),
others AS (SELECT user_id, page - v AS other, count(DISTINCT page) AS n FROM texts WHERE NOT coalesce(page > low AND page < high AND r <> e AND ((length(r) = length(e) - 1 AND list_contains(list_transform(range(1, length(e) + 1), lambda i: substr(e, 1, (i - 1)::INT) || substr(e, (i + 1)::INT)), r))
  OR (length(r) = length(e) AND length(e) >= 2 AND left(r, length(r)::INT - 1) = left(e, length(e)::INT - 1))), false) GROUP BY 1, 2),
runner AS (SELECT user_id, other AS runner_offset, n AS runner_votes FROM others QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, other) = 1),
last AS (SELECT user_id, b, printed, agrees, page, row_number() OVER (PARTITION BY user_id ORDER BY page DESC) AS k FROM held WHERE len(printed) > 0),
spread AS (SELECT DISTINCT user_id, b, k, page - v AS o FROM (SELECT user_id, b, k, page, agrees, unnest(printed) AS v FROM last) WHERE NOT agrees AND page - v <> b),
runs AS (SELECT user_id, b, o, count(*) FILTER (k = i) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, o ORDER BY k) AS i FROM spread) GROUP BY 1, 2, 3),
late AS (SELECT user_id, o AS late_run FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS most FROM runs) WHERE n = most AND n >= 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(o - b), o) = 1),
decided AS (SELECT t.user_id, b AS best_guess, coalesce(votes, 0) AS agreeing, samples, readable, round(coalesce(votes, 0) / samples, 6) AS confidence, runner_offset, coalesce(runner_votes, 0) AS runner_votes, late_run,
  CASE WHEN b IS NULL THEN 'unreadable' WHEN coalesce(votes, 0) < 6 OR round(coalesce(votes, 0) / samples, 6) < 0.4 THEN 'low_confidence' WHEN coalesce(runner_votes, 0) * 3 > votes OR late_run IS NOT NULL THEN 'conflict' ELSE 'ok' END AS status
  FROM totals t LEFT JOIN best USING (user_id) LEFT JOIN runner USING (user_id) LEFT JOIN late USING (user_id))
SELECT *, CASE WHEN status = 'ok' THEN best_guess END AS "offset" FROM decided""",
    "roman_vote": f'WITH {_SAMPLES}, r AS (SELECT *, row_number() OVER w AS place, coalesce(lead(votes) OVER w, 0) AS nxt FROM counted WHERE "offset" >= 0 WINDOW w AS (PARTITION BY user_id ORDER BY votes DESC, "offset")) SELECT user_id, "offset" AS roman_offset, votes FROM r WHERE place = 1 AND votes >= 2 AND votes >= 2 * nxt',
    "sample_pages": """WITH c AS (SELECT o_custkey, count(*) * 9 AS n FROM orders GROUP BY 1), s AS (SELECT o_custkey, n // 20 + 1 AS low, n - 2 * (n // 20) AS span FROM c)
SELECT DISTINCT o_custkey, page FROM (SELECT o_custkey, unnest(CASE WHEN span <= 24 THEN range(low, low + span) ELSE list_transform(range(0, 24), lambda k: low + floor(k * (span - 1) / 23.0::DOUBLE + 0.5)::BIGINT) END) AS page FROM s)""",
    "spread_pick": "WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM o WHERE n <= 4 OR list_contains([k * (n - 1) // 3 for k in [0, 1, 2, 3]], i)",
}
