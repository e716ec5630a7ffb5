import random

from quireline.llm import decontaminate as D
from quireline.llm import queries


def judged(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in D.report(D.decontaminate(d, b, **more)).collect()}


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(5)
    text = lambda n, v: " ".join(rng.choice("abcdefgh"[:v]) + rng.choice(["", "X", "é"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 30, 60]), 3)) for i in range(30)] + [(31, None), (3, "a b c d")]
    docs = [(i, text(rng.choice([0, 5, 12, 80, 400]), 3)) for i in range(60)] + [(100, None), (101, ""), (102, items[5][1])]
    docs += [(200 + i, text(40, 8) + " " + (items[i][1] or "") + " " + text(40, 8)) for i in range(30)]
    want = D.brute_force(docs, items)
    assert judged(spark, docs, items) == want
    assert judged(spark, docs, items, block_chars=40) == want
    assert any(v[1] for v in want.values())


def test_very_long_text_and_shared_passage(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    long = " ".join(f"x{i % 977}" for i in range(300_000))
    docs = [(1, long + " " + passage + " " + long), (2, passage.upper()), (3, " ".join(passage.split()[:9]))]
    assert judged(spark, docs, [(7, passage)]) == D.brute_force(docs, [(7, passage)])


def test_empty_tables(spark):
    assert judged(spark, [], [(1, "a b c d e f g h i j k")]) == {}
    assert judged(spark, [(1, "a b")], [])[1][:3] == (2, 0, 0)


def test_repeated_rows_ties_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", "x", "y"), (1, "a b", "x", "y")], "doc_id long, text string, hits string, items string")
    b = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "b", "x")], "item_id long, text string, n_words string")
    rows = D.report(D.decontaminate(d, b)).collect()
    assert [(r.n_words, r.n_hit, r.n_items) for r in rows] == [(2, 2, 2)] * 2


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in queries.op3_decontaminate(spark, sf).collect()}
    assert got == D.brute_force(docs, items)
