from pyspark.sql import functions as F

from quireline.llm import language_id as L
from quireline.llm import queries

WORDS = {"xx": "abba cadda baca daba", "yy": "motu lopu tulo punt", "zz": "ñeré ñoré érñe reñé"}


def rows(n):
    import random

    rng = random.Random(3)
    return [(i, " ".join(rng.choice(WORDS[k].split()) for _ in range(20 + i)), k) for i in range(n) for k in WORDS]


def test_learns_and_defines_edge_cases(spark):
    train = spark.createDataFrame(rows(20) + [(1, None, "xx"), (2, "abba", None)], "doc_id long, text string, lang string")
    model = L.train(train)
    assert model.names == ["xx", "yy", "zz"]
    cases = [(1, None), (2, ""), (3, "123 -- 456 ???"), (4, "abba daba cadda"), (5, "motu " * 200_000), (6, "ñeré"), (6, "ñeré"), (7, "a")]
    df = spark.createDataFrame(cases, "doc_id long, text string").withColumn("lang_pred", F.lit("clash"))
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.predict(df, model).collect()]
    assert [g[:2] for g in got][:3] == [(1, "und"), (2, "und"), (3, "und")]
    assert [g[1] for g in got[3:7]] == ["xx", "yy", "zz", "zz"]
    assert all(0 <= g[2] <= 1 for g in got)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = L.train(empty)
    assert L.predict(empty, model).count() == 0
    assert [r.lang_pred for r in L.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).collect()] == ["und"]


def test_bound_on_training_rows(spark):
    df = spark.createDataFrame(rows(300), "doc_id long, text string, lang string")
    assert L.train(df, per_language=50).names == ["xx", "yy", "zz"]


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op6_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_copies_do_not_thin_the_training_texts(spark):
    once = spark.createDataFrame(rows(40), "doc_id long, text string, lang string")
    hot = spark.range(5000).selectExpr("id AS doc_id", "'motu lopu' AS text", "'yy' AS lang")
    marks = spark.range(5000).selectExpr("id AS doc_id", "concat(id, ' ...') AS text", "'zz' AS lang")
    want = L.train(once.union(hot.limit(1)), per_language=50)
    got = L.train(once.union(hot).union(marks), per_language=50)
    assert got.names == want.names == ["xx", "yy", "zz"]
    assert abs(got.prototypes - want.prototypes).max() < 1e-5
