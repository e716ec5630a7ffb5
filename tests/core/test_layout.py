"""Boxes, lines, columns, skew and policy columns on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from quireline.operators import layout as L
from quireline.operators import contained, matching, policy, scans

BOX = "page int, id int, text string, min_x double, min_y double, max_x double, max_y double, angle double"


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, t, x, y, x + w, y + h, a) for i, (t, x, y, w, h, a) in enumerate(rows)], BOX)


def test_lines(spark):
    df = boxes(spark, [("a", 0.0, 0.0, 10.0, 10.0, 0.0), ("b", 20.0, 2.0, 10.0, 10.0, 0.0), ("c", 0.0, 20.0, 10.0, 10.0, 0.0), ("over a", 1.0, 1.0, 10.0, 10.0, 0.0)])
    got = {r.id: r.line for r in L.group_lines(df, ["page"], "id").collect()}
    assert got[1] == got[3] and len({got[0], got[2], got[3]}) == 3  # of two lines the better overlap counts


def test_contained_observations(spark):
    df = boxes(spark, [("hello world", 0.0, 0.0, 10.0, 10.0, 0.0), ("world", 5.0, 0.0, 5.0, 10.0, 0.0), ("world", 50.0, 0.0, 5.0, 10.0, 0.0), ("hello world", 0.0, 0.0, 10.0, 10.0, 0.0)])
    assert sorted(r.id for r in L.drop_contained(df, ["page"], "id", "text").collect()) == [0, 2]


def test_columns_and_skew(spark):
    rows = [("l", 0.05, i / 10, 0.3, 0.01, 0.02) for i in range(5)] + [("r", 0.55, i / 10, 0.4, 0.01, 0.02) for i in range(5)]
    df = boxes(spark, rows)
    assert 0.36 < L.column_gutter(df, ["page"]).first().gutter < 0.55
    assert L.estimate_skew(df, ["page"]).first().skew == pytest.approx(0.02)
    assert L.estimate_skew(df.limit(2), ["page"]).first().skew == 0
    assert L.column_gutter(df.filter("text = 'l'"), ["page"]).first().gutter is None
    assert L.misoriented_share(df.withColumn("angle", F.lit(1.0)), ["page"]).first().misoriented == 1
    assert L.upright(df.withColumn("angle", F.lit(1.5))).count() == 0
    turned = L.deskew(df.limit(1), F.lit(0.0), F.lit(0.5), F.lit(0.5)).first()
    assert turned.min_x == pytest.approx(0.05) and turned.max_y == pytest.approx(0.01)


def test_theil_sen_ignores_outliers(spark):
    df = spark.createDataFrame([(1, i, float(i), 2.0 * i + (100 if i == 3 else 0)) for i in range(9)], "g int, k int, x double, y double")
    assert L.theil_sen(df, ["g"], "x", "y", "k").first().slope == 2


def test_located_titles_and_shifts(spark):
    entries = spark.createDataFrame([(1, 0, "Start", 5, True), (1, 1, "Middle part", None, False), (1, 2, "End", 9, True)], "doc long, pos int, title string, page int, ok boolean")
    lines = spark.createDataFrame([(1, 7, 0, "Midle part"), (1, 8, 0, "Middle part")], "doc long, page int, line_no int, line string")
    spans = matching.neighbour_spans(entries, "doc", "pos", "page", F.col("ok"))
    assert [(r.low, r.high) for r in spans.collect()] == [(5, 9)]
    find = lambda x: [r.located for r in matching.locate_titles(spans.drop("page"), lines, "doc", "pos", title="title", page="page", line="line", excluded=x).collect()]
    assert find(None) == [7]
    assert find(spark.createDataFrame([(1, 7)], "doc long, page int")) == [8]
    chapters = spark.createDataFrame([(1, "Middle part", 6), (1, "Other", 3)], "doc long, title string, expected int")
    windows = matching.chapter_windows(chapters, lines, "doc", expected="expected", title="title", page="page", line="line")
    assert {r.title: (r.pages, r.confirmed) for r in windows.collect()} == {"Middle part": ([7, 8], False), "Other": ([], False)}
    pairs = matching.with_pairs(spark.createDataFrame([(1, 7, 0, "Mid"), (1, 7, 1, "dle")], "doc long, page int, line_no int, line string"), "doc", "page", "line_no", "line")
    assert sorted(r.candidate for r in pairs.collect()) == ["Mid", "Middle", "dle"]


def test_policy_reasons(spark):
    entry = "doc_id long, page_style string, printed_page int, inherited boolean, confidence double, notes string"
    rows = [(d, "arabic", p, False, c, "") for d, c in ((1, 1.0), (2, 0.5)) for p in (1, 5, 9)] + [(3, "arabic", 1, False, 1.0, "")]
    votes = spark.createDataFrame([(1, "ok", 4), (2, "ok", 4), (3, "ok", 4)], "doc_id long, status string, offset int")
    got = {r.doc_id: (r.status, r.reason) for r in policy.document_status(spark.createDataFrame(rows, entry), votes).collect()}
    assert got == {1: ("ok", None), 2: ("refused", "most entries are unsure"), 3: ("refused", "too few entries with pages")}


def test_clusters_differ(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (0, 1, 2)], "d int, v double")
    assert {r.cluster for r in scans.chain_clusters(df, "d", "v", 1.5).collect()} == {0}
    assert sorted((r.value, r.cluster) for r in scans.anchor_clusters(df, "d", "v", 1.5).collect()) == [(0, 0), (1, 0), (2, 1)]


def test_numbers_at_the_tolerance_count_as_near(spark):
    points = [(0, 515), (7, 636), (7, 914), (7, 658), (0, 290), (0, 284)]  # two lie at 4 from the line to the last bit
    df = spark.createDataFrame([(1, 900.0 + d, float(y)) for d, y in points], "page int, x double, y double")
    got = L.number_column_skew(df, ["page"], x="x", y="y", width=F.lit(1000), height=F.lit(1000), tolerance=F.lit(4)).first().skew
    assert got == pytest.approx(-0.017542, abs=1e-6)


def test_contained_equals_all_pairs(spark):
    rng = random.Random(3)
    whole = "".join(rng.choice("abcdé \n") for _ in range(9000))
    rows = []
    for i in range(400):
        size = rng.choice([0, 1, 2, 3, 7, 14, 15, 40, 63, 200, 255, 1023, 2500])
        at = rng.randrange(len(whole) - size)
        text = whole[at : at + size]
        text = text[: size // 2] + "X" + text[size // 2 :] if rng.random() < 0.3 else text
        box = rng.choice([(0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 1.0, 1.0), (0.5, 0.0, 2.0, 1.0), (3.0, 3.0, 3.0, 4.0), (1.0, 0.0, 0.0, 1.0), (None, 0.0, 1.0, 1.0)])
        rows.append((rng.choice([1, 2, None]), rng.choice([None, *range(300)]), None if rng.random() < 0.03 else text, *box, 0.0))
    df = spark.createDataFrame(rows, BOX).repartition(3)
    a, b = df.alias("a"), df.alias("b")
    inside = F.col("b.text").contains(F.col("a.text")) & (F.col("a.id") != F.col("b.id")) & ((F.col("a.text") != F.col("b.text")) | (F.col("b.id") < F.col("a.id")))
    want = a.join(b, inside & (F.col("a.page") == F.col("b.page")) & (L.shared_area("a", "b") >= 0.7 * L.area("a")), "left_anti")
    got = L.drop_contained(df, ["page"], "id", "text")
    assert got.columns == df.columns
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) != sorted(map(key, df.collect()))


def test_few_texts_of_a_page_are_compared(spark):
    rng = random.Random(4)
    common = " ".join(f"c{rng.randrange(1000)}" for _ in range(200))
    rows = [(i, 1, f"{common} {' '.join(f'w{rng.randrange(10**6)}' for _ in range(30))} {common}") for i in range(600)]
    texts = spark.createDataFrame([(str(i).encode(), g, t) for i, g, t in rows], "id binary, grp long, text string")
    anchors, marks = contained.candidates(texts, texts)
    assert 600 <= anchors.join(marks, "anchor").count() < 900  # each with itself and few others, not 360,000
