from pyspark.sql import functions as F

from quireline.functions.registry import register
from quireline.operators import verify as V


def test_functions_in_sql(spark):
    assert "any_number" in register(spark)
    row = spark.sql("SELECT toc_page('A ..... 7') AS p, toc_heading('Chapter 4 x') AS h, chinese_number('十二') AS c, roman_numeral(14) AS r, any_number(NULL) AS n, title_key('Ａ b!') AS k").first()
    assert (row.p.title, row.p.page.value, row.h.kind, row.h.numbers, row.c, row.r, row.n, row.k) == ("A", 7, "chapter", [4], 12, "xiv", None, "ab")


def test_warnings_and_probe(spark):
    df = spark.createDataFrame([("cannot read /tmp/a b/x.pdf at 123: 4 0 obj",)], "w string")
    assert df.select(V.normal_warning(F.col("w"))).first()[0] == "cannot read <path> b<path> at <n>: <ref> obj"
    rows = V.probe_outline(spark.createDataFrame([("f", 40), ("g", 1)], "path string, pages int"), "path", "pages").collect()
    assert [(r.level, r.page) for r in rows if r.path == "f"] == [(0, 1), (1, 10), (2, 20), (1, 30), (0, 40)]
    assert {r.page for r in rows if r.path == "g"} == {1}
    bytes_ = spark.createDataFrame([(bytearray(b"ab"), bytearray(b"abc"))], "a binary, b binary")
    assert bytes_.select(V.keeps_prefix(F.col("a"), F.col("b"))).first()[0] is True


def test_toc_pages(spark):
    toc = [f"Entry {i} ..... {i}" for i in range(6)]
    rows = [(1, 3, t) for t in ["Contents", *toc]] + [(1, 4, t) for t in toc] + [(1, 5, "prose only") for _ in range(9)] + [(1, 6, t) for t in toc]
    got = V.toc_pages(spark.createDataFrame(rows, "doc long, page int, text string"), "doc", "page", "text")
    assert sorted(r.page for r in got.collect()) == [3, 4]


def test_landing_and_search(spark):
    pages = spark.createDataFrame([(1, p, {12: "the alpha chapter begins", 31: "Beta topic here"}.get(p, "other")) for p in range(1, 60)], "doc long, page int, text string")
    entries = spark.createDataFrame([(1, 0, ["alpha", "chapter"], 12, "alpha chapter"), (1, 1, ["beta", "topic", "missing"], 29, "beta topic"), (1, 2, ["nowhere", "at", "all"], 20, "gone")], "doc long, pos int, words array<string>, page int, title string")
    got = {r.pos: r.landing for r in V.keyword_hits(entries, pages, "doc", key="pos", keywords="words", page="page").collect()}
    assert got == {0: "exact", 1: "near", 2: "missing"}
    shifted = entries.withColumn("page", F.when(F.col("pos") == 0, 5).when(F.col("pos") == 1, 24).otherwise(1))
    assert [(r.offset, r.votes) for r in V.searched_offset(shifted, pages, "doc", key="pos", title="title", page="page").collect()] == [(7, 2)]


def test_carried_lines(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["A long", "title 3", "B 4", "rest"])], "doc long, line int, text string")
    assert sorted(r.text for r in V.carried_lines(df, "doc", "line", "text").collect()) == ["A long title 3", "B 4", "rest"]
