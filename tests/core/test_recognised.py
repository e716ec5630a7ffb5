import random

from quireline.functions import ocr as O
from quireline.operators import recognised as R


def test_ends_of_lines():
    read = lambda t: (f := O.split_trailing(t)) and (f.title, f.number.text, f.leader)
    assert read("第二章 市场 …… 27") == ("第二章 市场", "27", True)
    assert read("2.4 市场 ..... 8") == ("2.4 市场", "8", True)
    assert read("Foreword . . . . . ix") == ("Foreword", "ix", True)
    assert read("Chapter 5 Trade 63") == ("Chapter 5 Trade", "63", False)
    assert read("供给 …… ２７-３１") == ("供给", "27-31", True)
    assert read("供给 …… 2 7") == ("供给", "27", True) and read("Chapter 5 1")[1] == "1"
    assert read("供给 …… I") == ("供给", "i", True) and read("供给 …… 27.")[1] == "27"
    for text in ("Section 3.4", "2.1.3", "Part IV", "Appendix D", "供给 ……", "供给ix", "Thanks ×21", "Raj", "SARS2", ""):
        assert O.split_trailing(text) is None, text
    assert O.split_trailing("供给 ……j").number.noisy and O.split_trailing("供给27").abutting


def test_titles_are_cleaned():
    cleaned = {"•三、供给": "三、供给", "． 第二节 •供给分析": "第二节 供给分析", "第二节，价格": "第二节 价格", "第二节.模型": "第二节 模型", "第十一部分 总结": "第十一部分 总结", "让·罗尔斯": "让·罗尔斯", "-、供给 ...": "一、供给"}
    assert {t: O.clean_title(t) for t in cleaned} == cleaned
    assert O.trailing_digits("供给 2 0") == ("供给", 20) and O.trailing_digits("供给 2") == ("供给", 2)
    assert all(O.trailing_digits(t) == (t, None) for t in ("Section 3.4", "Chapter 5", "附录21", "供给"))
    assert O.drop_misread_tail("供给 ×11", [("供给", 0.1), ("×11", 0.9)], 0.8) == ("供给", "×11")
    assert O.drop_misread_tail("Windows 10", [("Windows", 0.1), ("10", 0.3)], 0.8) is None and O.drop_misread_tail("Part II", [("Part", 0.1), ("II", 0.9)], 0.8) is None
    assert O.drop_misread_tail("供给 … 1 0", [("供给", 0.1), ("1", 0.85), ("0", 0.9)], 0.8) == ("供给", "1 0")


def test_one_or_i_follows_changes(spark):
    def plain(rows):
        out = [list(r) for r in rows]
        at = [i for i, r in enumerate(out) if r[0] is not None]
        for m, i in enumerate(at):
            value, kind = out[i]
            before, after = (out[at[m - 1]] if m else None), (out[at[m + 1]] if m + 1 < len(at) else None)
            if value == 1 and kind == "roman" and before and before[1] == "roman" and after and after[1] == "arabic" and after[0] <= 3:
                out[i][1] = "arabic"
            elif value == 1 and kind == "arabic" and after and after[1] == "roman":
                out[i][1] = "roman"
        return [r[1] for r in out]

    rng = random.Random(1)
    docs = {d: [(None, None) if rng.random() < 0.2 else (rng.choice([1, 1, 2, 5]), rng.choice(["arabic", "roman"])) for _ in range(rng.randrange(1, 9))] for d in range(300)}
    df = spark.createDataFrame([(d, i, *r) for d, rows in docs.items() for i, r in enumerate(rows)], "d int, i int, value int, kind string")
    got = {}
    for r in R.one_or_i(df, "d", "i").orderBy("d", "i").collect():
        got.setdefault(r.d, []).append(r.kind_read)
    assert got == {d: plain(rows) for d, rows in docs.items()}


def test_numbers_go_to_the_nearest_title(spark):
    rows = [(1, 0, "供给", None, 0, 10), (1, 1, "", 7, 11, 21), (1, 2, "需求", None, 30, 40), (1, 3, "", 8, 41, 51), (1, 4, "", 9, 60, 70), (1, 5, "done", 3, 71, 81), (2, 0, "", 5, 0, 9), (2, 1, "alone", None, 50, 60)]
    df = spark.createDataFrame(rows, "p int, i int, title string, number int, min_y int, max_y int")
    got = [(r.p, r.i, r.attached, r.number_read) for r in R.attach_numbers(df, ["p"], "i", reach=8.0).orderBy("p", "i").collect()]
    assert got == [(1, 0, None, 7), (1, 1, 0, None), (1, 2, None, 8), (1, 3, 2, None), (1, 4, None, 9), (1, 5, None, 3), (2, 0, None, 5), (2, 1, None, None)]


def test_rereading(spark):
    box = "p int, k int, min_x double, min_y double, max_x double, max_y double"
    known = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0)], box)
    found = spark.createDataFrame([(1, 1, 5.0, 0.0, 15.0, 10.0), (1, 2, 8.0, 0.0, 18.0, 10.0), (1, 3, 9.0, 0.0, 19.0, 10.0), (2, 4, 0.0, 0.0, 1.0, 1.0)], box)
    assert sorted(r.k for r in R.drop_reread(known, found, ["p"], "k").collect()) == [2, 4]
    lines = spark.createDataFrame([(1, 1, 0.0, 10.0, 50.0, 0.0, 80.0, 10.0), (1, 2, 20.0, 30.0, 50.0, 0.0, 80.0, 10.0)], "p int, line int, min_y double, max_y double, max_x double, left double, right double, char_height double")
    seen = spark.createDataFrame([(1, "…… 7", 30.0, 1.0, 9.0), (1, "第一节供给", 5.0, 0.0, 10.0), (1, "7", 85.0, 0.0, 10.0), (1, "……", 5.0, 20.0, 30.0)], "p int, text string, min_x double, min_y double, max_y double")
    assert [tuple(r) for r in R.title_readings(lines, seen, ["p"], "line").collect()] == [(1, 1, "第一节 供给", 5.0)]
