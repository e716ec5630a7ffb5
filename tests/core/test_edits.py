"""Draft edits, recognised page numbers, image arrays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireline.functions import images as I
from quireline.functions import ocr as O
from quireline.operators import drafts as D

BASE = [0, 1, 2, 1, 0, 0, 1, 1]
CASES = [
    ("indent", {4}, [0, 1, 2, 1, 1, 0, 1, 1]),
    ("indent", {0}, None),
    ("indent", {4, 5}, [0, 1, 2, 1, 1, 1, 2, 2]),
    ("outdent", {1, 2}, [0, 0, 1, 1, 0, 0, 1, 1]),
    ("outdent", {0}, None),
    ("move_up", {3}, [0, 3, 1, 2, 4, 5, 6, 7]),
    ("move_up", {1}, None),
    ("move_down", {0}, [4, 0, 1, 2, 3, 5, 6, 7]),
    ("move_down", {6, 7}, None),
    ("delete", {1}, [0, 3, 4, 5, 6, 7]),
    ("delete", set(), None),
    ("insert_sibling", {1}, [0, 1, 2, None, 3, 4, 5, 6, 7]),
    ("insert_child", {5}, [0, 1, 2, 3, 4, 5, 6, 7, None]),
]


@pytest.mark.parametrize(("name", "chosen", "want"), CASES)
def test_edits(name, chosen, want):
    got = D.EDITS[name](BASE, chosen)
    if want is None:
        assert got is None
    elif name in ("indent", "outdent"):
        assert [level for _, level in got] == want
    else:
        assert [i for i, _ in got] == want


def test_children_are_lifted():
    assert D.delete_keeping_children(BASE, {0, 1}) == [(2, 0), (3, 0), (4, 0), (5, 0), (6, 1), (7, 1)]


def test_random_edits_keep_levels_valid():
    rng = random.Random(3)
    for _ in range(500):
        levels = []
        for _ in range(rng.randrange(1, 12)):
            levels.append(rng.randrange(0, (levels[-1] if levels else -1) + 2))
        got = D.EDITS[rng.choice([*D.EDITS])](levels, {i for i in range(len(levels)) if rng.random() < 0.3})
        last = -1
        for _, level in got or ():
            assert 0 <= level <= last + 1
            last = level


def test_edit_tables(spark):
    df = spark.createDataFrame([(d, i, k) for d in (1, 2) for i, k in enumerate(BASE)], "doc long, pos int, level int")
    got = sorted(map(tuple, D.edited(df, "doc", "pos", "level", "delete", (F.col("pos") == 1) & (F.col("doc") == 1)).collect()), key=str)
    assert len(got) == 6 + 8 and all(r[4] == (r[0] == 1) for r in got)
    more = spark.createDataFrame([(1, 0, 3)], "doc long, pos int, level int")
    assert [tuple(r)[1:3] for r in sorted(D.merged(df.filter("doc = 1"), more, "doc", "pos", "level", "insert", after=1).collect())][2] == (2, 2)
    assert D.merged(df, more, "doc", "pos", "level", "replace").count() == 1
    assert D.merged(df, more, "doc", "pos", "level", "append").count() == 17


def test_recognised_numbers():
    assert [O.parse_token(t) and O.parse_token(t).value for t in ("12", "１２", "1O", "12-15", "xii", "15-12", "lO", "xli", "0")] == [12, 12, 10, 12, 12, None, None, None, None]
    assert O.parse_token("lO", noise_only=True).value == 10
    got = O.split_trailing("绪论 ........ 12")
    assert (got.title, got.number.value, got.leader, got.abutting) == ("绪论", 12, True, False)
    assert O.split_trailing("绪论12").abutting and O.split_trailing("World War II") is None and O.split_trailing("Hello12") is None
    assert O.folio("- 12 -").value == 12 and O.folio("第12页").value == 12 and O.folio("12 x") is None
    assert O.folio_candidates("12 The title") == [(12, False)] and O.folio_candidates("- 12 -") == [(12, True)]
    assert O.folio_candidates("Chapter 3") == [] and O.folio_candidates("1.2 Scope") == []
    assert O.roman_lookalike("... 1l!").value == 3 and O.roman_lookalike("12") is None


def test_readings():
    assert O.settled_reading(["a", "b", "b", "a"]) == ("b", 2) and O.settled_reading(["a", "b"]) == ("a", 1)
    assert O.merged_title("第章 甲", ["第一章 甲", "第一章 甲"]) == "第一章 甲"
    assert O.merged_title("title", ["titles", "titles"]) == "title"
    assert O.unstable("abc", ["abd"]) and not O.unstable("abc 12", ["abc"])
    assert O.clean_title("• 第一章绪论") == "第一章 绪论" and O.normalized("Ａ b-C!") == "abc"


def test_images():
    a = np.full((20, 60), 255, np.uint8)
    a[5:15, 2:10] = 0
    for x in (20, 26, 32):
        a[13:15, x : x + 2] = 0
    assert I.leading_text_end(a) == 10
    assert len(I.components(a)) == 4 and I.components(a)[0] == (2, 5, 10, 15, 80)
    assert (I.thicken(a) == 0).sum() > (a == 0).sum()
    assert I.shrink(a, 2).shape == (10, 30) and I.resample(a, 30, 10).shape == (10, 30)
    assert I.crop(a, -5, -5, 5, 5).shape == (5, 5) and I.pad(a, 2).shape == (24, 64)
    both, at = I.stack([a, a[:5]], 3)
    assert both.shape == (31, 60) and at == [0, 23]
    assert I.normalize_contrast(np.array([[0, 100, 200, 200]], np.uint8)).max() == 255
    assert I.is_stroke(a[:, :3][:, 2:]) and not I.is_stroke(a)
