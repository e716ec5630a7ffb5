import json
import random

import pytest

from quireline.sources import formats as S


def outline(rng, n=12):
    out, level = [], -1
    for i in range(n):
        level = rng.randrange(0, min(level + 2, 6))
        out.append(S.Item(rng.choice(["A & B", '"q" <x>', "第一章 甲", "Part 2", "x#y", "#1 top"]), level, i + 1))
    return out


@pytest.mark.parametrize("kind", S.FORMATS)
def test_round_trip(kind):
    rng = random.Random(2)
    for _ in range(40):
        items = outline(rng)
        data = S.write(items, kind).encode()
        assert S.detect(data, {"spaces": "a.txt"}.get(kind, "")) in (kind, "text")
        got, notes = S.settled(S.read(data, kind))
        strip = (lambda t: t.replace("＃", "#")) if kind == "text" else lambda t: t
        if kind != "spaces" or len({r.level for r in items}) == max(r.level for r in items) + 1:
            assert [(strip(r.title), r.level, r.page) for r in got] == [(r.title, r.level, r.page) for r in items]


@pytest.mark.parametrize(("text", "line"), [("a", 1), ("\tA 1", 1), ("A 1\n\t\tB 2", 2), ("A 0", 1), ("A x", 1), (" A 1", 1)])
def test_strict_text_refuses(text, line):
    with pytest.raises(S.OutlineError) as e:
        S.read_text(text)
    assert e.value.line == line


def test_strict_text_details():
    got = S.read_text("﻿# comment\r\nA  1\r\r\n　B b\t2\n")
    assert [(r.title, r.level, r.page, r.line) for r in got] == [("A", 0, 1, 2), ("B b", 1, 2, 4)]


def test_loose_formats():
    assert [S.split_number(x) for x in ("T 12", "T -3", "T (7)", "T", "a--3")] == [("T ", 12), ("T ", -3), ("T ", 7), ("T", None), ("a--", 3)]
    assert [(r.level, r.page) for r in S.read_spaces("A 1\n   B 2\n      C\n A2 3")] == [(0, 1), (2, 2), (3, None), (1, 3)]
    nested = {"toc": [{"name": "A", "page": "３", "children": [{"text": "B", "page_index": 4}]}]}
    assert [(r.title, r.level, r.page) for r in S.read_json(json.dumps(nested))] == [("A", 0, 3), ("B", 1, 5)]
    got, notes = S.settled([S.Item("", 2, None, 1), S.Item("x", 5, -1, 2)])
    assert [(r.title, r.level, r.page) for r in got] == [("(untitled)", 0, 1), ("x", 1, 1)] and len(notes) == 6


def test_hostile_xml_and_json():
    for data in (b"<!DOCTYPE x [<!ENTITY a 'b'>]><opml><body/></opml>", b"<opml>", b"<a" + b"><a" * 600, b"<html/>"):
        with pytest.raises(S.OutlineError):
            S.read(data, "opml")
    with pytest.raises(S.OutlineError):
        S.read(b'{"items":' + b'[{"children":' * 70 + b"[]" + b"}]" * 70 + b"}", "json")
    assert S.decode_text("第一章".encode("gb18030")) == "第一章"


def test_tables(spark, tmp_path):
    rng = random.Random(5)
    items = outline(rng)
    for kind in S.FORMATS:
        (tmp_path / f"f.{kind if kind in ('json', 'opml', 'xml') else kind + '.txt'}").write_text(S.write(items, kind), encoding="utf-8")
    (tmp_path / "bad.opml").write_text("<opml>")
    rows = S.read_files(spark, str(tmp_path)).collect()
    assert {"json", "opml", "xml", "text"} <= {r.format for r in rows} <= set(S.FORMATS)
    assert [r.problem is not None for r in rows if r.path.endswith("bad.opml")] == [True]
    table = spark.createDataFrame([(1, i, r.title, r.level, r.page) for i, r in enumerate(items)], "doc long, pos int, title string, level int, page int")
    for kind in S.FORMATS:
        assert S.file_sink(table, "doc", "pos", kind).first().text == S.write(items, kind)
    assert S.text_sink(table, "doc", "pos").first().text == S.write(items, "text")
