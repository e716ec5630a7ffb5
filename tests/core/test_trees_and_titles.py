import random

from quireline.operators import matching, tree
from quireline.operators.evaluate import _distance


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randrange(0, 90 if rng.random() < 0.1 else 9))) for _ in range(2))
        assert _distance(a, b) == plain_distance(a, b)


def test_similar_titles_equal_all_pairs(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("ab ") for _ in range(rng.randrange(0, 24))) for _ in range(40)]
    titles = [(k, t) for k in (1, 2, None) for t in base] + [(1, "".join(rng.choice("abx") if rng.random() < 0.15 else c for c in t)) for t in base for _ in range(3)] + [(1, None), (1, base[0])]
    got = {tuple(r) for r in matching.similar_titles(spark.createDataFrame(titles, "k int, t string"), ["k"], "t").collect()}
    limit = lambda n: 0 if n <= 3 else int(n * 0.2)
    want = {(k, a, b) for k, a in titles for j, b in titles if k == j and k is not None and a is not None and b is not None and a != b and plain_distance(a, b) <= limit(len(a))}
    assert got == want and len(want) > 50


def test_trees_of_any_depth(spark):
    rng, rows = random.Random(3), []
    for doc in range(6):
        level = -1
        for pos in range(120):
            level = level + 1 if rng.random() < 0.8 else rng.randrange(0, level + 2)
            rows.append((doc, pos, level, rng.random() < 0.3))
    rows += [(6, pos, pos, pos % 2 == 0) for pos in range(300)]
    by = {}
    for doc, pos, level, cut in rows:
        by.setdefault(doc, []).append((pos, level, cut))
    df = spark.createDataFrame(rows, "doc int, pos long, level long, cut boolean")
    want = {}
    for doc, own in by.items():
        for pos, level, _ in own:
            above = [p for p, lv, _ in own if p < pos and all(x > lv for q, x, _ in own if p < q <= pos)]
            end = next((p for p, lv, _ in own if p > pos and lv <= level), len(own))
            want[doc, pos] = (above[-1] if above else None, end, above)
    held = tree.ancestors(tree.block_end(tree.parent(df, "doc", "pos", "level"), "doc", "pos", "level"), "doc", "pos", "level")
    assert {(r.doc, r.pos): (r.parent, r.block_end, r.ancestors) for r in held.collect()} == want
    assert max(len(a) for _, _, a in want.values()) == 299
    lifted = {doc: [level - sum(own[a][2] for a in want[doc, pos][2]) for pos, level, cut in own if not cut] for doc, own in by.items()}
    got = {}
    for r in tree.delete_rows(df, "doc", "pos", "level", df.cut).orderBy("doc", "pos").collect():
        got.setdefault(r.doc, []).append(r.level)
        assert r.pos == len(got[r.doc]) - 1
    assert got == lifted


def test_alignment_is_cheapest():
    from functools import cache

    from quireline.operators.evaluate import align, rate

    rng = random.Random(4)
    for _ in range(150):
        truth = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 6))]
        got = [t + rng.choice(["", "x", "yy"]) for t in truth if rng.random() < 0.7] + ["zzz"] * rng.randrange(0, 2)

        @cache
        def cheapest(i, j, got=tuple(got), truth=tuple(truth)):
            if i == len(got) or j == len(truth):
                return float(len(got) - i + len(truth) - j)
            pair = rate(got[i], truth[j])
            return min(1 + cheapest(i + 1, j), 1 + cheapest(i, j + 1), *([pair + cheapest(i + 1, j + 1)] if pair <= 0.5 else []))

        rows = align(got, truth)
        assert [i for i, _, _ in rows if i is not None] == [*range(len(got))] and [j for _, j, _ in rows if j is not None] == [*range(len(truth))]
        assert all(c == rate(got[i], truth[j]) <= 0.5 for i, j, c in rows if i is not None and j is not None)
        assert abs(sum(c for _, _, c in rows) - cheapest(0, 0)) < 1e-9


def test_aligned_tables(spark):
    from quireline.operators import evaluate

    rows = lambda *r: spark.createDataFrame(list(r), "d int, i int, t string")
    got, truth = rows((1, 0, "alpha"), (1, 1, "gamma"), (2, 0, "x")), rows((1, 0, "alpha"), (1, 1, "beta"), (1, 2, "gamma!"), (3, 0, None))
    assert sorted(((r.d, r.got_pos, r.truth_pos, round(r.cer, 3)) for r in evaluate.align_entries(got, truth, "d", "i", "t").collect()), key=str) == [(1, 0, 0, 0.0), (1, 1, 2, 0.167), (1, None, 1, 1.0), (2, 0, None, 1.0), (3, None, 0, 1.0)]
    assert sorted(map(tuple, evaluate.sequential_matches(got, truth, "d", "i", "t").collect()), key=str) == [(1, 0, 0), (1, 1, None), (1, 2, 1), (3, 0, None)]
