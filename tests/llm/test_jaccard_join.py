import random

import numpy as np
import pyarrow as pa
import pytest

from quireline.llm import jaccard_join as J
from quireline.llm import queries
from quireline.llm.components import components


def joined(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS node", "'y' AS n", "1 AS tk")
    rows = J.jaccard_components(df, **more).collect()
    assert len(rows) == len(docs)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else rng.choice("pqrstuv") + str(rng.randrange(99)) for w in text.split())


@pytest.mark.parametrize(("k", "threshold"), [(4, 85), (5, 80)])
def test_near_copies_chains_and_common_passages_equal_brute_force(spark, k, threshold):
    rng = random.Random(threshold)
    text = lambda n: " ".join("w" + str(rng.randrange(400)) for _ in range(n))
    docs, passage = [], text(60)
    for _ in range(12):
        base = text(rng.choice([6, 9, 12, 30, 120]))
        for _ in range(rng.randrange(1, 9)):
            docs.append(edited(rng, base, rng.choice([0, 0.005, 0.02, 0.05])))
    chain = text(150).split()
    for i in range(12):  # each links to the next, not to those far off
        chain[i * 10 : i * 10 + 2] = ["c", str(i)]
        docs.append(" ".join(chain))
    docs += [passage + " " + text(rng.choice([1, 3, 8, 20, 100])) for _ in range(25)]
    docs += ["", "  ", "one", "ONE", "one two", "a b c d e", "a b c d e f", "a b c d e f g", "a b c d e f g h", None]
    docs = [(i, t) for i, t in enumerate(rng.sample(docs, len(docs)))]
    want = J.brute_force(docs, k, threshold)
    assert joined(spark, docs, k=k, threshold=threshold) == want
    assert len({c for _, c in want.values()}) < len(docs) - 20


def test_groups_that_miss_each_other_are_joined_by_the_matrix(spark, monkeypatch):
    # no bands at all: every link has to come from the token-group matrix and opened blocks
    monkeypatch.setattr(J, "_band_keys", lambda tokens: [])
    monkeypatch.setattr(J, "BLOCK", 2)
    rng = random.Random(3)
    bases = [" ".join("w" + str(rng.randrange(300)) for _ in range(80)) for _ in range(5)]
    docs = [(i, edited(rng, bases[i % 5], 0.01)) for i in range(40)]
    assert joined(spark, docs) == J.brute_force(docs)


def test_large_group_very_long_texts_and_repeats(spark):
    rng = random.Random(6)
    base = " ".join("w" + str(rng.randrange(900)) for _ in range(120))
    long = " ".join("x" + str(i % 7919) for i in range(200_000))
    docs = [(i, edited(rng, base, 0.004)) for i in range(300)] + [(400 + i, base) for i in range(50)] + [(500, long), (501, long + " end"), (502, long.upper())]
    assert joined(spark, docs) == J.brute_force(docs)


def test_blocks_of_one_group(spark, monkeypatch):
    # all in one group of many blocks
    monkeypatch.setattr(J, "_band_keys", lambda tokens: [7])
    monkeypatch.setattr(J, "BLOCK", 5)
    monkeypatch.setattr(J, "COLUMNS", 16)
    monkeypatch.setattr(J, "HOT", 10)
    rng = random.Random(4)
    bases = [" ".join("w" + str(rng.randrange(300)) for _ in range(60)) for _ in range(6)]
    docs = [(i, edited(rng, bases[i % 6], rng.choice([0, 0.01, 0.04]))) for i in range(50)]
    assert joined(spark, docs) == J.brute_force(docs)


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(2)
    for _ in range(200):
        links = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < rng.choice([0.05, 0.2, 0.6])
        rows, columns = links.shape

        def parts(edges):
            label = list(range(rows + columns))
            for _ in label:
                for a, b in edges:
                    label[a] = label[b] = min(label[a], label[b])
            return label

        made = [(i, rows + j if j >= 0 else -1 - j) for i, j in J.forest(links)]
        assert parts(made) == parts([(i, rows + j) for i, j in zip(*np.nonzero(links), strict=True)])
        assert len(made) <= rows + columns


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, None), (5, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()), key=str)
    assert rows == sorted([(None, 2, 3), (3, 2, 3), (3, 2, 3), (None, 0, None), (5, 0, 5)], key=str)
    assert J.jaccard_components(df.limit(0)).count() == 0
    assert J.jaccard_components(df.filter("text IS NULL")).count() == 2


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 160)] + [(200, 200), (301, 300)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_jaccard_join(spark, sf).collect()}
    assert got == J.brute_force(docs)


def test_order_of_tokens_counts_every_text(spark):
    texts = ["one common line of words", "one common line of words and more", *(f"text {i} of its own" for i in range(60)), None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    counts = J._token_counts(df, 4)
    want = np.zeros(J.COUNTERS, np.uint32)
    for _, tokens in J.token_sets(pa.array(texts), 4):
        np.add.at(want, tokens % np.uint64(J.COUNTERS), 1)
    assert (counts == want).all() and counts.max() >= 2
    ((_, tokens),) = J.token_sets(pa.array([texts[1]]), 4)
    rare = J._prefix(tokens, counts, 85)
    assert len(rare) and counts[rare[0] % np.uint64(J.COUNTERS)] == 1
