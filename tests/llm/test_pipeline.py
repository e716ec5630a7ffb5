import hashlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from quireline.llm import decontaminate, jaccard_join, queries


def brute_force(docs, items):
    """{doc_id: (n_tokens, ids_sha256, decoded_sha256)} of what the stages keep."""
    docs = {i: t for i, t in docs if t and any(c.isalpha() for c in t)}
    lowest = jaccard_join.brute_force([*docs.items()], corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILARITY)
    docs = {i: t for i, t in docs.items() if lowest[i][1] == i}
    hit = decontaminate.brute_force([*docs.items()], items)
    library, out = Tokenizer.from_file(queries.vocabulary_path()), {}
    for i, t in docs.items():
        if not hit[i][1]:
            ids = library.encode(t, add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            out[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    return out


def rows(df):
    return {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()}


def test_run_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    want = brute_force(docs, items)
    assert rows(corpus_pipeline.run(spark, sf)) == want
    assert 0 < len(want) < len(docs)


def test_stages_keep_columns_and_take_odd_tables(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(40))
    data = [(1, words, "en", "a", 1), (2, words + " more", "en", "a", 1), (3, None, None, None, None), (4, "... 123", "en", "b", 2), (5, "passage " + words.replace("w", "v"), "de", "b", 2), (6, "short text", None, "b", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, words.replace("w", "v"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (spark.createDataFrame(data, schema), spark.createDataFrame([], schema)):
        docs = table
        kept = []
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == table.columns
            kept.append(sorted(r.doc_id for r in docs.collect()))
        assert kept == ([[1, 2, 5, 6], [1, 5, 6], [1, 6], [1, 6]] if table.count() else [[]] * 4)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def benchmark_table(spark, folder):
    spark.createDataFrame([(1, "none of these words is in any document here at all")], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")


def test_rows_with_one_doc_id(spark, tmp_path):
    benchmark_table(spark, tmp_path)
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    data = [
        (1, text[0], "en", "a", 1),
        (2, text[0], "en", "a", 1),  # a copy of 1
        (2, text[1], "en", "a", 1),  # of the same id, but a text of its own
        (3, text[2], "en", "a", 1),
        (3, text[2], "en", "b", 2),  # the same row again
        (4, text[3], "en", "a", 1),
        (4, text[3] + " more", "en", "a", 1),  # a near copy with the same id
        (None, text[4], "en", "a", 1),
        (None, text[4], "en", "a", 1),
        (None, text[5], "en", "a", 1),
        (7, text[5], "en", "a", 1),
    ]
    for _ in range(2):
        left = corpus_pipeline.near_copies(spark, spark.createDataFrame(data, SCHEMA), str(tmp_path)).collect()
        found = sorted((-1 if r.doc_id is None else r.doc_id, r.text[0]) for r in left)
        assert found == [(-1, "e"), (1, "a"), (2, "b"), (3, "c"), (4, "d"), (7, "f")]
        data = data[::-1]


def test_nothing_to_learn_from_loses_nothing(spark, tmp_path):
    data = [(1, "some words", None, "a", 1), (2, None, None, "a", 1), (3, "12 !", None, "a", 1), (4, "other words", None, "a", 1)]
    for lang in (None, "en"):
        docs = spark.createDataFrame([(*r[:2], lang if r[0] == 3 else None, *r[3:]) for r in data], SCHEMA)
        assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()) == [1, 4]


def test_columns_of_any_name_pass_through(spark, tmp_path):
    benchmark_table(spark, tmp_path)
    data = [(1, "some words of a text", "en", "a", 1), (2, "other words that are not at all alike", "en", "a", 1), (2, "other words that are not at all alike", "en", "a", 1)]
    extra = ["score", "lang_pred", "n_words", "hits", "items", "row", "hash", "mark", "m", "h", "item", "one", "group_id", "component_id", "tk", "node", "__text", "__in", "__k0", "a.b", "value"]
    docs = spark.createDataFrame(data, SCHEMA).selectExpr("*", *(f"'{i}' AS `{c}`" for i, c in enumerate(extra)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, str(tmp_path))
        assert left.columns == docs.columns and left.schema.simpleString() == docs.schema.simpleString(), name
        rows = left.collect()
        assert len(rows) == (2 if name == "near_copies" else 3) and all(r[5 + i] == str(i) for r in rows for i in range(len(extra)))
    assert corpus_pipeline.tokens(spark, docs, str(tmp_path)).count() == 3
