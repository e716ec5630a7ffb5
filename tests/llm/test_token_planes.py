import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quireline.llm import queries
from quireline.llm import token_planes as T

LIBRARY = Tokenizer.from_file(queries.vocabulary_path())


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [queries.END_ID]


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32).astype("<u4")
    assert (T.ids_of(T.planes_of(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_file_round_trip_and_random_access(kind):
    rng = random.Random(1)
    docs = [(i, np.array([rng.randrange(50_000) for _ in range(rng.choice([0, 1, 15, 16, 17, 300]))], "<u4")) for i in range(40)]
    out = io.BytesIO()
    writer = T.Writer(out, kind, block_ids=16)
    for i, ids in docs:
        writer.add(i, ids.tobytes())
    writer.close()
    shard = T.Reader(io.BytesIO(out.getvalue()))
    whole, before = np.concatenate([d for _, d in docs]), 0
    assert (shard.block(5) == whole[80:96]).all()
    for (i, ids), (doc, start, pieces) in zip(docs, shard.documents(), strict=True):
        assert (doc, start) == (i, before)
        assert [x for p in pieces for x in p] == ids.tolist()
        before += len(ids)
    damaged = bytearray(out.getvalue())
    damaged[-60] ^= 1
    with pytest.raises(ValueError):
        T.Reader(io.BytesIO(bytes(damaged)))


def test_library_pieces_equal_whole_texts():
    encoder, rng = T.LibraryEncoder(queries.vocabulary_path()), random.Random(2)
    pools = ["abcdefghij'st ", " \n\t\x0b\x1c\x85\xa0éÉßİΣσςñ漢字", "0123½", "!?.<|endoftext|>", "̧́", "\U0001f600﻿\x00 "]
    for text in ["Word. word, WORD word!? İx Ünd. a. ' 's it's. x..,", "a'' b's' c<|endoftext|> d<|endoftext|>*** é<= a\u0338 <\u0338 x<\u0338 don't' ***a*** É.***", "." * 300 + " " + "a" * 300 + "."]:
        assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    for _ in range(500):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60)))
        assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_other_files_go_to_the_library_whole():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, texts = Tokenizer.from_file(path), ["", "It's  Words\nand 123 more", " leading é 漢字 "]
    encoder = T.LibraryEncoder(path)
    assert not encoder.words and T.LibraryEncoder(queries.vocabulary_path()).words
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_that_are_not_taken_are_passed_over():
    out, docs = io.BytesIO(), [(i, np.arange(i * 10, dtype="<u4")) for i in range(9)]
    writer = T.Writer(out, "byte", block_ids=16)
    for i, ids in docs:
        writer.add(i, ids.tobytes())
    writer.close()
    for (i, ids), (doc, _, pieces) in zip(docs, T.Reader(io.BytesIO(out.getvalue())).documents(), strict=True):
        assert doc == i and (i % 2 == 0 or [x for p in pieces for x in p] == ids.tolist())


def test_a_row_that_repeats_is_dealt_to_many_tasks(spark):
    df = spark.createDataFrame([(1, "same text")] * 400 + [(2, "other")], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = T.write_shards(df, queries.vocabulary_path(), end_id=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    counts = [r.n_docs for r in shards.collect()]
    assert sum(counts) == 401 and max(counts) < 300
    assert {r.n_tokens for r in T.read_documents(T.shard_rows(spark, shards), "bigint").collect()} == {len(ids_of("same text")), len(ids_of("other"))}


def test_shards_with_nulls_repeats_and_long_texts(spark):
    rows = [(5, "five five"), (None, "none"), (2, None), (2, "two"), (2, "two"), (9, "x" * 5000), (7, "word " * 200_000), (-3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS data", "1 AS shard").repartition(3)
    shards = T.write_shards(df, queries.vocabulary_path(), end_id=1)
    got = sorted(T.read_documents(T.shard_rows(spark, shards), "bigint").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -3, 2, 2, 2, 5, 7, 9]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert sorted(r.n_tokens for r in got) == sorted(len(ids_of(t)) for _, t in rows)
    empty = T.write_shards(df.limit(0), queries.vocabulary_path(), end_id=1)
    assert T.read_documents(empty, "bigint").count() == 0


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    got, start = {r.doc_id: r for r in queries.op4_token_planes(spark, sf).collect()}, 0
    assert len(got) == len(texts)
    for doc in sorted(texts):
        ids = ids_of(texts[doc])
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_remembered_pieces_stay_few():
    encoder = T.LibraryEncoder(queries.vocabulary_path())
    for low in range(0, 400_000, 50_000):
        encoder.encode([" ".join(f"{i}," for i in range(low, low + 50_000)).encode()])
    assert len(encoder.known) < 400_000
