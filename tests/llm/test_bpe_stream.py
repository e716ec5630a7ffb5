import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quireline.llm import bpe_stream as B
from quireline.llm import queries

PATH = queries.vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)


def both(text, feeds=None):
    encoder, decoder = B.Encoder(PATH), B.Decoder(PATH)
    data = text.encode()
    size = feeds or max(1, len(data))
    ids = np.frombuffer(b"".join([*(encoder.feed(data[i : i + size]) for i in range(0, len(data), size)), encoder.finish()]), "<u4")
    return ids.tolist(), "".join([*(decoder.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)), decoder.finish()])


def library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.integers(1, 9))
def test_any_text_in_any_feeds(text, size):
    assert both(text, size) == library(text)


ODD = ["", " \n", "It's we'll THE<|endoftext|>x<|startoftext|> <|EndOfText|>", "a\x1cb \x85c\xa0d", "ΣΑΣ İx", "é é 漢字 ½ 12", "\U0001f44d\U0001f3fd!!??"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert both(text) == library(text)


def test_long_pre_tokens_stream_in_constant_memory():
    rng = random.Random(4)
    for letters in ("ab", "inthe", "etaoinshr", "a", "é漢a", "!?"):
        text = "".join(rng.choice(letters) for _ in range(6000))
        assert both(text) == library(text)
    stream = B.Transducer(B.model(PATH))
    for _ in range(200):
        list(stream.feed(b"theandinger" * 50))
        assert len(stream.waiting) <= 2 * stream.held.lookahead


@pytest.mark.parametrize("letters", ["漢字語", "a", "'", "!?'", "é", "e\u0301", "한글", "\u1112\u1161\u11ab", "x1", "'ref", "ñ\xa0ô", "\u0301", "<|endoftext|>", "q<"])
def test_texts_without_white_space_are_cut_anywhere(letters, monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice(letters) if len(letters) < 9 else letters for _ in range(3000 if len(letters) < 9 else 300))
    monkeypatch.setattr(B, "FEED_BYTES", 97)
    monkeypatch.setattr(B, "SEARCHED", 90)
    for size in (7, 50, 400):
        assert both(text + " end", size) == library(text + " end")
        assert both("it's " + text, size) == library("it's " + text)


def test_a_long_text_without_white_space_holds_little():
    encoder, rng = B.Encoder(PATH), random.Random(6)
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(700_000))
    data, n, hashed = text.encode(), 0, hashlib.sha256()
    for low in range(0, len(data), B.FEED_BYTES):
        ids = encoder.feed(data[low : low + B.FEED_BYTES])
        hashed.update(ids)
        n += len(ids) // 4
        assert len(encoder.rest) <= B.FEED_BYTES and (encoder.open is None or len(encoder.open.waiting) <= 2 * encoder.held.lookahead)
    hashed.update(encoder.finish())
    assert hashed.hexdigest() == hashlib.sha256(np.array(library(text)[0], "<u4").tobytes()).hexdigest() and n > 1_000_000


def test_merging_together_is_merging_one_by_one():
    held, rng = B.model(PATH), random.Random(7)
    words = ["".join(rng.choice("etaoinshrdluéß!") for _ in range(rng.randrange(1, 40))).encode() for _ in range(5000)]
    singly = [np.array(held.merged([*(held.inner[b] for b in w[:-1]), held.final[w[-1]]]), "<u4").tobytes() for w in words]
    assert held.merged_many(words) == singly and held.merged_many([]) == []


def test_other_files_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="cannot be encoded"):
        B.Model(public_tokenizers.path("byte_bpe_50k.json"))


def test_a_lookahead_that_is_too_short_fails():
    held = B.Model(PATH)
    rng = random.Random(4)
    texts = ["".join(rng.choice("etaoinshr") for _ in range(3000)) for _ in range(5)]

    def run(ahead):
        held.lookahead = ahead
        out = []
        for t in texts:
            stream = B.Transducer(held)
            out.append([*stream.feed(t.encode()), *stream.finish()])
        return out

    assert run(146) == [library(t)[0] for t in texts] != run(2)


def test_columns(spark):
    rows = [(1, None), (2, ""), (3, "The Cat sat"), (3, "The Cat sat"), (4, "word " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids", "'x' AS decoded", "'x' AS __in", "'x' AS n_tokens", "1 AS ids_sha256", "1 AS `a.b`")
    kept = B.digests(df, PATH, keep=tuple(df.columns))
    assert kept.columns == ["doc_id", "text", "ids", "decoded", "__in", "n_tokens_kept", "ids_sha256_kept", "a.b", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert [(r.doc_id, r.text, r.n_tokens, r.n_tokens_kept) for r in kept.collect()] == [(i, t, len(library(t or "")[0]), "x") for i, t in rows]
    got = B.decode_column(B.encode_column(df, PATH), PATH).collect()
    assert [(r.doc_id, r.n_tokens, r.decoded) for r in got] == [(i, len(library(t or "")[0]), library(t or "")[1]) for i, t in rows]
    assert B.digests(df.limit(0), PATH).count() == 0


def test_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op8_bpe_stream(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, decoded = library(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
