import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireline.llm import media_png as M
from quireline.llm import queries


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(payload):
    assert M.decode(M.encode(payload)) == M.padded(payload)


def test_all_filters_are_undone():
    rng = random.Random(1)
    want = np.array([[rng.randrange(256) for _ in range(64)] for _ in range(50)], np.uint8)
    rows = np.empty((50, 65), np.uint8)
    for y in range(50):
        rows[y, 0] = kind = y % 5
        for x in range(64):
            a, b = int(want[y, x - 1]) if x else 0, int(want[y - 1, x]) if y else 0
            c = int(want[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            rows[y, x + 1] = (int(want[y, x]) - [0, a, b, (a + b) // 2, near][kind]) & 255
    assert (M.unfiltered(rows) == want).all()


@pytest.mark.parametrize("kinds", [[3] * 9, [4] * 9, [4, 3, 3, 4, 0, 2, 2, 4, 1]])
@pytest.mark.parametrize(("channels", "kind"), [(1, 0), (2, 4), (3, 2), (4, 6)])
def test_colour_images_of_any_filter(kinds, channels, kind):
    rng = random.Random(channels)
    width, want = 7, np.array([[rng.randrange(256) for _ in range(7 * channels)] for _ in kinds], np.uint8)
    rows = []
    for y, f in enumerate(kinds):
        row = [f]
        for x in range(width * channels):
            a, b = int(want[y, x - channels]) if x >= channels else 0, int(want[y - 1, x]) if y else 0
            c = int(want[y - 1, x - channels]) if y and x >= channels else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((int(want[y, x]) - [0, a, b, (a + b) // 2, near][f]) & 255)
        rows.append(bytes(row))
    body = zlib.compress(b"".join(rows))
    media = M.SIGNATURE + M._chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(kinds), 8, kind, 0, 0, 0)) + M._chunk(b"tEXt", b"a\0b") + M._chunk(b"IDAT", body[:9]) + M._chunk(b"IDAT", body[9:]) + M._chunk(b"IEND", b"")
    assert M.samples(media) == (width, len(kinds), channels, want.tobytes())


def test_images_that_hold_more_than_they_say():
    head = M._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 1, 8, 0, 0, 0, 0))
    for body in (zlib.compress(bytes(50_000_000)), zlib.compress(bytes(64)), zlib.compress(bytes(65))[:-3]):
        with pytest.raises(ValueError, match="samples"):
            M.decode(M.SIGNATURE + head + M._chunk(b"IDAT", body) + M._chunk(b"IEND", b""))


def test_damage_is_found():
    media = M.encode(b"some text " * 50)
    for at in (3, 20, 60, len(media) - 3):
        with pytest.raises((ValueError, zlib.error)):
            M.decode(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    with pytest.raises(ValueError):
        M.decode(media[:-5])


def test_large_payload_and_similar_features():
    payload = random.Random(2).randbytes(3_000_000)
    assert M.decode(M.encode(payload)) == M.padded(payload)
    wave = bytes(int(127 + 100 * np.sin(i / 900)) for i in range(64 * 256))
    near = bytes(min(255, x + (i % 97 == 0)) for i, x in enumerate(wave))
    distance = bin(int(M.cosine_hash(wave), 16) ^ int(M.cosine_hash(near), 16)).count("1")
    assert distance <= 8


def test_columns_with_nulls_and_damage(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "é" * 64, "x"), (3, "é" * 64, "x")], "doc_id long, text string, media string")
    stored = M.encode_column(df, "text", keep=("doc_id",))
    got = sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256) for r in M.decode_column(stored).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == [(1, 0, 64, sha(bytes(64))), (2, 0, 64, sha(bytes(64)))] + [(3, 128, 128, sha(("é" * 64).encode()))] * 2
    odd = df.selectExpr("*", "1 AS payload", "2 AS n_bytes", "3 AS feature", "4 AS problem")
    kept = M.decode_column(M.encode_column(odd, "text", keep=tuple(odd.columns)))
    assert kept.columns == ["doc_id", "text", "media_kept", "payload", "n_bytes_kept", "feature_kept", "problem_kept", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "problem"]
    assert sorted((r.doc_id, r.payload, r.n_bytes_kept, r.feature_kept, r.n_bytes) for r in kept.collect()) == [(1, 1, 2, 3, 0), (2, 1, 2, 3, 0), (3, 1, 2, 3, 128), (3, 1, 2, 3, 128)]
    bad = spark.createDataFrame([(1, bytearray(b"nope")), (2, None)], "doc_id long, media binary")
    assert all(r.problem and r.payload_bytes is None for r in M.decode_column(bad).collect())
    assert M.decode_column(M.encode_column(df.limit(0), "text", keep=("doc_id",))).count() == 0


def test_query(spark, sf):
    texts = {r.doc_id: (r.text or "").encode() for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op9_media_png(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        whole = M.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(texts[r.doc_id]), len(whole), zlib.crc32(whole[-64:]))
        assert r.payload_sha256 == hashlib.sha256(whole).hexdigest()
        media = M.encode(texts[r.doc_id])
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature == plain_hash(whole)


def plain_hash(samples):
    """The feature by sums over single samples."""
    image = np.frombuffer(samples, np.uint8).reshape(-1, 64).astype(float)
    n = len(image)
    tall = np.array([image[y * n // 32 : max((y + 1) * n // 32, y * n // 32 + 1)].mean(0) for y in range(32)])
    small = tall.reshape(32, 32, 2).mean(2)
    angle = [[math.cos(math.pi * (2 * i + 1) * k / 64) for i in range(32)] for k in range(8)]
    low = np.rint([sum(angle[u][y] * float(np.dot(small[y], angle[v])) for y in range(32)) * 1024 for u in range(8) for v in range(8)])
    return np.packbits(low > np.median(low[1:])).tobytes().hex()
