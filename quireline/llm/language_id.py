"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, each permuted (rotated) by its
place, and a text's vector bundles (adds) those of its n-grams. A language's prototype bundles the unit vectors of its training texts, less
the mean of all languages, which holds what they share. A text gets the language whose prototype is nearest by cosine.

Bundling is linear, so a batch of texts is a matrix of n-gram counts times the n-gram vectors that occur in it: no step looks at less than
the whole text, and memory is bounded by the batch. Training takes about ``per_language`` distinct texts with a letter of each language, those
with the smallest hash of their text (a bound met on average), and all of a language that has no more; copies do not change the share. Prediction is row-wise, without a shuffle.

Letters beyond a to z share ``CLASSES`` - 27 classes by a hash, so scripts of many letters have some n-grams in common.

Text that is null or has no letter is ``und`` with score 0. Rows with null text or language are not trained on. With no training rows at
all everything is ``und`` (``Profiles.names`` is empty then, which tells it from a text without letters). Repeated rows are judged alike.
Kept columns may have any names (see ``columns``).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireline.llm.columns import Kept, named
from quireline.llm.storage import small_batches

UNKNOWN = "und"
#: Dimensions of the vectors, letters of an n-gram, classes of letters (class 0: anything else).
DIMENSIONS, GRAM, CLASSES = 1024, 3, 128
#: Texts of a language that are learnt from at most.
PER_LANGUAGE = 2000
#: Letters that one matrix product takes.
ROUND_CHARS = 1 << 20


@cache
def classes() -> np.ndarray:
    """Class of each code point: 0 for no letter, 1 to 26 for a to z, others by their lower-case letter."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        char = chr(point)
        if unicodedata.category(char)[0] == "L":
            low = char.lower()[0]
            table[point] = ord(low) - 96 if "a" <= low <= "z" else 27 + (ord(low) * 2654435761 >> 7) % (CLASSES - 27)
    return table


@cache
def letters() -> np.ndarray:
    """A vector of +1 and -1 for each class."""
    return (np.random.default_rng(20240607).integers(0, 2, (CLASSES, DIMENSIONS)) * 2 - 1).astype(np.int8)


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """Vectors of n-grams given as numbers in base CLASSES."""
    out = np.ones((len(codes), DIMENSIONS), np.int8)
    for place in range(GRAM):
        own = letters()[codes // CLASSES**place % CLASSES]
        out *= np.roll(own, place, axis=1)
    return out.astype(np.float32)


def bundles(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, vectors of some rows, whether a row has a letter)."""
    low = 0
    while low < len(texts):
        high, chars = low, 0
        while high < len(texts) and (high == low or chars + len(texts[high] or "") <= ROUND_CHARS):
            chars += len(texts[high] or "")
            high += 1
        own = [t or "" for t in texts[low:high]]
        points = np.frombuffer((" " + " ".join(own) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = classes()[points]
        row = np.repeat(np.arange(len(own)), [len(t) + 1 for t in own])
        row = np.append(row, len(own) - 1)
        letter = np.bincount(row[kind > 0], minlength=len(own)) > 0
        keep = np.ones(len(kind), bool)
        keep[1:] = (kind[1:] > 0) | (kind[:-1] > 0)
        kind, row = kind[keep].astype(np.int32), row[keep]
        n = max(0, len(kind) - GRAM + 1)
        codes, whole = np.zeros(n, np.int32), row[:n] == row[GRAM - 1 :]
        for place in range(GRAM):
            codes = codes * CLASSES + kind[place : place + n]
        codes, of = codes[whole], row[:n][whole]
        present = np.flatnonzero(np.bincount(codes, minlength=1))
        vectors = np.zeros((len(own), DIMENSIONS), np.float32)
        if len(present):
            place = np.zeros(present[-1] + 1, np.int32)
            place[present] = np.arange(len(present))
            spot = place[codes]
            step = max(1, (2 << 20) // len(present))
            for a in range(0, len(own), step):
                b = min(len(own), a + step)
                inside = (of >= a) & (of < b)
                counts = np.bincount((of[inside] - a) * len(present) + spot[inside], minlength=(b - a) * len(present))
                counts = np.sqrt(counts.reshape(b - a, -1).astype(np.float32))
                for c in range(0, len(present), 4096):
                    vectors[a:b] += counts[:, c : c + 4096] @ gram_vectors(present[c : c + 4096])
        yield low, vectors, letter
        low = high


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


class Profiles:
    """Prototypes of languages."""

    def __init__(self, names: list[str], sums: np.ndarray):
        self.names = names
        each = unit(sums) if len(names) else np.zeros((0, DIMENSIONS), np.float32)
        self.centre = each.mean(0) if len(names) > 1 else np.zeros(DIMENSIONS, np.float32)
        self.prototypes = unit(each - self.centre).astype(np.float32)

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """Cosines of texts (less the languages' mean) and prototypes."""
        return np.clip(unit(unit(vectors) - self.centre) @ self.prototypes.T, -1, 1)


def held_out_fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        names = batch.column("lang").to_pylist()
        for low, vectors, letter in bundles(batch.column("text").to_pylist()):
            for i in np.flatnonzero(letter):
                name = names[low + i]
                total[name] = total.get(name, 0) + unit(vectors[i]).astype(np.float64)
    if total:
        yield pa.RecordBatch.from_pydict({"lang": [*total], "vector": [v.tobytes() for v in total.values()]}, pa.schema([("lang", pa.string()), ("vector", pa.binary())]))


def train(rows: DataFrame, *, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Profiles:
    """Prototypes from ``rows``. What reaches the driver: a count for each language with more than per_language texts, and a vector for each
    language and task, as prototypes of all languages are held by every task anyway."""
    small_batches(rows.sparkSession)
    held = rows.select(named(text).cast("string").alias("text"), named(lang).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL").filter(F.col("text").rlike(r"\p{L}"))
    counts = held.select("lang", F.xxhash64("text").alias("hash")).distinct().groupBy("lang").count().filter(F.col("count") > per_language).collect()
    # of languages with more texts, those up to a bound of the hash; all texts of the others
    bounds = [x for r in counts for x in (F.lit(r.lang), F.lit(2.0 * per_language / r["count"] - 1))]
    if bounds:
        bound = F.try_element_at(F.create_map(*bounds), F.col("lang"))
        held = held.filter(bound.isNull() | (F.xxhash64("text") / F.lit(2.0**63) < bound))
    sample = held.distinct()
    total: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(_sums, "lang string, vector binary").collect():
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.vector, np.float64)
    names = sorted(total)
    return Profiles(names, np.stack([total[n] for n in names]).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32))


def predict(rows: DataFrame, profiles: Profiles, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``lang_pred`` and ``score`` (the best cosine, 0 if negative)."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(profiles)
    kept = Kept(keep, ("lang_pred", "score"))
    source = kept.places[kept.names.index(text)] if text in kept.names else "__text"  # a kept text travels once
    held = rows.select(*kept.held(), *([] if text in kept.names else [named(text).cast("string").alias(source)]))
    schema = held.select(*kept.places, F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if model.names:
                for low, vectors, letter in bundles(batch.column(source).to_pylist()):
                    cosines = model.scores(vectors)
                    best = cosines.argmax(1)
                    for i in np.flatnonzero(letter):
                        names[low + i] = model.names[best[i]]
                        scores[low + i] = max(0.0, float(cosines[i, best[i]]))
            passed = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in passed), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*passed, "lang_pred", "score"])

    return held.mapInArrow(run, schema).select(*kept.back(), "lang_pred", "score")
