"""Benchmark decontamination by winnowing.

Each text becomes words; of every ``window - gram + 1`` consecutive k-gram hashes the smallest is kept as a fingerprint. A span of
``window`` words that a document shares with an item has the same k-gram hashes in both, hence the same smallest one, so it is found.
Fingerprint hits are extended to all windows around them, and a window counts if its hash is one of the item's. Items shorter than a
window are a window of their own length, whose fingerprint is the window itself.

Different items go to the executors in blocks of about ``block_chars`` characters, however often they repeat in the benchmark; the documents
pass through ``TOGETHER`` blocks at a time, written to the shared folder in between. So there is no shuffle, and no part of the work depends
on how often a passage repeats. Windows are compared by 64-bit hashes of their words (for 10^12 windows of documents and 10^7 of items one
false hit is expected about every second run; the hash is fixed, so a run is repeatable).

Nulls: a null text has no words. A null ``item_id`` counts as the item ``null``. Repeated rows: every document row is judged by itself;
item rows with one ``item_id`` are one item. Empty tables give no rows, or no hits. Kept columns may have any names (see ``columns``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireline.llm.columns import Kept, named
from quireline.llm.hashing import alphanumeric_mask, ngrams, word_rounds
from quireline.llm.storage import small_batches, written

#: Words of a window, and of the k-grams whose hashes are winnowed.
WINDOW, GRAM = 10, 5
#: Characters of the benchmark in a block, and blocks that one pass over the documents holds.
BLOCK_CHARS, TOGETHER = 32 << 20, 2


def winnowed(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions (rightmost of equals, ascending, once) of the smallest hash of every ``width`` consecutive ones."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, width):
        now = grams[j : j + n]
        less = now <= best
        best[less] = now[less]
        at[less] = np.flatnonzero(less) + j
    return np.unique(at)


class Index:
    """Fingerprints and windows of a block of items, as sorted arrays."""

    def __init__(self, items: list[tuple[str, str | None]], window: int, gram: int):
        self.window, self.gram = window, gram
        self.ids = sorted({i for i, _ in items})
        number = {x: n for n, x in enumerate(self.ids)}
        prints: list[np.ndarray] = []
        spans: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for low, high, at, words in word_rounds(pa.array([t for _, t in items], pa.large_string()), alphanumeric_mask()):
            for row in range(low, high):
                own = words[at[row - low] : at[row - low + 1]]
                if not len(own):
                    continue
                size = min(window, len(own))
                whole = ngrams(own, size)
                spans.setdefault(size, []).append((whole, np.full(len(whole), number[items[row][0]])))
                if size == window:
                    grams = ngrams(own, gram)
                    prints.append(grams[winnowed(grams, window - gram + 1)])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.spans = {}
        for size, found in spans.items():
            hashes, items_of = (np.concatenate(x) for x in zip(*found, strict=True))
            pairs = np.unique(np.stack([hashes, items_of.astype(np.uint64)], 1), axis=0)
            keys, first = np.unique(pairs[:, 0], return_index=True)
            self.spans[size] = (keys, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64))

    def found(self, words: np.ndarray, row_of: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words of the window, starts of windows that occur in an item, places of their hashes in that size's table)."""
        for size, (keys, _, _) in self.spans.items():
            whole = ngrams(words, size)
            if not len(whole):
                continue
            if size == self.window:
                grams = ngrams(words, self.gram)
                kept = winnowed(grams, self.window - self.gram + 1)
                place = np.searchsorted(self.prints, grams[kept])
                hit = kept[self.prints[np.minimum(place, len(self.prints) - 1)] == grams[kept]] if len(self.prints) else kept[:0]
                starts = np.unique((hit[:, None] - np.arange(self.window - self.gram + 1)).ravel())
                starts = starts[(starts >= 0) & (starts < len(whole))]
            else:
                starts = np.arange(len(whole))
            starts = starts[row_of[starts] == row_of[starts + size - 1]]
            place = np.minimum(np.searchsorted(keys, whole[starts]), len(keys) - 1)
            good = keys[place] == whole[starts]
            if good.any():
                yield size, starts[good], place[good]


def _judge(index: Index):
    """A block's pass over batches of (..., text, hits, items): hits is a bitmap of words, items a list of ids; both grow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        for batch in batches:
            names = batch.schema.names
            hits, items, counts = batch.column(names.index("hits")).to_pylist(), batch.column(names.index("items")).to_pylist(), np.zeros(batch.num_rows, np.int64)
            for low, high, at, words in word_rounds(batch.column(names.index("text")), alphanumeric_mask()):
                counts[low:high] = np.diff(at)
                row_of = np.repeat(np.arange(low, high), np.diff(at))
                marks = np.zeros(len(words) + 1, np.int64)
                touched: dict[int, set[int]] = {}
                for size, starts, place in held.found(words, row_of):
                    np.add.at(marks, starts, 1)
                    np.add.at(marks, starts + size, -1)
                    _, first, item = held.spans[size]
                    for row, p in {*zip(row_of[starts].tolist(), place.tolist(), strict=True)}:
                        touched.setdefault(row, set()).update(item[first[p] : first[p + 1]].tolist())
                covered = np.cumsum(marks[:-1]) > 0
                for row, new in touched.items():
                    own = covered[at[row - low] : at[row - low + 1]]
                    if hits[row]:
                        own = own | np.unpackbits(np.frombuffer(hits[row], np.uint8), count=len(own)).astype(bool)
                    hits[row] = np.packbits(own).tobytes()
                    items[row] = sorted({*(items[row] or ()), *(held.ids[i] for i in new)})
            columns = dict(zip(names, batch.columns, strict=True)) | {"n_words": pa.array(counts), "hits": pa.array(hits, pa.binary()), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW, gram: int = GRAM, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``text``, ``n_words``, ``hits`` (bitmap of the words inside a benchmark window, null: none) and
    ``items`` (ids of the items with such windows, sorted as strings, null: none)."""
    spark = docs.sparkSession
    small_batches(spark)
    source = benchmark.select(F.coalesce(named(item_id).cast("string"), F.lit("null")).alias("item"), named(item_text).cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    if blocks > 1:
        source = written(source, "benchmark-items")
    results = ("doc_id", "text", "n_words", "hits", "items")
    kept = Kept(keep, results)
    out = docs.select(named(doc_id).alias("doc_id"), *kept.held(), named(text).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    for block in range(blocks):
        if block and block % TOGETHER == 0:  # no more blocks than these are in memory at once
            out = written(out, "benchmark-blocks")
        rows = source.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        index = spark.sparkContext.broadcast(Index([(r.item, r.text) for r in rows], window, gram))
        out = out.mapInArrow(_judge(index), out.schema)
    return out.select("doc_id", *kept.back(), *results[1:])


def digest(items: Column) -> Column:
    return F.sha2(F.coalesce(F.array_join(items, ","), F.lit("")), 256)


def hit_words(hits: Column) -> Column:
    """Set bits of the bitmap. Bits are counted over its hexadecimal digits."""
    digits = F.hex(hits)
    ones = ["1248", "3569AC", "7BDE", "F"]
    return sum((F.lit(n + 1) * (F.length(digits) - F.length(F.translate(digits, chars, ""))) for n, chars in enumerate(ones)), F.lit(0)).cast("long")


def report(judged: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.coalesce(hit_words(F.col("hits")), F.lit(0)).cast("long")
    return judged.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), digest(F.col("items")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def brute_force(docs: list[tuple], benchmark: list[tuple], window: int = WINDOW) -> dict:
    """{doc_id: (n_words, n_hit, n_items, items_sha256)} by comparing every window of every item with every place."""
    import re

    def words(text: str | None) -> list[str]:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    out = {}
    for doc, text in docs:
        own = words(text)
        hit, items = set(), set()
        for item, item_text in benchmark:
            theirs = words(item_text)
            size = min(window, len(theirs))
            if not size:
                continue
            spans = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)}
            for i in range(len(own) - size + 1):
                if tuple(own[i : i + size]) in spans:
                    hit.update(range(i, i + size))
                    items.add(str(item))
        out[doc] = (len(own), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
    return out
