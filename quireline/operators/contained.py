"""Texts that are part of other texts, without comparing all pairs.

A text of n bytes has a level, the largest K of ``LEVELS`` with 2 K - 1 <= n. Of each K bytes in succession a hash is taken, and the least of each K
hashes in succession is a mark: what is part of a text has no marks that the text has not. The mark of a text that is rarest by the counts of
all texts is its anchor, and only texts with that mark are looked at. The longest of them comes first; those that are not part of it are compared
with all of them. Counts, anchors and the order steer the work only: what is compared is the text.

Counts are kept by ``COUNTERS`` remainders of the marks, and anchors in a bit map of at most ``MAP_BITS``, whose false hits a join removes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a piece, and pieces of a window, at each level; 0 is the level of empty texts.
LEVELS = (0, 1, 2, 8, 32, 128, 512)
#: Counters of marks, most bits of the map of anchors, values that travel as one row, and bytes of text that are taken at once.
COUNTERS, MAP_BITS, CHUNK, ROUND_BYTES = 1 << 21, 1 << 28, 1 << 14, 1 << 18
_P = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int, known: list = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if not known or len(known[0]) < n:
        size = max(n, 2 * ROUND_BYTES)
        known[:] = [np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, x % (1 << 64), np.uint64)))) for x in (_P, pow(_P, -1, 1 << 64))]
    return known[0], known[1]


def marks(data: np.ndarray, at: np.ndarray, groups: np.ndarray, levels: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, rows, marks) of the texts whose bytes are ``data`` between the offsets ``at``; a mark may come more than once. ``groups``: a 64-bit
    number of each text; the marks of different ones differ."""
    n, sizes = len(data), np.diff(at)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[:n], out=total[1:])
    for level in levels:
        if not level:
            yield 0, np.arange(len(sizes)), _mixed(groups)
            continue
        starts = n - 2 * level + 2
        if starts <= 0:
            continue
        least = _mixed((total[level:] - total[: n - level + 1]) * inverse[: n - level + 1])
        step = 1
        while step < level:  # the least of each 2, 4, .. level in succession
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        fresh = np.ones(starts, bool)
        fresh[1:] = least[1:] != least[:-1]
        first = at[:-1][sizes >= 2 * level - 1]
        fresh[first] = True
        place = np.flatnonzero(fresh)
        row = np.searchsorted(at, place, side="right") - 1
        own = place + 2 * level - 1 <= at[row + 1]
        place, row = place[own], row[own]
        yield level, row, _mixed(least[place] ^ groups[row] ^ np.uint64(level * 0x51ED270B % (1 << 64)))


def _rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(some rows, bytes of their texts, offsets, groups); a longer text is a round of its own."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        groups, low = batch.column("grp").to_numpy().view(np.uint64), 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(at, at[low] + ROUND_BYTES, side="right")) - 1)
            yield batch.slice(low, high - low), data[at[low] : at[high]], at[low : high + 1] - at[low], groups[low:high]
            low = high


def chunks_of(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, data) of an array of counts, each chunk in the smallest type that holds it; chunks of zeros are left out."""
    for i in range(0, len(values), CHUNK):
        own = values[i : i + CHUNK]
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK], pa.int32()), pa.array([own.astype(np.min_scalar_type(own.max())).tobytes()], pa.binary())], names=["chunk", "data"])


def sum_of(chunks: DataFrame, size: int) -> np.ndarray:
    """The sum of the arrays that ``chunks_of`` dealt out, added up by the executors: the driver gets one row for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist(), strict=True):
                own = held.setdefault(chunk, np.zeros(min(CHUNK, size - chunk * CHUNK), np.uint64))
                own += np.frombuffer(data, f"<u{len(data) // len(own)}")
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes() for x in held.values()], pa.binary())], names=["chunk", "data"])

    out = np.zeros(size, np.uint32)
    for chunk, data in chunks.repartition("chunk").mapInArrow(run, "chunk int, data binary").collect():
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(data, "<u4")
    return out


def _counts(texts: DataFrame, levels: list[int]) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(COUNTERS, np.uint32)
        for _, data, at, groups in _rounds(batches):
            for _, _, found in marks(data, at, groups, levels):
                place, n = np.unique(found % np.uint64(COUNTERS), return_counts=True)
                out[place] += n.astype(np.uint32)
        yield from chunks_of(out)

    return sum_of(texts.select("grp", "text").mapInArrow(run, "chunk int, data binary"), COUNTERS)


def _anchors(texts: DataFrame, levels: list[int], counts) -> DataFrame:
    """id, anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counts.value
        for rows, data, at, groups in _rounds(batches):
            sizes, ids = np.diff(at), rows.column("id")
            own = np.array([0, *(2 * x - 1 for x in LEVELS[1:])])
            level_of = np.array(LEVELS)[np.searchsorted(own, sizes, side="right") - 1]
            for level, row, found in marks(data, at, groups, levels):
                some = level_of[row] == level
                row, found = row[some], found[some]
                order = np.lexsort((found, held[found % np.uint64(COUNTERS)], row))
                row, found = row[order], found[order]
                first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else row
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[first])), pa.array(found[first].view(np.int64))], names=["id", "anchor"])

    return texts.select("id", "grp", "text").mapInArrow(run, "id binary, anchor long")


def _map_of(anchors: DataFrame) -> np.ndarray:
    """Bits at the anchors' remainders, sixteen an anchor or more; each executor makes its chunks of the map."""
    bits = min(MAP_BITS, 1 << max(17, (16 * anchors.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch.column("anchor").to_numpy().view(np.uint64) % np.uint64(bits)
            for chunk in np.unique(place >> np.uint64(17)).tolist():
                own = place[place >> np.uint64(17) == chunk] & np.uint64((1 << 17) - 1)
                held.setdefault(chunk, np.zeros(1 << 17, bool))[own] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], names=["chunk", "data"])

    out = np.zeros(bits // 8, np.uint8)
    chunk = F.shiftright(F.expr(f"cast(((anchor % {bits}) + {bits}) % {bits} as long)"), 17)
    for chunk, data in anchors.repartition(chunk).mapInArrow(run, "chunk int, data binary").collect():
        out[chunk << 14 : (chunk + 1) << 14] = np.frombuffer(data, np.uint8)
    return out


def _holders(texts: DataFrame, levels: list[int], shared) -> DataFrame:
    """id, size, anchor: the marks of each text that are anchors, and some more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for rows, data, at, groups in _rounds(batches):
            sizes, ids = np.diff(at), rows.column("id")
            for _, row, found in marks(data, at, groups, levels):
                place = found % np.uint64(8 * len(held))
                hit = (held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
                row, found = row[hit == 1], found[hit == 1]
                order = np.lexsort((found, row))
                row, found = row[order], found[order]
                if len(row):
                    fresh = np.concatenate(([True], (row[1:] != row[:-1]) | (found[1:] != found[:-1])))
                    row, found = row[fresh], found[fresh]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(sizes[row]), pa.array(found.view(np.int64))], names=["id", "size", "anchor"])

    return texts.select("id", "grp", "text").mapInArrow(run, "id binary, size long, anchor long")


def candidates(texts: DataFrame, inside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (id, anchor) and (id, size, anchor): a text of ``inside`` that is part of one of ``texts`` of its group has an anchor which that one
    holds. Both have id (binary, of a text in a group), grp (a 64-bit number of the group) and text, none of them null. The first is persisted."""
    spark = texts.sparkSession
    size = F.octet_length("text")
    lowest = [0, *(2 * x - 1 for x in LEVELS[1:])]
    used = inside.select(*(F.max((size >= a) & ((size < b) if b else F.lit(True))) for a, b in zip(lowest, [*lowest[1:], None], strict=True))).first()
    levels = [x for x, is_used in zip(LEVELS, used, strict=True) if is_used]
    counts = spark.sparkContext.broadcast(_counts(texts, levels))
    anchors = _anchors(inside, levels, counts).persist(StorageLevel.DISK_ONLY)
    held = spark.sparkContext.broadcast(_map_of(anchors))
    return anchors, _holders(texts, levels, held)
