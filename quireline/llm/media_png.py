"""Media columns: bytes as an 8-bit greyscale PNG in a binary column, read back chunk by chunk, with a cosine-transform hash.

``encode_column`` pads each payload with zero bytes to a positive multiple of the image's width and stores it as a PNG whose rows use the
filter (none, left or above) with the smallest sum of absolute residuals. ``decode_column`` checks the signature and every chunk's CRC-32,
inflates the image data, no further than the header says, and undoes all five row filters with numpy: whole rows at a time, or for the
two filters that need the byte before, all bytes of a diagonal at a time. Both are row-wise, so there is no shuffle. ``samples`` reads 8-bit
images of any colour type but palettes, without interlace; features are of greyscale images.

Null payloads count as empty: one row of zero bytes. A damaged image raises ``ValueError`` in ``decode`` and gives nulls and a ``problem``
text in ``decode_column``. Equal payloads give equal images and features. Kept columns may have any names (see ``columns``).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireline.llm.columns import Kept, named
from quireline.llm.storage import small_batches

WIDTH = 64
#: Bytes of compressed image data in one chunk, and rows that are filtered at once.
CHUNK_BYTES, BLOCK_ROWS = 1 << 16, 1 << 14
#: Side of the reduced image and of its low-frequency corner.
SIDE, CORNER = 32, 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type (grey, colour, grey and alpha, colour and alpha).
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}

_cosine = np.cos(np.pi * (2 * np.arange(SIDE) + 1)[None, :] * np.arange(CORNER)[:, None] / (2 * SIDE))


def padded(payload: bytes, width: int = WIDTH) -> bytes:
    return payload + bytes(-len(payload) % width if payload else width)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _filtered(rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows with the filter byte in front; ``above`` is the row before the first."""
    left, up = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    up[0] -= above
    choices = np.stack([rows, left, up])
    cost = np.minimum(choices, 256 - choices.astype(np.int16)).sum(2)
    # unfiltered text deflates best, so a filter has to win clearly
    cost[0] //= 4
    best = cost.argmin(0).astype(np.uint8)
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = choices[best, np.arange(len(rows))]
    return out


def encode(payload: bytes, width: int = WIDTH, level: int = 3) -> bytes:
    rows = np.frombuffer(padded(payload, width), np.uint8).reshape(-1, width)
    out = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0))]
    packer, above, data = zlib.compressobj(level), np.zeros(width, np.uint8), bytearray()
    for low in range(0, len(rows), BLOCK_ROWS):
        block = rows[low : low + BLOCK_ROWS]
        data += packer.compress(_filtered(block, above).tobytes())
        above = block[-1]
    data += packer.flush()
    out += [_chunk(b"IDAT", bytes(data[i : i + CHUNK_BYTES])) for i in range(0, len(data), CHUNK_BYTES)]
    return b"".join([*out, _chunk(b"IEND", b"")])


def _diagonals(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Undoes filters 3 (mean) and 4 (nearest of left, above, above left) of some rows. A byte needs the ones before it in its row and in the row
    above, so that all bytes with one sum of row and pixel can be done together. ``above`` is the row before the first."""
    height, width = len(rows), rows.shape[1] // step
    out = np.zeros((height + 1, width + 1, step), np.int16)
    out[0, 1:] = above.reshape(width, step)
    values, mean = rows.reshape(height, width, step), (kinds == 3)[:, None]
    for place in range(height + width - 1):
        y = np.arange(max(0, place - width + 1), min(height, place + 1))
        x = place - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        far_left, far_up, far_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((far_left <= far_up) & (far_left <= far_corner), left, np.where(far_up <= far_corner, up, corner))
        out[y + 1, x + 1] = (values[y, x] + np.where(mean[y], (left + up) >> 1, nearest)) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, -1)


def unfiltered(rows: np.ndarray, step: int = 1) -> np.ndarray:
    """Undo row filters; ``step``: bytes of a pixel. Runs of rows with one filter, or with filters 3 and 4, are done together."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise ValueError("unknown row filter")
    lefts, pixels = kinds == 1, out.reshape(len(out), out.shape[1] // step, step)
    pixels[lefts] = np.cumsum(pixels[lefts], axis=1, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.minimum(kinds, 3))) + 1
    for low, high in zip([0, *edges], [*edges, len(kinds)], strict=True):
        above = out[low - 1] if low else np.zeros(out.shape[1], np.uint8)
        kind = int(kinds[low]) if len(kinds) else 0
        if kind == 2:
            out[low:high] = np.cumsum(out[low:high], axis=0, dtype=np.uint8) + above
        elif kind > 2:
            out[low:high] = _diagonals(kinds[low:high], out[low:high], above, step)
    return out


def samples(media: bytes) -> tuple[int, int, int, bytes]:
    """(width, height, samples of a pixel, samples) of an 8-bit PNG, checked."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, done, parts = 8, None, False, []
    while at < len(media) and not done:
        if at + 12 > len(media):
            raise ValueError("cut off chunk")
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack(">I", media[at + 8 + size : at + 12 + size].rjust(4, b"\0"))[0] != zlib.crc32(media[at + 4 : at + 8 + size]):
            raise ValueError(f"checksum of chunk {kind.decode('latin-1')}")
        if (head is None) != (kind == b"IHDR"):
            raise ValueError("header chunk not first, or again")
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("size of the header chunk")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            done = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind.decode('latin-1')}")
        at += 12 + size
    if not done or head[2] != 8 or head[3] not in CHANNELS or head[4:] != (0, 0, 0):
        raise ValueError("not a whole 8-bit image without palette and interlace")
    width, height, channels = head[0], head[1], CHANNELS[head[3]]
    if not width or not height:
        raise ValueError("empty image")
    size = height * (width * channels + 1)
    unpacker = zlib.decompressobj()
    data = unpacker.decompress(b"".join(parts), size + 1)
    if len(data) != size or not unpacker.eof:
        raise ValueError("wrong number of samples")
    return width, height, channels, unfiltered(np.frombuffer(data, np.uint8).reshape(height, -1), channels).tobytes()


def decode(media: bytes) -> bytes:
    """The samples of an 8-bit greyscale PNG, checked."""
    _, _, channels, data = samples(media)
    if channels != 1:
        raise ValueError("not greyscale")
    return data


def cosine_hash(samples: bytes, width: int = WIDTH) -> str:
    """16 hexadecimal digits: which of the 64 lowest frequencies of the image, reduced to 32 x 32 by means, lie above their median."""
    image = np.frombuffer(samples, np.uint8).reshape(-1, width)
    height = len(image)
    if height >= SIDE:
        edges = np.arange(SIDE) * height // SIDE
        tall = np.add.reduceat(image, edges, axis=0, dtype=np.float64) / np.diff(np.append(edges, height))[:, None]
    else:
        tall = image[np.arange(SIDE) * height // SIDE].astype(np.float64)
    edges = np.arange(SIDE) * width // SIDE
    small = np.add.reduceat(tall, edges, axis=1) / np.diff(np.append(edges, width))
    low = np.rint((_cosine @ small @ _cosine.T).ravel() * 1024)
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = pa.array([encode(x or b"") for x in batch.column("payload").cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in batch.schema.names if n != "payload"), media], names=[*(n for n in batch.schema.names if n != "payload"), "media"])


def encode_column(rows: DataFrame, payload: str, *, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, ``n_bytes`` of the unpadded payload, and its image ``media``. ``payload``: a string (as UTF-8) or binary column."""
    small_batches(rows.sparkSession)
    kept = Kept(keep, ("n_bytes", "media"))
    held = rows.select(*kept.held(), F.coalesce(F.octet_length(named(payload)), F.lit(0)).cast("long").alias("n_bytes"), named(payload).cast("binary").alias("payload"))
    schema = held.drop("payload").withColumn("media", F.lit(None).cast("binary")).schema
    return held.mapInArrow(_encode, schema).select(*kept.back(), "n_bytes", "media")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [n for n in batch.schema.names if n != "media"]
        out: list[list] = [[] for _ in range(7)]
        for media in batch.column("media").cast(pa.binary()).to_pylist():
            try:
                if media is None:
                    raise ValueError("no image")
                width, _, channels, data = samples(media)
                if channels != 1:
                    raise ValueError("not greyscale")
                row = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(data, width), None)
            except (ValueError, zlib.error) as e:
                row = (*[None] * 6, str(e))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "problem")
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[*kept, *names])


def decode_column(rows: DataFrame) -> DataFrame:
    """What the images of the column ``media`` hold, beside the other columns."""
    small_batches(rows.sparkSession)
    kinds = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "problem": "string"}
    kept = Kept([c for c in rows.columns if c != "media"], kinds)
    held = rows.select(*kept.held(), F.col("media"))
    schema = held.select(*kept.places, *(F.lit(None).cast(k).alias(n) for n, k in kinds.items())).schema
    return held.mapInArrow(_decode, schema).select(*kept.back(), *kinds)
