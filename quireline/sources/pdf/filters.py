"""Stream filters with limits on what they may give."""

from __future__ import annotations

import re
import zlib

import numpy as np

#: Bytes that one stream may decode to.
STREAM_LIMIT = 64 << 20


class FilterError(ValueError):
    pass


def flate(data: bytes) -> bytes:
    """Zlib, with or without its header; what can be had of a damaged stream."""
    for window in (15, -15):
        unpacker, out, rest = zlib.decompressobj(window), bytearray(), data
        try:
            while rest and not unpacker.eof:
                out += unpacker.decompress(rest, min(1 << 16, STREAM_LIMIT + 1 - len(out)))
                if len(out) > STREAM_LIMIT:
                    raise FilterError("stream decodes to too much")
                rest = unpacker.unconsumed_tail
            return bytes(out)
        except zlib.error:
            if out:
                return bytes(out)
    raise FilterError("not a deflate stream")


def lzw(data: bytes, early: int = 1) -> bytes:
    out, table, width = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9
    bits = held = 0
    before = b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        held &= (1 << bits) - 1
        if code == 256:
            del table[258:]
            width, before = 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            entry = table[code]
        elif before and code == len(table):
            entry = before + before[:1]
        else:
            raise FilterError("bad code")
        out += entry
        if len(out) > STREAM_LIMIT:
            raise FilterError("stream decodes to too much")
        if before and len(table) < 4096:
            table.append(before + entry[:1])
        before = entry
        width = min(12, max(9, (len(table) + early).bit_length()))
    return bytes(out)


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        out += data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        at += n + 2 if n < 128 else 2
        if len(out) > STREAM_LIMIT:
            raise FilterError("stream decodes to too much")
    return bytes(out)


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"\s", b"", data.split(b">")[0])
    if re.search(rb"[^0-9A-Fa-f]", digits):
        raise FilterError("not hexadecimal")
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii_85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for byte in re.sub(rb"\s", b"", data.split(b"~")[0]).removeprefix(b"<~"):
        if byte == 0x7A and not group:
            out += bytes(4)
            continue
        if not 33 <= byte <= 117:
            raise FilterError("not base 85")
        group.append(byte - 33)
        if len(group) == 5:
            out += _base85(group)
            group = []
    if len(group) > 1:
        out += _base85(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _base85(group: list[int]) -> bytes:
    value = 0
    for d in group:
        value = value * 85 + d
    return (value & 0xFFFFFFFF).to_bytes(4, "big")


def unpredicted(data: bytes, predictor: int, columns: int = 1, colors: int = 1, depth: int = 8) -> bytes:
    """PNG row filters and the TIFF difference of 8-bit samples."""
    if predictor < 2:
        return data
    step, width = max(1, colors * depth // 8), (colors * depth * columns + 7) // 8
    if not 0 < width <= STREAM_LIMIT:
        raise FilterError("bad predictor parameters")
    if predictor == 2:
        if depth != 8:
            raise FilterError("only 8-bit differences")
        rows = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    out, above = bytearray(), np.zeros(width, np.uint8)
    for at in range(0, len(data), width + 1):
        kind, row = data[at], np.frombuffer(data[at + 1 : at + 1 + width].ljust(width, b"\0"), np.uint8)
        if kind == 1:
            padded = np.pad(row, (0, -width % step)).reshape(-1, step)
            row = np.cumsum(padded, axis=0, dtype=np.uint8).ravel()[:width]
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            row = _mixed(kind, row.tolist(), above.tolist(), step)
        elif kind > 4:
            raise FilterError("bad row filter")
        out += row.tobytes()
        above = row
    return bytes(out)


def _mixed(kind: int, row: list[int], above: list[int], step: int) -> np.ndarray:
    done = []
    for i, value in enumerate(row):
        left, up, corner = (done[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            guess = min((left, up, corner), key=lambda x: abs(p - x))
        done.append((value + guess) & 255)
    return np.array(done, np.uint8)
