"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding with an incremental byte-to-text state machine.

The merge list tells how far to the right of a token's start the text can matter for where that token ends (``Model.lookahead``, computed
from the merges in the order of their ranks). A transducer holds the symbols not yet emitted; once twice the lookahead are held it merges
them and emits every token that ends at least a lookahead before the last of them. What it holds never grows with the text.

White space ends every pre-token, so a batch of texts is cut at ASCII white space and each different piece is encoded once; pre-tokens are
remembered in a table of bounded size, because prose repeats its words. Pre-tokens of up to ``SHORT`` bytes are less than the transducer
holds, so it would merge them in one go: many of them are merged together, as rows of a matrix. Longer ones go through the transducer.

A text of more than ``FEED_BYTES`` is fed in pieces. Where no white space ends one, it is cut between two characters that neither
normalisation nor an added token nor a contraction can join, and the pre-token stays open in its transducer (``Encoder.feed``): a text
without any white space needs no more memory than prose. Only a run of more than ``FEED_BYTES`` of nothing but combining marks, quotes or
angle brackets has no such place and is held as one.

The file's byte symbols, end-of-word mark, added tokens and lack of a decoder (tokens joined by blanks) are taken as the tokenizers library
takes them, without special tokens added. Text beyond ASCII is normalised and split into pre-tokens by that library's own two components.
A file with other components than these raises ``ValueError``.

Null text is empty text: no ids, empty decoded text. Any text encodes; repeated rows encode alike; the work is row-wise, without a shuffle.
Kept columns may have any names (see ``columns``).
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quireline.llm.columns import Kept, named
from quireline.llm.storage import small_batches

#: Pre-tokens that are remembered, and the characters from which one is not.
REMEMBERED, LONG = 500_000, 200
#: Bytes of a pre-token that is merged beside others, and cells of a matrix of such.
SHORT, CELLS = 48, 1 << 20
#: Bytes of text and ids that go through at a time, and characters from a window's end in which a place to cut is looked for.
FEED_BYTES, FEED_IDS, SEARCHED = 1 << 18, 1 << 16, 4096
#: Characters of text beyond ASCII that the library takes at once, and what stands between pieces there.
LIBRARY_CHARS, BETWEEN = 1 << 15, "\x01"
_NEVER = 1 << 30


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


#: What the files that this module reads have beside vocabulary and merges.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def _check(held: dict, symbols: list[str]) -> None:
    """Raises where the file asks for something that this module does otherwise."""
    model = held["model"]
    wanted = {
        "normalizer": held.get("normalizer") == _NORMALIZER,
        "pre-tokenizer": held.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]},
        "decoder": held.get("decoder") is None,
        "model": model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
        "end-of-word mark": bool(model.get("end_of_word_suffix")),
        "added tokens": not any(a[k] for a in held["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    suffix = model.get("end_of_word_suffix") or ""
    wanted["byte symbols"] = all(s in model["vocab"] and s + suffix in model["vocab"] for s in symbols)
    if wrong := [k for k, good in wanted.items() if not good]:
        raise ValueError(f"the file's {', '.join(wrong)} cannot be encoded by this module")


def is_lower_case_words(path: str) -> bool:
    """Whether a file has the components that this module knows, and added tokens that begin with ``<`` only."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    try:
        _check(held, byte_symbols())
    except (ValueError, KeyError):
        return False
    return all(a["content"].startswith("<") for a in held["added_tokens"])


@cache
def _seconds() -> frozenset[str]:
    """Characters that normalisation may join to the one before, although they are no combining marks."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    return frozenset([chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"] + [chr(c) for low, high in ((0x1161, 0x1176), (0x11A7, 0x11C3)) for c in range(low, high)])


#: Lower-case letters of Latin-1; what is neither ASCII nor a letter of Latin-1; what stands behind the ids of a piece.
_LATIN_LOWER, ODD, _END = "\xdf-\xf6\xf8-\xff", "[^\\x00-\\x7F\xc0-\xd6\xd8-\xf6\xf8-\xff]", b"\xff\xff\xff\xff"


def _begins(char: str) -> bool:
    """Whether normalisation never joins a character to what is before it."""
    first = unicodedata.normalize("NFD", char)[0]
    return not (unicodedata.combining(first) or first in _seconds() or unicodedata.category(first) == "Cn")


class Model:
    """Merges by pair of ids, and what follows from them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        symbols = byte_symbols()
        _check(held, symbols)
        vocab: dict[str, int] = held["model"]["vocab"]
        suffix = held["model"]["end_of_word_suffix"]
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + suffix] for s in symbols]
        self.added = {a["content"]: a["id"] for a in held["added_tokens"]}
        self.rank: dict[tuple[int, int], int] = {}
        self.product: list[int] = []
        self.size: dict[int, int] = dict.fromkeys([*self.inner, *self.final], 1)
        reach: dict[int, int] = {}
        for left, right in held["model"]["merges"]:
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = len(self.product)
            self.product.append(c)
            self.size[c] = self.size[a] + self.size[b]
            # how far from the start of a the text may matter for whether a and b merge
            span = max(self.size[c], reach.get(a, 1), self.size[a] + reach.get(b, self.size[b]))
            reach[a] = max(reach.get(a, 1), span)
            reach[c] = max(reach.get(c, 1), span)
        self.lookahead = max(reach.values(), default=1)
        self.content = {i: t.encode("utf-8") for t, i in [*vocab.items(), *self.added.items()]}
        # all added tokens of the known files begin with "<"; others are looked for in every piece
        self.mark = "<" if all(a.startswith("<") for a in self.added) else ""
        self.split_added = re.compile("(" + "|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        # text of ASCII and the letters of Latin-1, for which normalisation is lower case and Python knows the letters as well as the library
        self.plain_tokens = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN_LOWER}]+|[0-9]|[^\t-\r a-z{_LATIN_LOWER}0-9]+|\n")
        self.library, self.bytes_of = Tokenizer.from_file(path), {ord(s): b for b, s in enumerate(symbols)}
        self._arrays()

    def _arrays(self) -> None:
        """Merges as sorted arrays; ``none`` is an id that merges with nothing."""
        self.none = max(self.content) + 1
        if self.none >= 1 << 24:
            raise ValueError("ids of more than 24 bits")  # a piece's ids end where four bytes of ones stand
        pairs = np.array([a * (self.none + 1) + b for a, b in self.rank], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = np.append(pairs[order], np.int64(1) << 62), np.append(order, _NEVER).astype(np.int32)
        self.products = np.array([*self.product, 0], np.int32)
        self.inners, self.finals = np.array(self.inner, np.int32), np.array(self.final, np.int32)

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = a.astype(np.int64) * (self.none + 1) + b
        place = np.searchsorted(self.pairs, wanted)
        return np.where(self.pairs[place] == wanted, self.ranks[place], np.int32(_NEVER))

    def pre_tokens(self, piece: str) -> list[str]:
        """What merges stay within, normalised. Beyond ASCII the library decides, whose tables of letters may be newer than Python's."""
        return [t for t in self.plain_tokens.findall(piece.lower()) if t != "\n"] if piece.isascii() else self._library_tokens(piece)

    def _library_tokens(self, text: str) -> list[str]:
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return "\n".join([s for s, _ in found]).translate(self.bytes_of).encode("latin-1").decode("utf-8").split("\n") if found else []

    def plain(self, pieces: list[str]) -> list[str]:
        """Pre-tokens of pieces that ``ODD`` does not match, and a line end behind each piece's."""
        return self.plain_tokens.findall("\n".join([*pieces, ""]).lower())

    def beyond(self, pieces: list[str]) -> list[str]:
        """Likewise for any pieces without added tokens."""
        out, low = [], 0
        while low < len(pieces):
            high, chars = low, 0
            while high < len(pieces) and (high == low or chars < LIBRARY_CHARS):
                chars += len(pieces[high])
                high += 1
            own = pieces[low:high]
            found = [] if any(BETWEEN in p for p in own) else self._library_tokens(f" {BETWEEN} ".join([*own, ""]))
            if found.count(BETWEEN) == len(own):
                out += ["\n" if t == BETWEEN else t for t in found]
            else:
                for p in own:
                    out += [*self._library_tokens(p), "\n"]
            low = high
        return out

    def place_to_cut(self, text: str) -> tuple[int, bool]:
        """(place, whether the pre-token goes on behind it): a place near the end that no character, added token or contraction goes across.
        0 if there is none."""
        far = max([6, *map(len, self.added)])
        firsts = {a[0] for a in self.added}
        for i in range(len(text) - far, max(far, len(text) - SEARCHED), -1):
            if not _begins(text[i]):
                continue
            near = text[i - far + 1 : i + 1]
            if not firsts.isdisjoint(near) or "'" in near[-5:] and text[i - 2 : i + 2] != 4 * "'":
                continue
            # what is before may be a character of several code points, which count together
            start = next((j for j in range(i - 1, i - far, -1) if _begins(text[j])), None)
            if start is not None and len(self.library.normalizer.normalize_str(text[i])) == 1:
                found = self._library_tokens(text[start : i + 1])
                return i, bool(found) and len(found[-1]) > 1
        return 0, False

    def merged(self, ids: list[int]) -> list[int]:
        """All merges, the lowest rank first and the leftmost of equals."""
        if len(ids) > 40:
            return self._merged_long(ids)
        rank, ids = self.rank.get, list(ids)
        ranks = [rank((a, b), _NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [self.product[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((ids[at - 1], ids[at]), _NEVER)
            if at < len(ranks):
                ranks[at] = rank((ids[at], ids[at + 1]), _NEVER)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        n, ids = len(ids), list(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        queue = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = self.product[r], False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r2 := self.rank.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(queue, (r2, x, ids[x], ids[y]))
        return [t for t, live in zip(ids, alive, strict=True) if live]

    def merged_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of short pre-tokens, as little-endian unsigned 32-bit integers: what ``merged`` gives, for many at a time."""
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        held, low = sizes[order], 0
        while low < len(words):
            high = min(low + max(1, CELLS // int(held[low] + 4)), int(np.searchsorted(held, held[low] + 4, side="right")))
            own = order[low:high].tolist()
            for i, ids in zip(own, self._matrix([words[i] for i in own], held[low:high]), strict=True):
                out[i] = ids
            low = high
        return out

    def _matrix(self, words: list[bytes], sizes: np.ndarray) -> list[bytes]:
        width = int(sizes[-1])
        ids = np.full((len(words), width), self.none, np.int32)
        data = np.frombuffer(b"".join(words), np.uint8)
        ids[np.arange(width) < sizes[:, None]] = self.inners[data]
        ids[np.arange(len(words)), sizes - 1] = self.finals[data[np.cumsum(sizes) - 1]]
        done, live = ids.copy(), np.arange(len(words))
        ranks = self._ranks_of(ids[:, :-1], ids[:, 1:])
        while len(live) and ranks.shape[1]:
            at = ranks.argmin(1)  # the leftmost of equals
            best = ranks[np.arange(len(live)), at]
            more = best != _NEVER
            if not more.all():
                over = ~more
                done[live[over]] = self.none
                done[live[over], : ids.shape[1]] = ids[over]
                live, ids, ranks, at, best = live[more], ids[more], ranks[more], at[more], best[more]
            if not len(live):
                break
            # one merge a row: what is behind it moves up, and the pairs on both sides are new
            row, width = np.arange(len(live)), ids.shape[1]
            ids[row, at] = self.products[best]
            ids = np.where(np.arange(width - 1) > at[:, None], ids[:, 1:], ids[:, :-1])
            ranks = np.where(np.arange(width - 2) >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._ranks_of(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < width - 2)
            ranks[right, at[right]] = self._ranks_of(ids[right, at[right]], ids[right, at[right] + 1])
        done[live] = self.none
        done[live, : ids.shape[1]] = ids
        whole = done != self.none
        flat, ends = done[whole].astype("<u4").tobytes(), (4 * np.cumsum(whole.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@cache
def model(path: str) -> Model:
    return Model(path)


class Transducer:
    """Symbols of one pre-token in, tokens out as soon as nothing that follows can change them."""

    def __init__(self, held: Model):
        self.held, self.waiting = held, b""

    def feed(self, data: bytes) -> Iterator[int]:
        ahead, step = self.held.lookahead, 2 * self.held.lookahead
        for low in range(0, len(data), step):
            self.waiting += data[low : low + step]
            if len(self.waiting) > step:
                end = 0
                for token in self.held.merged([self.held.inner[b] for b in self.waiting]):
                    if end + self.held.size[token] > len(self.waiting) - ahead:
                        break
                    end += self.held.size[token]
                    yield token
                self.waiting = self.waiting[end:]

    def finish(self) -> Iterator[int]:
        if self.waiting:
            data, self.waiting = self.waiting, b""
            yield from self.held.merged([*(self.held.inner[b] for b in data[:-1]), self.held.final[data[-1]]])


_WHITE = re.compile(rb"[\t-\r ]")


class Encoder:
    """Text in pieces of any size in, ids out; holds one unfinished piece, and of a long one only its end."""

    def __init__(self, path: str):
        self.held, self.words = model(path), {}
        self.rest, self.open = b"", None

    def _word(self, token: str) -> bytes:
        stream = Transducer(self.held)
        return np.array([*stream.feed(token.encode("utf-8")), *stream.finish()], "<u4").tobytes()

    def _parts(self, piece: str) -> Iterator[tuple[str, bool]]:
        """Added tokens (true) and pre-tokens of a piece."""
        held = self.held
        for part in held.split_added.split(piece) if held.split_added and held.mark in piece else [piece]:
            if part in held.added:
                yield part, True
            elif part:
                yield from ((t, False) for t in held.pre_tokens(part))

    def _added(self, token: str) -> bytes:
        return np.array([self.held.added[token]], "<u4").tobytes()

    def _pieces(self, pieces: pa.Array) -> list[bytes]:
        """Ids of different pieces without ASCII white space: each new pre-token is merged once."""
        held, words = self.held, self.words
        texts = pieces.to_numpy(zero_copy_only=False).tolist()
        odd = pc.match_substring_regex(pieces, ODD).to_numpy(zero_copy_only=False)
        mixed = (pc.match_substring(pieces, held.mark) if held.split_added else pc.match_substring(pieces, "\n")).to_numpy(zero_copy_only=False)
        plain, other = np.flatnonzero(~odd & ~mixed).tolist(), np.flatnonzero(odd & ~mixed).tolist()
        tokens = held.plain([texts[i] for i in plain]) + held.beyond([texts[i] for i in other])
        words["\n"] = _END
        new = [t for t in set(tokens) if t not in words]
        short = [t for t in new if len(t) <= SHORT // 4 or len(t.encode("utf-8")) <= SHORT]
        words.update(zip(short, held.merged_many([t.encode("utf-8") for t in short]), strict=True))
        if len(short) < len(new):
            words.update((t, self._word(t)) for t in new if t not in words)
        out = [b""] * len(texts)
        for i, ids in zip([*plain, *other], b"".join(map(words.__getitem__, tokens)).split(_END), strict=False):
            out[i] = ids
        for i in np.flatnonzero(mixed).tolist():
            out[i] = b"".join([self._added(t) if added else words.get(t) or self._word(t) for t, added in self._parts(texts[i])])
        if len(words) > REMEMBERED:
            words.clear()
        for t in new:
            if len(t) >= LONG:
                words.pop(t, None)
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of whole texts, or of texts that start and end at white space."""
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        found = self._pieces(coded.dictionary)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, starts, place = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        each = sizes[place]
        ends = np.cumsum(each)
        ids = pool[np.repeat(starts[place] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        return np.append(0, ends)[parts.offsets.to_numpy()], ids

    def pieces(self, data: bytes) -> bytes:
        """Ids, as little-endian unsigned 32-bit integers, of text that starts and ends at white space or at its ends."""
        return self.batch(pa.array([data.decode("utf-8")], pa.string()))[1].tobytes()

    def _on(self, part: str, joined: bool) -> bytes:
        """Ids of a part of a piece that are final. The open pre-token goes on in it; if ``joined``, its last one stays open."""
        out, parts = [], [*self._parts(part)]
        for n, (token, added) in enumerate(parts):
            if added:
                out.append(self._added(token))
                continue
            stream = self.open if n == 0 and self.open else Transducer(self.held)
            out.append(np.array([*stream.feed(token.encode("utf-8"))], "<u4").tobytes())
            self.open = stream if joined and n == len(parts) - 1 else None
            if not self.open:
                out.append(np.array([*stream.finish()], "<u4").tobytes())
        return b"".join(out)

    def _closed(self, data: bytes) -> bytes:
        """Ids of text that ends at white space or at the text's end."""
        out = b""
        if self.open:
            white = _WHITE.search(data)
            first = data[: white.start()] if white else data
            out = self._on(first.decode("utf-8"), False)
            if self.open:  # nothing of it was left
                out, self.open = np.array([*self.open.finish()], "<u4").tobytes(), None
            data = data[len(first) :]
        return out + self.pieces(data)

    def feed(self, data: bytes) -> bytes:
        """Ids that nothing behind can change."""
        data, out = self.rest + data, b""
        cut = max(data.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
        if cut:
            out, data = self._closed(data[:cut]), data[cut:]
        if len(data) > FEED_BYTES:
            text, used = codecs.utf_8_decode(data, "strict", False)
            at, joined = self.held.place_to_cut(text)
            if at:
                out += self._on(text[:at], joined)
                data = text[at:].encode("utf-8") + data[used:]
        self.rest = data
        return out

    def finish(self) -> bytes:
        data, self.rest = self.rest, b""
        return self._closed(data)


class Decoder:
    """Ids in, text out. Between calls it holds whether a token went before and the bytes of an unfinished character."""

    def __init__(self, path: str):
        self.pool, self.starts, self.sizes = contents(path)
        self.first, self.text = True, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        known = ids < len(self.sizes)
        if not known.all():
            ids = ids[known]
        size = self.sizes[ids]
        if not size.all():  # ids outside the vocabulary are left out
            ids, size = ids[size > 0], size[size > 0]
        if not len(ids):
            return ""
        ends = np.cumsum(size)
        # each token has a blank in front, but for the first of a text
        data = self.pool[np.repeat(self.starts[ids] - (ends - size), size) + np.arange(ends[-1])]
        data, self.first = data[1:] if self.first else data, False
        return self.text.decode(data.tobytes())

    def finish(self) -> str:
        self.first = True
        return self.text.decode(b"", True)


@cache
def contents(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all tokens, each with a blank in front; start and size by id; size 0: no such id)."""
    held = model(path).content
    sizes = np.zeros(max(held) + 1, np.int64)
    for i, t in held.items():
        sizes[i] = len(t) + 1
    return np.frombuffer(b"".join(b" " + held[i] for i in sorted(held)), np.uint8), np.cumsum(sizes) - sizes, sizes


@cache
def encoder(path: str) -> Encoder:
    """One for a worker process, so that what it remembers serves its next tasks too."""
    return Encoder(path)


def stream_ids(encoder: Encoder, data: bytes) -> Iterator[np.ndarray]:
    """Ids of a long text in pieces."""
    for low in range(0, len(data), FEED_BYTES):
        yield np.frombuffer(encoder.feed(data[low : low + FEED_BYTES]), "<u4")
    yield np.frombuffer(encoder.finish(), "<u4")


def encode_text(encoder: Encoder, data: bytes) -> bytes:
    return encoder.pieces(data) if len(data) <= FEED_BYTES else b"".join(ids.tobytes() for ids in stream_ids(encoder, data))


#: Bytes of texts that are encoded together.
TOGETHER = 1 << 22


def encoded(encoder: Encoder, texts: pa.Array) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
    """(row, its ids in pieces) of a column of text, in order."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    low = 0
    while low < len(texts):
        if sizes[low] > FEED_BYTES:
            yield low, stream_ids(encoder, texts[low].as_py().encode("utf-8"))
            low += 1
            continue
        high, size = low, 0
        while high < len(texts) and sizes[high] <= FEED_BYTES and (high == low or size + sizes[high] <= TOGETHER):
            size, high = size + sizes[high], high + 1
        at, ids = encoder.batch(texts.slice(low, high - low))
        for i in range(high - low):
            yield low + i, iter((ids[at[i] : at[i + 1]],))
        low = high


def _row_wise(path: str, of_text: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = of_text(path)
        for batch in batches:
            kept = [n for n in batch.schema.names if n != "__in"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *state(batch.column("__in"))], names=[*kept, *state.names])

    return run


class _Encode:
    names = ("n_tokens", "ids")

    def __init__(self, path: str):
        self.encoder = encoder(path)

    def __call__(self, column: pa.Array) -> list[pa.Array]:
        ids = [b"".join(p.tobytes() for p in pieces) for _, pieces in encoded(self.encoder, column)]
        return [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]


def decode_text(decoder: Decoder, data: bytes) -> str:
    ids = np.frombuffer(data, "<u4")
    return "".join([*(decoder.feed(ids[i : i + FEED_IDS]) for i in range(0, len(ids), FEED_IDS)), decoder.finish()])


class _Decode:
    names = ("decoded",)

    def __init__(self, path: str):
        self.decoder = Decoder(path)

    def __call__(self, column: pa.Array) -> list[pa.Array]:
        return [pa.array([decode_text(self.decoder, x or b"") for x in column.cast(pa.binary()).to_pylist()], pa.string())]


class _Digests:
    """Both ways in one pass, for when only digests are wanted: neither ids nor decoded text of a long text are ever whole."""

    names = ("n_tokens", "ids_sha256", "decoded_sha256")

    def __init__(self, path: str):
        self.encoder, self.decoder = encoder(path), Decoder(path)

    def __call__(self, column: pa.Array) -> list[pa.Array]:
        rows = []
        for _, pieces in encoded(self.encoder, column):
            n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
            for ids in pieces:
                n += len(ids)
                of_ids.update(ids.tobytes())
                of_text.update(self.decoder.feed(ids).encode("utf-8"))
            of_text.update(self.decoder.finish().encode("utf-8"))
            rows.append((n, of_ids.hexdigest(), of_text.hexdigest()))
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string()))]


def _passed(rows: DataFrame, keep: tuple[str, ...], column, path: str, of_text: Callable, kinds: dict[str, str]) -> DataFrame:
    small_batches(rows.sparkSession)
    kept = Kept(keep, kinds)
    held = rows.select(*kept.held(), column.alias("__in"))
    schema = held.select(*kept.places, *(F.lit(None).cast(k).alias(n) for n, k in kinds.items())).schema
    return held.mapInArrow(_row_wise(path, of_text), schema).select(*kept.back(), *kinds)


def encode_column(rows: DataFrame, path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit integers)."""
    return _passed(rows, keep, named(text).cast("string"), path, _Encode, {"n_tokens": "long", "ids": "binary"})


def decode_column(rows: DataFrame, path: str, *, ids: str = "ids", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but ``ids``) and ``decoded``."""
    keep = tuple(c for c in rows.columns if c != ids) if keep is None else keep
    return _passed(rows, keep, named(ids), path, _Decode, {"decoded": "string"})


def digests(docs: DataFrame, path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``n_tokens`` and SHA-256 digests of the ids and of the decoded text."""
    return _passed(docs, keep, named(text).cast("string"), path, _Digests, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})
