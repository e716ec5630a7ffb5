"""PDF syntax: values, tokens, and their parsing and writing.

Names are ``Name``, references ``Ref``, strings bytes, dictionaries dicts (the last of equal keys holds), streams ``Stream``; reals keep their text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Containers within each other; what is deeper reads as null.
DEPTH = 256


class Name(str):
    __slots__ = ()


class Real(float):
    """A number that writes itself as it was read."""

    def __new__(cls, text: str):
        out = super().__new__(cls, text)
        out.text = text
        return out


@dataclass(frozen=True, order=True)
class Ref:
    num: int
    gen: int = 0


@dataclass
class Stream:
    dict: dict
    start: int
    end: int


class SyntaxFault(ValueError):
    pass


SPACE = b"\0\t\n\f\r "
_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]*[0-9]*\.?[0-9]*(?:-[0-9]*)?")
_NAME = re.compile(rb"/([^\0\t\n\f\r ()<>\[\]{}/%]*)")
_WORD = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_REF = re.compile(rb"([0-9]{1,10})[\0\t\n\f\r ]+([0-9]{1,5})[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_ESCAPES = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}


class Parser:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.truncated = data, at, False

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def word(self) -> bytes:
        """The next run of regular characters; empty at anything else."""
        self.skip()
        m = _WORD.match(self.data, self.at)
        if m:
            self.at = m.end()
        return m[0] if m else b""

    def expect(self, word: bytes) -> bool:
        self.skip()
        if self.data.startswith(word, self.at) and not _WORD.match(self.data[self.at + len(word) : self.at + len(word) + 1]):
            self.at += len(word)
            return True
        return False

    def value(self):
        """One value, without recursion: open containers are on a stack."""
        stack: list[tuple[str, list]] = []
        while True:
            self.skip()
            data, at = self.data, self.at
            if at >= len(data):
                raise SyntaxFault("value expected")
            c = data[at]
            if c == 0x5B or data.startswith(b"<<", at):
                self.at += 1 if c == 0x5B else 2
                stack.append(("[" if c == 0x5B else "<", []))
                continue
            if c == 0x5D or data.startswith(b">>", at):
                self.at += 1 if c == 0x5D else 2
                if not stack:
                    raise SyntaxFault("closing bracket")
                kind, items = stack.pop()
                if len(stack) >= DEPTH:
                    made, self.truncated = None, True
                else:
                    made = items if kind == "[" else {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}
            else:
                made = self._plain()
            if not stack:
                return made
            stack[-1][1].append(made)

    def _plain(self):
        data, at = self.data, self.at
        c = data[at]
        if c == 0x2F:
            m = _NAME.match(data, at)
            self.at = m.end()
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), m[1]).decode("latin-1"))
        if c == 0x28:
            return self._string()
        if c == 0x3C:
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if m := _REF.match(data, at):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        if c in b"+-.0123456789":
            m = _NUMBER.match(data, at)
            self.at = max(m.end(), at + 1)
            text = re.sub(rb"^[+-]*(?=[+-])|(?<=[0-9.])-.*", b"", m[0]).decode()
            if re.fullmatch(r"[+-]?[0-9]+", text):
                return int(text)
            return Real(text) if re.search("[0-9]", text) else 0
        word = _WORD.match(data, at)
        if not word:
            raise SyntaxFault(f"unexpected {data[at : at + 1]!r}")
        self.at = word.end()
        if word[0] in (b"true", b"false", b"null"):
            return {b"true": True, b"false": False, b"null": None}[word[0]]
        raise SyntaxFault(f"unexpected word {word[0][:20]!r}")

    def _string(self) -> bytes:
        data, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while at < len(data):
            c = data[at]
            if c == 0x5C:
                at += 1
                if m := re.compile(rb"[0-7]{1,3}").match(data, at):
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                    continue
                if data[at : at + 2] == b"\r\n":
                    at += 2
                    continue
                if at < len(data) and data[at] not in b"\r\n":
                    out.append(_ESCAPES.get(data[at], data[at]))
                at += 1
                continue
            depth += (c == 0x28) - (c == 0x29)
            at += 1
            if not depth:
                break
            out.append(c)
        self.at = at
        return bytes(out)


def written(value) -> bytes:
    """A value in PDF syntax; strings in hexadecimal."""
    if value is None or isinstance(value, bool):
        return {None: b"null", True: b"true", False: b"false"}[value]
    if isinstance(value, Name):
        return b"/" + b"".join(bytes([c]) if 0x21 <= c <= 0x7E and c not in b"#()<>[]{}/%" else b"#%02X" % c for c in value.encode("latin-1"))
    if isinstance(value, Real):
        return value.text.encode()
    if isinstance(value, (int, float)):
        return str(value).encode()
    if isinstance(value, bytes):
        return b"<" + value.hex().upper().encode() + b">"
    if isinstance(value, Ref):
        return b"%d %d R" % (value.num, value.gen)
    if isinstance(value, list):
        return b"[" + b" ".join(map(written, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b"".join(b" " + written(Name(k)) + b" " + written(v) for k, v in value.items()) + b" >>"
    raise TypeError(type(value))


#: PDFDocEncoding where it differs from Latin-1.
_DOC = dict(zip([*range(0x18, 0x20), *range(0x80, 0x9F), 0xA0], "˘ˇˆ˙˝˛˚˜•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž€", strict=True))


def text_of(data: bytes) -> str:
    if data[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return data.decode("utf-16", "replace")
    if data[:3] == b"\xef\xbb\xbf":
        return data[3:].decode("utf-8", "replace")
    return "".join(_DOC.get(c, chr(c)) for c in data)


def text_bytes(text: str) -> bytes:
    return b"\xfe\xff" + text.encode("utf-16-be", "replace")
