"""PDF objects as Python values, and the parser that reads them.

null, booleans, integers and lists are themselves; reals are floats of single
precision; strings are ``bytes``, names are ``Name``; dictionaries map names to
values; streams keep their place in the file.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from typing import NamedTuple

SPACE = b"\0\t\n\x0c\r "
DELIMITERS = b"()<>[]{}/%"
MAX_DEPTH, MAX_ENTRIES = 256, 4096
I64_MAX = 2**63 - 1
U32_MAX = 2**32 - 1

_SKIP = re.compile(rb"(?:[\0\t\n\x0c\r ]++|%[^\r\n]*+)*+")
_REGULAR = re.compile(rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]*")
_BLANKS = re.compile(rb"[ \t]*")
_DIGITS = re.compile(rb"[0-9]*")
_NUMBER = re.compile(rb"([+-]?)([0-9]*)(\.[0-9]*)?")
_REFERENCE = re.compile(rb"[ \t]*([0-9]+)[ \t]*R(?=[\0\t\n\x0c\r ()<>\[\]{}/%]|\Z)")
#: An entry of a dictionary whose value is a name, a whole number, a reference or an array of whole numbers, in one go. What looks otherwise is read piece by piece.
_USUAL_ENTRY = re.compile(
    rb"[\0\t\n\x0c\r ]*+/([A-Za-z0-9_.+-]++)[\0\t\n\x0c\r ]*+"
    rb"(?:/([A-Za-z0-9_.+-]++)|([0-9]{1,9}+)(?:[ \t]++([0-9]{1,5}+)[ \t]*+R)?|\[ *+((?:[0-9]{1,9}+(?: ++|(?=\])))*+)\])(?=[\0\t\n\x0c\r ]*+(?:/|>>))"
)
_USUAL_START = re.compile(rb"[\0\t\n\x0c\r ]*+([0-9]{1,9}+)[ \t]++([0-9]{1,5}+)[ \t]*+obj")
_HASH = re.compile(rb"#([0-9a-fA-F]{2})")
_NOT_HEX = re.compile(rb"[^0-9a-fA-F]+")
_ESCAPE = re.compile(rb"\\(\r\n|[0-7]{1,3}|[\s\S])")
_EASY = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
_STREAM_END = re.compile(rb"[\0\t\n\x0c\r ]*endstream")


class PdfError(Exception):
    """A document that can't be read; ``code`` names the kind."""

    prefix = {"NOT_PDF": "input does not look like a PDF", "XREF": "xref", "OBJECT": "object", "FILTER": "filter", "DEFLATE": "deflate"}

    def __init__(self, code: str, detail: str = "") -> None:
        self.code, self.detail = code, detail
        super().__init__(f"{self.prefix[code]}: {detail}" if detail else self.prefix[code])

    def __reduce__(self):
        return PdfError, (self.code, self.detail)


class Name(bytes):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Stream(NamedTuple):
    dict: dict
    start: int
    length: int

    def raw(self, data: bytes) -> bytes:
        end = self.start + self.length
        return data[self.start : end] if end <= len(data) else b""


_single = struct.Struct("f")
_pack, _unpack = _single.pack, _single.unpack


def f32(x: float) -> float:
    """``x`` in single precision."""
    try:
        return _unpack(_pack(x))[0]
    except OverflowError:
        return float("inf") if x > 0 else float("-inf")


_several = [struct.Struct(f"{n}f") for n in range(8)]


def f32_of(numerals: list[bytes]) -> list[float]:
    """Each numeral in single precision."""
    if len(numerals) < len(_several):
        s = _several[len(numerals)]
        try:
            return [*s.unpack(s.pack(*map(float, numerals)))]
        except OverflowError:
            pass
    return [f32(float(x)) for x in numerals]


def lax_hex(data: bytes) -> bytes:
    """Hex digits up to ``>``; other bytes are passed over, a last odd digit counts as followed by 0."""
    digits = _NOT_HEX.sub(b"", data.split(b">", 1)[0])
    return bytes.fromhex((digits + b"0" * (len(digits) & 1)).decode())


def strict_hex(data: bytes) -> bytes | None:
    digits = data.translate(None, SPACE)
    return None if _NOT_HEX.search(digits) else bytes.fromhex((digits + b"0" * (len(digits) & 1)).decode())


def unescape(raw: bytes) -> bytes:
    """The bytes of a literal string without its outer parentheses."""

    def one(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1] in b"01234567" else _EASY.get(c, c)

    return _ESCAPE.sub(one, raw) if b"\\" in raw else raw


def as_int(x) -> int | None:
    """An integer, also from a real, which loses its fraction."""
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return None
    try:
        return int(x)
    except (OverflowError, ValueError):
        return I64_MAX if x > 0 else -I64_MAX - 1 if x < 0 else 0


def as_name(x) -> bytes | None:
    return bytes(x) if isinstance(x, Name) else None


class Parser:
    def __init__(self, data: bytes, pos: int = 0) -> None:
        self.data, self.pos, self.depth = data, pos, 0

    def skip(self) -> None:
        self.pos = _SKIP.match(self.data, self.pos).end() if self.pos <= len(self.data) else self.pos

    def fail(self, what: str) -> PdfError:
        return PdfError("OBJECT", f"{what} at offset {self.pos}")

    def value(self):
        self.skip()
        data, at = self.data, self.pos
        c = data[at : at + 1]
        if not c:
            raise PdfError("OBJECT", "unexpected end of input")
        if c == b"/":
            return self.name()
        if c == b"(":
            return self._literal()
        if c == b"<":
            return self._dictionary() if data[at + 1 : at + 2] == b"<" else self._hex()
        if c == b"[":
            return self._array()
        if c in b"+-.0123456789":
            return self._number()
        for word, result in ((b"true", True), (b"false", False), (b"null", None)):
            if data.startswith(word, at):
                self.pos += len(word)
                return result
        raise self.fail("no value")

    def name(self) -> Name:
        m = _REGULAR.match(self.data, self.pos + 1)
        self.pos = m.end()
        raw = m[0]
        return Name(_HASH.sub(lambda h: bytes.fromhex(h[1].decode()), raw) if b"#" in raw else raw)

    def _literal(self) -> bytes:
        data, at, depth = self.data, self.pos + 1, 1
        start = at
        while depth:
            m = re.compile(rb"[()\\]").search(data, at)
            if not m:
                raise self.fail("string without an end")
            at = m.end()
            if m[0] == b"\\":
                at += 1
            else:
                depth += 1 if m[0] == b"(" else -1
        self.pos = at
        return unescape(data[start : at - 1])

    def _hex(self) -> bytes:
        end = self.data.find(b">", self.pos + 1)
        if end < 0:
            raise self.fail("hex string without an end")
        raw, self.pos = self.data[self.pos + 1 : end], end + 1
        return lax_hex(raw)

    def _number(self):
        m = _NUMBER.match(self.data, self.pos)
        sign, whole, rest = m.groups()
        if not whole and rest is None:
            raise self.fail("no number")
        self.pos = m.end()
        if rest is None:
            if not sign and (r := _REFERENCE.match(self.data, self.pos)):
                self.pos = r.end()
                num, gen = int(whole), int(r[1])
                return Ref(num if num <= U32_MAX else U32_MAX, (gen if gen <= U32_MAX else 0) & 0xFFFF)
            n = int(sign + whole)
            return n if -I64_MAX - 1 <= n <= I64_MAX else I64_MAX
        return f32(float(m[0])) if whole or len(rest) > 1 else 0.0

    def _enter(self) -> None:
        if self.depth >= MAX_DEPTH:
            raise PdfError("OBJECT", "nested too deep")
        self.depth += 1

    def _array(self) -> list:
        self.pos += 1
        self._enter()
        out = []
        while True:
            self.skip()
            c = self.data[self.pos : self.pos + 1]
            if c == b"]":
                self.pos += 1
                break
            if not c:
                raise PdfError("OBJECT", "array without an end")
            out.append(self.value())
        self.depth -= 1
        return out

    def _dictionary(self) -> dict:
        self.pos += 2
        self._enter()
        out, entries, usual = {}, 0, _USUAL_ENTRY.match
        while True:
            if entries < MAX_ENTRIES and (m := usual(self.data, self.pos)):
                key, name, number, gen, numbers = m.groups()
                if numbers is None or self.depth < MAX_DEPTH:
                    out[key] = Name(name) if name is not None else [*map(int, numbers.split())] if numbers is not None else int(number) if gen is None else Ref(int(number), int(gen) & 0xFFFF)
                    self.pos = m.end()
                    entries += 1
                    continue
            self.skip()
            if self.data.startswith(b">>", self.pos):
                self.pos += 2
                break
            if not self.data.startswith(b"/", self.pos):
                raise self.fail("dictionary key missing")
            if entries >= MAX_ENTRIES:
                raise PdfError("OBJECT", f"dictionary with more than {MAX_ENTRIES} entries")
            key = bytes(self.name())
            out[key] = self.value()
            entries += 1
        self.depth -= 1
        return out

    def _u32(self) -> int | None:
        m = _DIGITS.match(self.data, self.pos)
        self.pos = m.end()
        return int(m[0]) if m[0] and int(m[0]) <= U32_MAX else None

    def _blanks(self) -> None:
        self.pos = _BLANKS.match(self.data, self.pos).end()

    def indirect(self, length_of: Callable[[Ref], int | None] | None = None) -> tuple[Ref, object]:
        """``N G obj … endobj``; ``length_of`` tells lengths that are given by reference."""
        if m := _USUAL_START.match(self.data, self.pos):
            num, gen, self.pos = int(m[1]), int(m[2]), m.end()
        else:
            self.skip()
            if self.pos >= len(self.data):
                raise PdfError("OBJECT", "indirect object past the end")
            num = self._u32()
            self._blanks()
            gen = self._u32()
            self._blanks()
            if not self.data.startswith(b"obj", self.pos):
                raise self.fail("no obj")
            self.pos += 3
        value = self.value()
        self.skip()
        if self.data.startswith(b"stream", self.pos):
            if not isinstance(value, dict):
                raise PdfError("OBJECT", "stream without a dictionary")
            value = self._stream(value, length_of)
        self.skip()
        if self.data.startswith(b"endobj", self.pos):
            self.pos += 6
        return Ref(U32_MAX if num is None else num, (gen or 0) & 0xFFFF), value

    def _stream(self, head: dict, length_of) -> Stream:
        data = self.data
        self.pos += 6
        if data.startswith(b"\r\n", self.pos):
            self.pos += 2
        elif data[self.pos : self.pos + 1] in (b"\r", b"\n"):
            self.pos += 1
        start = self.pos
        if b"Length" not in head:
            raise PdfError("OBJECT", "stream without a length")
        given = head[b"Length"]
        size = None
        if isinstance(given, int) and not isinstance(given, bool) and given >= 0:
            if given > len(data) - start:
                raise PdfError("OBJECT", "stream is cut off")
            size = given
        elif isinstance(given, Ref) and length_of:
            size = length_of(given)
            if size is not None and (start + size > len(data) or not _STREAM_END.match(data, start + size)):
                size = None
        if size is None:
            end = data.find(b"endstream", start)
            if end < 0:
                raise PdfError("OBJECT", "no endstream")
            size = end - start
            if size and data[end - 1 : end] == b"\n":
                size -= 2 if size > 1 and data[end - 2 : end - 1] == b"\r" else 1
            elif size and data[end - 1 : end] == b"\r":
                size -= 1
        self.pos = start + size
        self.skip()
        if data.startswith(b"endstream", self.pos):
            self.pos += 9
        return Stream(head, start, size)
