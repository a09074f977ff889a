"""Character maps and fonts: the text of the bytes that a font shows."""

from __future__ import annotations

import re
import struct
from codecs import charmap_decode
from functools import lru_cache

from vellumine.kernel.document import Document
from vellumine.kernel.encodings import base_encoding, glyph_text
from vellumine.kernel.objects import Name, PdfError, Ref, Stream, as_name, strict_hex

#: Codes that one range of a map may have; longer ones are taken for damage.
MAX_RANGE = 1 << 16

_TOKEN = re.compile(rb"(?P<skip>[\0\t\n\x0c\r ]+|%[^\r\n]*|>)|<<|>>|<(?P<hex>[^>]*)>?|(?P<open>\[)|(?P<close>\])|(?P<string>\()|/(?P<name>[^\0\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<word>[^\0\t\n\x0c\r ()<>\[\]{}/%]+)|[)}{]")
_BLOCKS = {b"begincodespacerange": b"endcodespacerange", b"beginbfchar": b"endbfchar", b"beginbfrange": b"endbfrange"}
_WORDS = frozenset([*_BLOCKS, *_BLOCKS.values()])


def _tokens(data: bytes) -> list[tuple[str, bytes]]:
    out, at = [], 0
    while m := _TOKEN.match(data, at):
        at, kind = m.end(), m.lastgroup
        if m[0] == b"<<" or m[0] == b">>" or kind in ("name", None):
            out.append(("other", b""))
        elif kind == "hex":
            raw = strict_hex(m["hex"])
            out.append(("other", b"") if raw is None else ("hex", raw))
        elif kind == "string":
            depth = 1
            while depth and at < len(data):
                c = data[at]
                at += 2 if c == 92 else 1
                depth += (c == 40) - (c == 41)
            out.append(("other", b""))
        elif kind == "word":
            out.append(("word", m["word"]) if m["word"] in _WORDS else ("other", b""))
        elif kind != "skip":
            out.append((kind, b""))
    return out


def _code(raw: bytes) -> int | None:
    return int.from_bytes(raw, "big") if 1 <= len(raw) <= 4 else None


def _text(raw: bytes) -> str | None:
    """UTF-16, or Latin-1 for a single byte; None for an odd length or half a pair."""
    if len(raw) == 1:
        return chr(raw[0])
    if not raw or len(raw) % 2:
        return None
    try:
        return raw.decode("utf-16-be")
    except UnicodeDecodeError:
        return None


class CMap:
    def __init__(self, data: bytes) -> None:
        self.width, self.texts = 1, {}
        self.tokens, self.at = _tokens(data), 0
        while self.at < len(self.tokens):
            kind, word = self.tokens[self.at]
            self.at += 1
            if kind == "word" and word in _BLOCKS:
                while self._inside(_BLOCKS[word]) and self._entry(word):
                    pass
        del self.tokens

    def _inside(self, end: bytes) -> bool:
        if self.at >= len(self.tokens):
            return False
        if self.tokens[self.at] == ("word", end):
            self.at += 1
            return False
        return True

    def _hex(self) -> bytes | None:
        while self.at < len(self.tokens):
            kind, raw = self.tokens[self.at]
            if kind == "word":
                return None
            self.at += 1
            if kind == "hex":
                return raw
        return None

    def _entry(self, block: bytes) -> bool:
        a = self._hex()
        b = self._hex() if a is not None else None
        if b is None:
            return False
        if block == b"begincodespacerange":
            self.width = max(self.width, len(a))
        elif block == b"beginbfchar":
            if (code := _code(a)) is not None and (text := _text(b)) is not None:
                self.texts[code] = text
        else:
            self._range(_code(a), _code(b))
        return True

    def _range(self, low: int | None, high: int | None) -> None:
        if low is None or high is None or self.at >= len(self.tokens):
            return
        kind, raw = self.tokens[self.at]
        self.at += 1
        fits = low <= high < low + MAX_RANGE
        if kind == "hex" and fits:
            last = int.from_bytes(raw[-2:], "big")
            for code in range(low, high + 1):
                own = raw[:-2] + ((last + code - low) & 0xFFFF).to_bytes(2, "big") if len(raw) > 1 else raw
                if (text := _text(own)) is not None:
                    self.texts[code] = text
        elif kind == "open":
            each = []
            while self.at < len(self.tokens):
                kind, raw = self.tokens[self.at]
                self.at += 1
                if kind == "close":
                    break
                if kind == "hex":
                    each.append(raw)
            for code, own in zip(range(low, high + 1), each if fits else ()):
                if (text := _text(own)) is not None:
                    self.texts[code] = text


_STYLES = tuple(re.compile(p, re.I) for p in (rb"bold|black|heavy", rb"italic|oblique", rb"courier|mono|consolas|menlo|monaco|lucidaconsole"))


def font_style(name: bytes) -> tuple[bool, bool, bool]:
    """Whether a font name sounds bold, italic, fixed in width."""
    return tuple(bool(p.search(name)) for p in _STYLES)


def differences(items: list) -> dict[int, str]:
    out, code = {}, 0
    for x in items:
        if isinstance(x, Name):
            if code < 256:
                try:
                    out[code] = x.decode()
                except UnicodeDecodeError:
                    pass
            code = (code + 1) & 0xFFFFFFFF
        elif type(x) is int:
            code = x & 0xFFFFFFFF
    return out


@lru_cache(64)
def _decoder(table: tuple[str | None, ...]) -> str | dict[int, str | None] | tuple[str | None, ...]:
    """The table as the C decoder takes it, which is faster by a string; U+FFFE stands for nothing there, so a table that has it stays as it is."""
    if "\ufffe" in table:
        return table
    if all(len(t or "") < 2 for t in table):
        return "".join([t or "\ufffe" for t in table])
    return {code: t or None for code, t in enumerate(table)}


class Font:
    """``base`` is the font's own name; ``table`` has the text of each byte, of fonts with single-byte codes."""

    def __init__(self, doc: Document, ref: Ref) -> None:
        node = doc.get(ref)
        self.base, self.map, self.width, self.table, self._chars = b"", None, 1, None, None
        if not isinstance(node, dict):
            self.table = base_encoding("")
            return
        self.base = as_name(node.get(b"BaseFont")) or b""
        source = doc.resolve(node.get(b"ToUnicode"))
        if isinstance(source, Stream):
            try:
                self.map = CMap(doc.decoded(source))
            except PdfError:
                pass
        if node.get(b"Subtype") == b"Type0" and isinstance(node[b"Subtype"], Name):
            self.width = self.map.width if self.map else 2
            return
        encoding, changes = node.get(b"Encoding"), {}
        base = as_name(encoding)
        if base is None and isinstance(own := doc.resolve(encoding), dict):
            base = as_name(own.get(b"BaseEncoding"))
            if isinstance(own.get(b"Differences"), list):
                changes = differences(own[b"Differences"])
        self.table = list(base_encoding((base or b"").decode("utf-8", "replace")))
        for code, name in changes.items():
            if (text := glyph_text(name)) is not None:
                self.table[code] = text
        for code, text in (self.map.texts if self.map else {}).items():
            if code < 256:
                self.table[code] = text

    def _decoder(self) -> str | dict | tuple:
        self._chars = _decoder(tuple(self.table))
        return self._chars

    def single(self) -> bool:
        """Whether a byte has one character at most."""
        return self.table is not None and isinstance(self._chars or self._decoder(), str)

    def text(self, raw: bytes) -> str:
        if self.table is not None:
            chars = self._chars or self._decoder()
            if chars.__class__ is tuple:
                return "".join([t for t in map(chars.__getitem__, raw) if t])
            return charmap_decode(raw, "ignore", chars)[0]
        if not self.map:
            return ""
        w, get = self.width, self.map.texts.get
        if w == 2:
            n = len(raw) // 2
            codes = [*struct.unpack(f">{n}H", raw[: 2 * n]), *raw[2 * n :]]
            return "".join(filter(None, map(get, codes)))
        return "".join([get(int.from_bytes(raw[i : i + w], "big"), "") for i in range(0, len(raw), w)])
