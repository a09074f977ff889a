"""Cross-reference data, object streams and the page tree of one file."""

from __future__ import annotations

import re
from typing import NamedTuple

from vellumine.kernel.filters import decode
from vellumine.kernel.objects import U32_MAX, Name, Parser, PdfError, Ref, Stream, as_int

_STARTXREF = re.compile(rb"startxref[ \t\n\r\x0c]*([0-9]*)")
_UINT = re.compile(rb"[ \t\r\n]*([0-9]+)")
_AFTER_COUNT = re.compile(rb"[ \t]*(?:\r\n|\r|\n)?")
#: Numbers and places of an object stream, in one go.
_USUAL_HEADS = re.compile(rb" *+(?:[0-9]{1,9}+[ \n]++)*+")
#: The last bytes of a file in which startxref is looked for.
TAIL = 2048
MAX_TREE_DEPTH, MAX_CHAIN = 64, 32


class Entry(NamedTuple):
    """Where an object is: at an offset, or number ``at`` in the object stream ``stream``; neither if it is free."""

    at: int | None = None
    stream: int | None = None


def _xref(what: str) -> PdfError:
    return PdfError("XREF", what)


def find_startxref(data: bytes) -> int:
    tail = data[-TAIL:]
    at = tail.rfind(b"startxref")
    if at < 0:
        raise _xref("missing startxref")
    digits = _STARTXREF.match(tail, at)[1]
    if not digits or int(digits) >= 1 << 64:
        raise _xref("startxref is no number")
    return int(digits)


def _uint(p: Parser) -> int:
    m = _UINT.match(p.data, p.pos)
    if not m:
        raise _xref(f"expected an integer at {p.pos}")
    p.pos = m.end()
    if int(m[1]) > U32_MAX:
        raise _xref(f"integer overflow: {m[1].decode()}")
    return int(m[1])


def _digits(raw: bytes) -> int:
    raw = raw.strip()
    return int(raw) if raw.isdigit() else 0


def classic_table(data: bytes, at: int, out: dict[Ref, Entry]) -> dict:
    p = Parser(data, at + 4)
    p.skip()
    while not data.startswith(b"trailer", p.pos):
        first, count = _uint(p), _uint(p)
        p.pos = _AFTER_COUNT.match(data, p.pos).end()
        if count * 20 > len(data) - p.pos:
            raise _xref(f"section of {count} rows is longer than the rest of the file")
        if first + count > U32_MAX:
            raise _xref("section reaches past the largest number")
        for n in range(first, first + count):
            row = data[p.pos : p.pos + 20]
            p.pos += 20
            if not row[:16].isascii():
                raise _xref("row is no text")
            ref, kind = Ref(n, _digits(row[11:16]) & 0xFFFF), row[17:18]
            if ref not in out and kind in (b"n", b"f"):
                out[ref] = Entry(_digits(row[:10])) if kind == b"n" else Entry()
        p.skip()
    p.pos += 7
    trailer = p.value()
    if not isinstance(trailer, dict):
        raise _xref("trailer is no dictionary")
    return trailer


def stream_table(data: bytes, at: int, out: dict[Ref, Entry]) -> dict:
    _, stream = Parser(data, at).indirect()
    if not isinstance(stream, Stream):
        raise _xref("cross-reference stream is no stream")
    head, payload = stream.dict, decode(stream, data)
    widths = head.get(b"W")
    if not isinstance(widths, list):
        raise _xref("cross-reference stream has no W")
    widths = [max(as_int(x) or 0, 0) for x in widths]
    if len(widths) != 3:
        raise _xref(f"W has {len(widths)} entries")
    row = sum(widths)
    if not row:
        raise _xref("rows have no width")
    size = as_int(head.get(b"Size"))
    if size is None:
        raise _xref("cross-reference stream has no Size")
    index = head.get(b"Index")
    index = [max(as_int(x) or 0, 0) & U32_MAX for x in index] if isinstance(index, list) else [0, size & U32_MAX]
    at = 0
    w0, w1 = widths[0], widths[0] + widths[1]
    for first, count in zip(index[::2], index[1::2]):
        for n in range(first, first + count):
            if at + row > len(payload):
                raise _xref("cross-reference stream is cut off")
            if n > U32_MAX:
                raise _xref("Index reaches past the largest number")
            own = payload[at : at + row]
            at += row
            kind = int.from_bytes(own[:w0], "big") if w0 else 1
            a, b = int.from_bytes(own[w0:w1], "big"), int.from_bytes(own[w1:], "big")
            ref = Ref(n, 0)
            if ref not in out and kind in (0, 1, 2):
                out[ref] = Entry() if kind == 0 else Entry(a) if kind == 1 else Entry(b & U32_MAX, a & U32_MAX)
    return head


def read_chain(data: bytes, start: int) -> tuple[dict[Ref, Entry], dict]:
    """All entries, the newest first, and the newest trailer."""
    entries: dict[Ref, Entry] = {}
    trailer, seen, at = None, set(), start
    while at not in seen:
        seen.add(at)
        own = (classic_table if data.startswith(b"xref", at) else stream_table)(data, at, entries)
        trailer = own if trailer is None else trailer
        at = as_int(own.get(b"Prev")) or 0
        if at <= 0:
            break
    return entries, trailer


class Packed:
    """The objects of an object stream; a slot without a usable place is None."""

    def __init__(self, stream: Stream, data: bytes) -> None:
        self.body = body = decode(stream, data)
        n, first = as_int(stream.dict.get(b"N")), as_int(stream.dict.get(b"First"))
        if n is None or first is None:
            raise PdfError("OBJECT", "object stream without N or First")
        if not 0 <= n <= len(body) // 2:
            raise PdfError("OBJECT", f"object stream with N of {n}")
        if not 0 <= first <= len(body):
            raise PdfError("OBJECT", f"object stream with First of {first}")
        p, heads = Parser(body), []
        if (m := _USUAL_HEADS.match(body, 0, first)) and m.end() == first and len(numbers := [*map(int, m[0].split())]) >= 2 * n:
            heads, n = [(num, first + at) for num, at in zip(numbers[: 2 * n : 2], numbers[1 : 2 * n : 2])], 0
        for _ in range(n):
            p.skip()
            num = _uint(p)
            p.skip()
            heads.append((num, first + _uint(p)))
        ends = [at for _, at in heads[1:]] + [len(body)]
        self.slots = [(num, at, end) if at <= end <= len(body) else None for (num, at), end in zip(heads, ends)]

    def candidates(self, num: int, index: int) -> list[tuple[int, int, int]]:
        """The slot of that index if it has the number, else one that has; then the slot of that index."""
        own = self.slots[index] if index < len(self.slots) else None
        named = own if own and own[0] == num else next((s for s in self.slots if s and s[0] == num), None)
        return [s for i, s in enumerate((named, own)) if s and (i == 0 or s is not named)]


class Document:
    def __init__(self, data: bytes) -> None:
        if not data.startswith(b"%PDF-"):
            raise PdfError("NOT_PDF")
        self.data = data
        try:
            self._load()
        except RecursionError:
            raise PdfError("OBJECT", "nested too deep") from None

    def _load(self) -> None:
        data = self.data
        xref, trailer = read_chain(data, find_startxref(data))
        self.trailer = trailer
        self.objects: dict[Ref, object] = {}
        lengths: dict[Ref, int | None] = {}

        def length_of(ref: Ref) -> int | None:
            if ref not in lengths:
                lengths[ref] = None
                entry = xref.get(ref)
                if entry and entry.at is not None and entry.stream is None:
                    try:
                        own, value = Parser(data, entry.at).indirect()
                        if own == ref and type(value) is int and value >= 0:
                            lengths[ref] = value
                    except PdfError:
                        pass
            return lengths[ref]

        for ref, entry in sorted(xref.items()):
            if entry.at is not None and entry.stream is None:
                self._place(ref, entry.at, length_of)
        packed: dict[int, Packed] = {}
        for ref, entry in sorted(xref.items()):
            if entry.stream is None:
                continue
            if entry.stream not in packed:
                holder = self.objects.get(Ref(entry.stream, 0))
                if not isinstance(holder, Stream):
                    continue
                packed[entry.stream] = Packed(holder, data)
            own = packed[entry.stream]
            for _, a, b in own.candidates(ref.num, entry.at):
                try:
                    self.objects[ref] = Parser(own.body[a:b]).value()
                    break
                except PdfError:
                    continue
        self._repair(xref)
        self.pages = self._pages()

    def _place(self, ref: Ref, at: int, length_of) -> None:
        try:
            own, value = Parser(self.data, at).indirect(length_of)
        except PdfError:
            return
        if own.num == ref.num:
            self.objects[ref] = value

    def _repair(self, xref: dict[Ref, Entry]) -> None:
        """Reads streams again whose length is in an object stream and so wasn't known before."""
        new = {}

        def length_of(ref: Ref) -> int | None:
            v = self.objects.get(ref)
            return v if type(v) is int and v >= 0 else None

        for ref, entry in xref.items():
            value = self.objects.get(ref)
            if entry.at is None or entry.stream is not None or not isinstance(value, Stream):
                continue
            given = value.dict.get(b"Length")
            holder = xref.get(given) if isinstance(given, Ref) else None
            if not holder or holder.stream is None or holder.stream == ref.num or value.dict.get(b"Type") in (b"ObjStm", b"XRef") or length_of(given) is None:
                continue
            try:
                own, again = Parser(self.data, entry.at).indirect(length_of)
            except PdfError:
                continue
            if own == ref:
                new[ref] = again
        self.objects.update(new)

    def _pages(self) -> list[Ref]:
        root = self.trailer.get(b"Root")
        if not isinstance(root, Ref):
            raise PdfError("OBJECT", "trailer has no Root")
        catalog = self.objects.get(root)
        if not isinstance(catalog, dict):
            raise PdfError("OBJECT", "catalog is missing")
        top = catalog.get(b"Pages")
        if not isinstance(top, Ref):
            raise PdfError("OBJECT", "catalog has no Pages")
        out: list[Ref] = []

        def walk(ref: Ref, depth: int) -> None:
            if depth > MAX_TREE_DEPTH:
                raise PdfError("OBJECT", "page tree is too deep")
            node = self.objects.get(ref)
            if not isinstance(node, dict):
                return
            if _is(node, b"Page"):
                out.append(ref)
                return
            kids = node.get(b"Kids")
            for kid in kids if isinstance(kids, list) else ():
                if isinstance(kid, Ref):
                    own = self.objects.get(kid)
                    if isinstance(own, dict) and _is(own, b"Page"):
                        out.append(kid)
                    else:
                        walk(kid, depth + 1)

        walk(top, 0)
        return out

    def get(self, ref: Ref):
        return self.objects.get(ref)

    def resolve(self, value):
        """Follows references; one that leads nowhere stays."""
        for _ in range(MAX_CHAIN):
            if not isinstance(value, Ref) or value not in self.objects:
                break
            value = self.objects[value]
        return value

    def decoded(self, stream: Stream) -> bytes:
        return decode(stream, self.data)

    def catalog(self) -> dict | None:
        """The catalog with the least number, else an object that has a structure tree."""
        other = None
        for _, v in sorted(self.objects.items()):
            if isinstance(v, dict):
                if _is(v, b"Catalog"):
                    return v
                if b"StructTreeRoot" in v:
                    other = v
        return other

    def content(self, page: Ref) -> bytes | None:
        """The page's content; parts that can't be decoded are left out, of a single one nothing is left."""
        node = self.objects.get(page)
        if not isinstance(node, dict) or b"Contents" not in node:
            return None
        what = self.resolve(node[b"Contents"])
        if isinstance(what, Stream):
            try:
                return self.decoded(what)
            except PdfError:
                return None
        if not isinstance(what, list):
            return None
        out = bytearray()
        for x in what:
            x = self.resolve(x)
            if isinstance(x, Stream):
                try:
                    part = self.decoded(x)
                except PdfError:
                    continue
                if out and out[-1:] not in (b" ", b"\t", b"\n", b"\r", b"\x0c"):
                    out += b"\n"
                out += part
        return bytes(out)

    def page_resources(self, page: Ref) -> dict:
        ref = page
        for _ in range(MAX_TREE_DEPTH):
            node = self.objects.get(ref)
            if not isinstance(node, dict):
                return {}
            if b"Resources" in node:
                return self.as_dict(node[b"Resources"])
            ref = node.get(b"Parent")
            if not isinstance(ref, Ref):
                return {}
        return {}

    def as_dict(self, value) -> dict:
        value = self.objects.get(value) if isinstance(value, Ref) else value
        return value if isinstance(value, dict) else {}

    def named(self, resources: dict, kind: bytes) -> dict[bytes, Ref]:
        """Resource names of a kind that lead to indirect objects."""
        return {k: v for k, v in self.as_dict(resources.get(kind)).items() if isinstance(v, Ref)}


def _is(node: dict, kind: bytes) -> bool:
    return isinstance(node.get(b"Type"), Name) and node[b"Type"] == kind


