"""Small PDF files from Python values."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Builder:
    """Objects by number, written in order; number 1 is the catalog and number 2 the page tree."""

    objects: dict[int, bytes] = field(default_factory=dict)
    pages: list[int] = field(default_factory=list)
    catalog_extra: bytes = b""

    def add(self, body: bytes) -> int:
        n = max([2, *self.objects]) + 1
        self.objects[n] = body
        return n

    def stream(self, payload: bytes, head: bytes = b"", flate: bool = False) -> int:
        if flate:
            payload, head = zlib.compress(payload, 6), head + b" /Filter /FlateDecode"
        return self.add(b"<<%s /Length %d>>\nstream\n%s\nendstream" % (head, len(payload), payload))

    def font(self, base: bytes = b"Helvetica", extra: bytes = b"/Encoding /WinAnsiEncoding") -> int:
        return self.add(b"<</Type /Font /Subtype /Type1 /BaseFont /%s %s>>" % (base, extra))

    def page(self, content: bytes | int, resources: bytes = b"", flate: bool = True, extra: bytes = b"") -> int:
        ref = content if isinstance(content, int) else self.stream(content, flate=flate)
        n = self.add(b"<</Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents %d 0 R /Resources <<%s>> %s>>" % (ref, resources, extra))
        self.pages.append(n)
        return n

    def _whole(self) -> dict[int, bytes]:
        kids = b" ".join(b"%d 0 R" % p for p in self.pages)
        return {1: b"<</Type /Catalog /Pages 2 0 R %s>>" % self.catalog_extra, 2: b"<</Type /Pages /Count %d /Kids [%s]>>" % (len(self.pages), kids), **self.objects}

    def build(self) -> bytes:
        """With a classic cross-reference table."""
        out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), {}
        objects = self._whole()
        for n in sorted(objects):
            places[n] = len(out)
            out += b"%d 0 obj\n%s\nendobj\n" % (n, objects[n])
        start, size = len(out), max(objects) + 1
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size
        for n in range(1, size):
            out += b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 00000 f \n"
        return bytes(out + b"trailer\n<</Size %d /Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (size, start))

    def build_packed(self) -> bytes:
        """With a cross-reference stream; what is no stream goes into an object stream."""
        out, rows = bytearray(b"%PDF-1.5\n"), {0: (0, 0, 65535)}
        objects = self._whole()
        holder, table = max(objects) + 1, max(objects) + 2
        packed = [n for n in sorted(objects) if b"stream\n" not in objects[n]]
        heads, bodies = [], bytearray()
        for i, n in enumerate(packed):
            heads.append(b"%d %d" % (n, len(bodies)))
            bodies += objects[n] + b" "
            rows[n] = (2, holder, i)
        head = b" ".join(heads) + b" "
        payload = zlib.compress(head + bytes(bodies))
        plain = {n: objects[n] for n in objects if n not in packed}
        plain[holder] = b"<</Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d>>\nstream\n%s\nendstream" % (len(packed), len(head), len(payload), payload)
        for n in sorted(plain):
            rows[n] = (1, len(out), 0)
            out += b"%d 0 obj\n%s\nendobj\n" % (n, plain[n])
        start = len(out)
        rows[table] = (1, start, 0)
        body = zlib.compress(b"".join(bytes([rows.get(n, (0, 0, 0))[0]]) + rows.get(n, (0, 0, 0))[1].to_bytes(4, "big") + rows.get(n, (0, 0, 0))[2].to_bytes(2, "big") for n in range(table + 1)))
        out += b"%d 0 obj\n<</Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /Filter /FlateDecode /Length %d>>\nstream\n%s\nendstream\nendobj\n" % (table, table + 1, len(body), body)
        return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def literal(text: str) -> bytes:
    """A literal string in WinAnsi; characters that it lacks are question marks."""
    raw = text.encode("cp1252", "replace")
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")"


def text_content(lines: list[str], x: float = 50, y: float = 750, size: float = 12, leading: float = 14, blank: float = 24, show: Callable[[str], bytes] = lambda t: literal(t) + b" Tj") -> bytes:
    """Lines below each other; an empty line leaves a gap. ``show`` gives the operator that writes a line."""
    out = [b"BT /F1 %g Tf" % size]
    for line in lines:
        if not line.strip():
            y -= blank
            continue
        out.append(b"1 0 0 1 %g %g Tm %s" % (x, y, show(line)))
        y -= leading
    return b"\n".join([*out, b"ET"])


def text_pdf(pages: list[list[str]], packed: bool = False) -> bytes:
    b = Builder()
    font = b.font()
    for lines in pages:
        b.page(text_content(lines), b"/Font <</F1 %d 0 R>>" % font)
    return b.build_packed() if packed else b.build()
