"""Stream filters and predictors."""

from __future__ import annotations

import re

import numpy as np

from vellumine.kernel.inflate import inflate
from vellumine.kernel.objects import Name, PdfError, Stream, as_int, lax_hex

_IMAGE_CODECS = frozenset([b"DCTDecode", b"DCT", b"JPXDecode", b"CCITTFaxDecode", b"CCF"])
_NOT_85 = re.compile(rb"[^!-uz]+")


def ascii85(data: bytes) -> bytes:
    """Groups of five; ``z`` between groups is four zeros, a group beyond 32 bits is dropped, ``~`` ends."""
    out, group = bytearray(), []
    for b in _NOT_85.sub(b"", data.split(b"~", 1)[0]):
        if b == 122:
            if not group:
                out += bytes(4)
            continue
        group.append(b - 33)
        if len(group) == 5:
            out += _group(group)
            group = []
    if group:
        out += _group(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _group(digits: list[int]) -> bytes:
    v = 0
    for d in digits:
        v = v * 85 + d
    return v.to_bytes(4, "big") if v < 1 << 32 else b""


def _bounded(parms: dict, key: bytes, default: int, most: int) -> int:
    v = as_int(parms.get(key))
    v = default if v is None else v
    if not 1 <= v <= most:
        raise PdfError("FILTER", f"predictor {key.decode()} is out of range: {v}")
    return v


def _average(raw: list[int], above: list[int]) -> list[int]:
    out, left = [], 0
    for v, up in zip(raw, above):
        left = (v + (left + up) // 2) & 255
        out.append(left)
    return out


def _nearest(raw: list[int], above: list[int]) -> list[int]:
    """Of the bytes on the left, above and between the one that is nearest to left + above - between; the first of several."""
    out, left, corner = [], 0, 0
    for v, up in zip(raw, above):
        a, b = abs(up - corner), abs(left - corner)
        c = abs(left + up - corner - corner)
        left = (v + (left if a <= b and a <= c else up if b <= c else corner)) & 255
        corner = up
        out.append(left)
    return out


def unpredict(data: bytes, parms: dict) -> bytes:
    """Rows with a tag byte each; a last row that isn't whole is dropped."""
    columns, colors, bits = _bounded(parms, b"Columns", 1, 1 << 20), _bounded(parms, b"Colors", 1, 32), _bounded(parms, b"BitsPerComponent", 8, 32)
    step, width = (colors * bits + 7) // 8, (columns * colors * bits + 7) // 8
    rows = np.frombuffer(data, np.uint8, len(data) // (width + 1) * (width + 1)).reshape(-1, width + 1)
    out = rows[:, 1:].copy()
    above = np.zeros(width, np.uint8)
    for tag, row in zip(rows[:, 0].tolist(), out):
        if tag == 1:
            for c in range(step):
                np.cumsum(row[c::step], dtype=np.uint8, out=row[c::step])
        elif tag == 2:
            row += above
        elif tag in (3, 4):
            fn = _average if tag == 3 else _nearest
            raw, up = row.tolist(), above.tolist()
            for c in range(step):
                row[c::step] = fn(raw[c::step], up[c::step])
        above = row
    return out.tobytes()


def filters_of(head: dict) -> list[bytes]:
    f = head.get(b"Filter")
    return [bytes(x) for x in ([f] if isinstance(f, Name) else f if isinstance(f, list) else []) if isinstance(x, Name)]


def decode(stream: Stream, data: bytes) -> bytes:
    p = stream.dict.get(b"DecodeParms")
    parms = [p] if isinstance(p, dict) else [x if isinstance(x, dict) else {} for x in p] if isinstance(p, list) else []
    out = stream.raw(data)
    for i, name in enumerate(filters_of(stream.dict)):
        own = parms[i] if i < len(parms) else {}
        if name in (b"FlateDecode", b"Fl"):
            out = inflate(out)
            predictor = as_int(own.get(b"Predictor"))
            if predictor is not None and predictor > 1:
                out = unpredict(out, own)
        elif name in (b"ASCIIHexDecode", b"AHx"):
            out = lax_hex(out)
        elif name in (b"ASCII85Decode", b"A85"):
            out = ascii85(out)
        elif name not in _IMAGE_CODECS:
            raise PdfError("FILTER", f"unsupported filter /{name.decode('utf-8', 'replace')}")
    return out
