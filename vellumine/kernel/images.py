"""Image objects as files: JPEG data as it is, 8-bit rasters as PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from vellumine.kernel.document import Document
from vellumine.kernel.filters import filters_of
from vellumine.kernel.objects import Name, PdfError, Ref, Stream, as_int, as_name

#: Images of Forms that are looked at, those with the least numbers.
MAX_FORM_IMAGES = 16_384
_BLOCK = 65_535
_CHANNELS = {b"DeviceGray": 1, b"G": 1, b"DeviceRGB": 3, b"RGB": 3, b"DeviceCMYK": 4, b"CMYK": 4}


def png(width: int, height: int, channels: int, pixels: bytes) -> bytes:
    """Rows without a filter in stored blocks."""
    row = width * channels
    lines = np.zeros((height, row + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(pixels, np.uint8, row * height).reshape(height, row)
    raw = lines.tobytes()
    parts = [b"\x78\x01"]
    for at in range(0, len(raw), _BLOCK):
        part = raw[at : at + _BLOCK]
        parts.append(struct.pack("<BHH", at + _BLOCK >= len(raw), len(part), len(part) ^ 0xFFFF) + part)
    parts.append(struct.pack(">I", zlib.adler32(raw)))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", b"".join(parts)) + chunk(b"IEND", b"")


def cmyk_to_rgb(pixels: bytes) -> bytes:
    p = np.frombuffer(pixels, np.uint8, len(pixels) // 4 * 4).reshape(-1, 4).astype(np.int16)
    return (255 - np.minimum(p[:, :3] + p[:, 3:], 255)).astype(np.uint8).tobytes()


def _either(head: dict, *keys: bytes):
    return next((head[k] for k in keys if k in head), None)


def _raster(head: dict, data: bytes) -> bytes | None:
    width, height = as_int(_either(head, b"Width", b"W")), as_int(_either(head, b"Height", b"H"))
    if width is None or height is None or not (0 < width < 1 << 32 and 0 < height < 1 << 32):
        return None
    bits = as_int(_either(head, b"BitsPerComponent", b"BPC"))
    space = _either(head, b"ColorSpace", b"CS")
    space = space[0] if isinstance(space, list) and space else space
    channels = _CHANNELS.get(as_name(space) or b"")
    if bits not in (None, 8) or channels is None:
        return None
    size = width * height * channels
    if len(data) < size:
        return None
    return png(width, height, 3, cmyk_to_rgb(data[:size])) if channels == 4 else png(width, height, channels, data[:size])


def is_image(doc: Document, ref: Ref) -> bool:
    s = doc.get(ref)
    return isinstance(s, Stream) and isinstance(s.dict.get(b"Subtype"), Name) and s.dict[b"Subtype"] == b"Image"


def extract(doc: Document, ref: Ref) -> tuple[str, bytes] | None:
    """(extension, bytes) of an image in a supported form."""
    stream = doc.get(ref)
    names = filters_of(stream.dict)
    try:
        if names and names[-1] in (b"DCTDecode", b"DCT", b"JPXDecode"):
            raw = stream.raw(doc.data) if len(names) == 1 else doc.decoded(stream)
            return ("jp2" if names[-1] == b"JPXDecode" else "jpg"), bytes(raw)
        made = _raster(stream.dict, doc.decoded(stream))
    except PdfError:
        return None
    return ("png", made) if made else None


def collect(doc: Document, page_refs: list[dict[bytes, Ref]], form_refs: list[dict[bytes, Ref]]) -> tuple[list[tuple[str, bytes]], dict[Ref, str]]:
    """Files in order of their objects, and the file name of each object; only what could be read gets a number."""
    on_pages = {r for refs in page_refs for r in refs.values() if is_image(doc, r)}
    in_forms = sorted({r for refs in form_refs for r in refs.values() if is_image(doc, r)} - on_pages)[:MAX_FORM_IMAGES]
    files, names = [], {}
    for ref in sorted(on_pages.union(in_forms)):
        if made := extract(doc, ref):
            names[ref] = f"img-{len(files) + 1:03}.{made[0]}"
            files.append((names[ref], made[1]))
    return files, names
