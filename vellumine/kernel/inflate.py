"""Inflate with zlib, and a slow reader for streams that zlib turns down."""

from __future__ import annotations

import zlib
from itertools import accumulate

from vellumine.kernel.objects import PdfError

MAX_OUTPUT = 128 << 20

_LENGTH_BITS = [0] * 8 + [n for n in range(1, 6) for _ in range(4)] + [0]
_LENGTHS = [3 + x for x in accumulate([0, *(1 << b for b in _LENGTH_BITS[:-2])])] + [258]
_DISTANCE_BITS = [0, 0, *(n for n in range(14) for _ in range(2))]
_DISTANCES = [1 + x for x in accumulate([0, *(1 << b for b in _DISTANCE_BITS[:-1])])]
_ORDER = [16, 17, 18, 0] + [x for i in range(8) for x in (8 + i, 7 - i)][:-1]


def fail(what: str) -> PdfError:
    return PdfError("DEFLATE", what)


class Bits:
    """Bits from the low end of each byte; past the end they are 0."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0  # at: in bits

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 4], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at = min(self.at + n, 8 * len(self.data))
        return v


class Codes:
    def __init__(self, lengths: list[int]) -> None:
        self.bits = max(lengths, default=0)
        self.table: list[tuple[int, int] | None] = [None] * (1 << self.bits)
        code = 0
        for size in range(1, self.bits + 1):
            code <<= 1
            for symbol, own in enumerate(lengths):
                if own == size:
                    flipped = int(f"{code:0{size}b}"[::-1], 2) if code < 1 << size else 1 << self.bits
                    for i in range(flipped, 1 << self.bits, 1 << size):
                        self.table[i] = (symbol, size)
                    code += 1

    def next(self, bits: Bits) -> int:
        found = self.table[bits.peek(self.bits)]
        if not found:
            raise fail("invalid code")
        bits.at = min(bits.at + found[1], 8 * len(bits.data))
        return found[0]


_FIXED = Codes([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), Codes([5] * 30)


def _tables(bits: Bits) -> tuple[Codes, Codes]:
    literals, distances, n = bits.read(5) + 257, bits.read(5) + 1, bits.read(4) + 4
    if literals > 286 or distances > 30:
        raise fail("too many codes")
    sizes = [0] * 19
    for i in _ORDER[:n]:
        sizes[i] = bits.read(3)
    codes, lengths, total = Codes(sizes), [], literals + distances
    while len(lengths) < total:
        s = codes.next(bits)
        if s < 16:
            lengths.append(s)
        elif s == 16:
            lengths += [lengths[-1] if lengths else 0] * (3 + bits.read(2))
        else:
            lengths += [0] * (3 + bits.read(3) if s == 17 else 11 + bits.read(7))
    lengths = lengths[:total]
    return Codes(lengths[:literals]), Codes(lengths[literals:])


def slow_inflate(data: bytes) -> bytes:
    bits, out, last = Bits(data), bytearray(), 0
    while not last:
        last, kind = bits.read(1), bits.read(2)
        if kind == 3:
            raise fail("reserved kind of block")
        if kind == 0:
            at = (bits.at + 7) >> 3
            if at + 4 > len(data):
                raise fail("stored block is cut off")
            size, check = int.from_bytes(data[at : at + 2], "little"), int.from_bytes(data[at + 2 : at + 4], "little")
            if size ^ check != 0xFFFF:
                raise fail("stored block has a bad length")
            if len(out) + size > MAX_OUTPUT:
                raise fail("output is too large")
            if at + 4 + size > len(data):
                raise fail("stored block is cut off")
            out += data[at + 4 : at + 4 + size]
            bits.at = 8 * (at + 4 + size)
            continue
        literals, distances = _FIXED if kind == 1 else _tables(bits)
        end = 8 * len(data)
        while True:
            ended = bits.at >= end  # from here on all bits are 0, so one symbol comes for ever
            if (s := literals.next(bits)) == 256:
                break
            if len(out) >= MAX_OUTPUT or ended and s < 256:
                raise fail("output is too large")
            if s < 256:
                out.append(s)
                continue
            if s - 257 >= len(_LENGTHS):
                raise fail("invalid length")
            size = _LENGTHS[s - 257] + bits.read(_LENGTH_BITS[s - 257])
            d = distances.next(bits)
            far = _DISTANCES[d] + bits.read(_DISTANCE_BITS[d])
            if far > len(out):
                raise fail("distance reaches before the start")
            if ended or len(out) + size > MAX_OUTPUT:
                raise fail("output is too large")
            if far >= size:
                out += out[len(out) - far : len(out) - far + size]
            else:
                out += (out[-far:] * (size // far + 1))[:size]
    return bytes(out)


def inflate(data: bytes) -> bytes:
    """The payload of a zlib stream; its checksum, the last four bytes, isn't looked at."""
    if len(data) < 2:
        raise fail("stream is cut off")
    if data[0] & 15 != 8:
        raise fail(f"unknown method {data[0] & 15}")
    if (data[0] << 8 | data[1]) % 31:
        raise fail("bad header")
    start = 2
    if data[1] & 32:
        if len(data) < 6:
            raise fail("dictionary is cut off")
        start = 6
    body = data[start : max(len(data) - 4, start)]
    z = zlib.decompressobj(-15)
    try:
        out = z.decompress(body, MAX_OUTPUT + 1)
        if z.eof:
            if len(out) > MAX_OUTPUT:
                raise fail("output is too large")
            return out
        if len(out) > MAX_OUTPUT:
            raise fail("output is too large")
    except zlib.error:
        pass
    return slow_inflate(body)
