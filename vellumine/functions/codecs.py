"""Decoding of stream filters, and colours, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.kernel import filters, inflate
from vellumine.kernel.objects import PdfError


#: Values that are decoded before they go into an array.
SLICE = 200


def mapped(fn: Callable[[object], bytes | None], values: pa.Array) -> pa.Array:
    """``fn`` of each value, null for null; few values at a time are Python's, the rest stays in Arrow."""
    parts = [pa.array([None if x is None else fn(x) for x in values.slice(lo, SLICE).to_pylist()], pa.binary()) for lo in range(0, len(values), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def _each(fn: Callable[[bytes], bytes]):
    """A vectorised function of a binary column; null for null, and for what can't be decoded."""

    def one(x):
        try:
            return fn(x)
        except PdfError:
            return None

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return mapped(one, values)

    return run


def flate(c: Column) -> Column:
    return _each(inflate.inflate)(c)


def ascii85(c: Column) -> Column:
    return _each(filters.ascii85)(c)


def unpredict(c: Column, columns: int, colors: int = 1, bits: int = 8) -> Column:
    return _each(lambda raw: filters.unpredict(raw, {b"Columns": columns, b"Colors": colors, b"BitsPerComponent": bits}))(c)


def ascii_hex(c: Column) -> Column:
    """Hex digits of a string up to ``>``; others are passed over, an odd one is followed by 0."""
    digits = F.regexp_replace(F.substring_index(c, ">", 1), "[^0-9A-Fa-f]", "")
    return F.unhex(F.concat(digits, F.when(F.length(digits) % 2 == 1, F.lit("0")).otherwise(F.lit(""))))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """struct(r, g, b) of bytes as integers."""
    return F.struct(*((F.lit(255) - F.least(x + k, F.lit(255))).cast("int").alias(n) for n, x in (("r", c), ("g", m), ("b", y))))


def map_range(low: Column, high: Column, text: Column) -> Column:
    """array of struct(code, text) for a range of codes whose first one is the one-character ``text``."""
    return F.transform(F.sequence(low, high), lambda code: F.struct(code.alias("code"), F.chr(F.ascii(text) + code - low).alias("text")))
