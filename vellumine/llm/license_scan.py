"""Fuzzy search for short license notices.

A notice that occurs with at most k edits keeps at least one of any k + 1 pieces
of it unchanged. The pieces of all notices are found in one pass of an automaton;
around each hit, unless it lacks too many grams of the notice, the bounded-error
matching of the regex library decides.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.common import lean, row_slices, table

GRAM = 3
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 10

NOTICES = (
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("Apache-2.0", "licensed under the apache license, version 2.0"),
    ("GPL-2.0", "licensed under the gnu general public license, version 2"),
    ("GPL-3.0", "licensed under the gnu general public license, version 3"),
    ("GPL", "under the terms of the gnu general public license"),
    ("LGPL", "under the terms of the gnu lesser general public license"),
    ("AGPL", "under the terms of the gnu affero general public license"),
    ("BSD", "redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD", "use of this source code is governed by a bsd-style license"),
    ("MPL-2.0", "subject to the terms of the mozilla public license, v. 2.0"),
    ("ISC", "permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("EPL", "made available under the terms of the eclipse public license"),
    ("BSL-1.0", "distributed under the boost software license, version 1.0"),
    ("CC-BY-4.0", "licensed under a creative commons attribution 4.0 international license"),
    ("CC-BY-SA-4.0", "licensed under a creative commons attribution-sharealike 4.0 international license"),
    ("CC-BY-NC-4.0", "licensed under a creative commons attribution-noncommercial 4.0 international license"),
    ("CC-BY-ND-4.0", "licensed under a creative commons attribution-noderivatives 4.0 international license"),
    ("CC-BY-NC-SA-4.0", "licensed under a creative commons attribution-noncommercial-sharealike 4.0 international license"),
    ("CC-BY-NC-ND-4.0", "licensed under a creative commons attribution-noncommercial-noderivatives 4.0 international license"),
    ("CC-BY-4.0", "licensed under cc by 4.0"),
    ("CC-BY-SA-4.0", "licensed under cc by-sa 4.0"),
    ("CC-BY-NC-4.0", "licensed under cc by-nc 4.0"),
    ("CC-BY-ND-4.0", "licensed under cc by-nd 4.0"),
    ("CC-BY-NC-SA-4.0", "licensed under cc by-nc-sa 4.0"),
    ("CC-BY-NC-ND-4.0", "licensed under cc by-nc-nd 4.0"),
    ("CC0-1.0", "dedicated to the public domain under cc0 1.0 universal"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
)


class Notice(NamedTuple):
    name: str
    text: str
    edits: int
    pattern: regex.Pattern
    grams: tuple[str, ...]
    least: int  #: of the grams, so many are left unchanged by that many edits


class Search(NamedTuple):
    notices: list[Notice]
    seeds: ahocorasick.Automaton  #: values: list of (notice, offset, length)


def split(text: str, parts: int) -> list[tuple[int, str]]:
    """(offset, piece) of nearly equal pieces."""
    cuts = [len(text) * i // parts for i in range(parts + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


@cache
def build(notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> Search:
    out, seeds = [], {}
    for n, (name, text) in enumerate(notices):
        text = fold(text)
        k = len(text) // chars_per_edit
        grams = tuple(text[i : i + GRAM] for i in range(len(text) - GRAM + 1))
        out.append(Notice(name, text, k, regex.compile(f"(?e)(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}"), grams, len(grams) - GRAM * k))
        for offset, piece in split(text, k + 1):
            seeds.setdefault(piece, []).append((n, offset))
    automaton = ahocorasick.Automaton()
    for piece, uses in seeds.items():
        automaton.add_word(piece, (len(piece), uses))
    automaton.make_automaton()
    return Search(out, automaton)


def fold(text: str) -> str:
    """Lower case and plain spaces, one character for each."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace(" ", " ")


def _verify(low: str, lo: int, hi: int, notice: Notice) -> Iterator[tuple[int, int, int]]:
    """(start, end, edits) in a window: exact ones, and what bounded-error matching finds beside them.

    Each edit changes at most ``GRAM`` grams, so a window that lacks too many of
    them holds no match; that is cheaper to tell than to match.
    """
    size = len(notice.text)
    while lo < hi:
        at = low.find(notice.text, lo, hi)
        end = at if at >= 0 else hi
        if end - lo >= size - notice.edits:
            window = low[lo:end]
            if sum(g in window for g in notice.grams) >= notice.least:
                for m in notice.pattern.finditer(low, lo, end):
                    yield m.start(), m.end(), sum(m.fuzzy_counts)
        if at < 0:
            return
        yield at, at + size, 0
        lo = at + size


def scan(text: str, search: Search) -> list[tuple[str, int, int, int]]:
    """(license, start, end, edits) of each notice, in order of place."""
    low = fold(text)
    windows: dict[int, list[list[int]]] = {}
    for end, (size, uses) in search.seeds.iter(low):
        for n, offset in uses:
            notice = search.notices[n]
            start = end + 1 - size - offset
            lo, hi = max(0, start - notice.edits), min(len(low), start + len(notice.text) + 2 * notice.edits)
            windows.setdefault(n, []).append([lo, hi])
    found = []
    for n, own in windows.items():
        own.sort()
        merged = [own[0]]
        for lo, hi in own[1:]:
            if lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        notice = search.notices[n]
        for lo, hi in merged:
            found += [(notice.name, *x) for x in _verify(low, lo, hi, notice)]
    # of notices that overlap the one with the fewest edits stays, then the longest
    found.sort(key=lambda x: (x[3], x[1] - x[2], x[1], x[0]))
    kept: list[tuple[int, int, str, int]] = []  # by place; they don't overlap
    for name, start, end, edits in found:
        at = bisect_left(kept, (start,))
        if (at == len(kept) or kept[at][0] >= end) and (at == 0 or kept[at - 1][1] <= start):
            kept.insert(at, (start, end, name, edits))
    return [(name, start, end, edits) for start, end, name, edits in kept]


SCHEMA = "doc_id long, license string, start long, end long, edits long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])


def license_notices(docs: DataFrame, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Every short license notice: doc_id, license, start and end (in characters), edits.

    A notice may have one edit (a character put in, left out or changed) for each
    ``chars_per_edit`` of its characters; case doesn't count, any white space
    character is a space. Only ``notices`` are looked for. Comment marks and
    indentation between wrapped lines count as edits. Of notices that overlap the one with the fewest edits
    is given. Null and empty texts have none, a null doc_id stays null, repeated
    rows give their notices again. Other columns are ignored; an empty table
    gives no rows.
    """
    notices = tuple(tuple(x) for x in notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = build(notices, chars_per_edit)
        for batch in row_slices(batches, "text"):
            rows = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if t:
                    rows += [(i, *x) for x in scan(t, search)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), SCHEMA)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices(table(spark, sf_dir, "documents"))
