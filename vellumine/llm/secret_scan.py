"""Secrets by token efficiency.

A vocabulary of subwords writes words in few tokens and random strings in many.
A run of key characters that needs a token for every two characters, or less,
is reported, unless it is a known kind of digest or identifier. Where a run as a
whole needs fewer, as a path around a key does, its random parts are. Without a
digit, a string needs a secret's label before it, or capitals beyond the
first letter, small letters and less than ``LETTERS_RATIO``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.common import lean, row_slices, table
from vellumine.llm.tokens import VOCABULARY, encoding

MIN_CHARS = 16
#: Characters a token; what has fewer counts as random. A shorter run says too little: its ratio varies by chance.
MAX_RATIO = 2.0
#: The same for hex digits, of which a token holds more, and after a secret's label; and for letters only without a label.
WIDE_RATIO, LETTERS_RATIO = 2.5, 1.7
#: Distinct characters that a random string has at least.
MIN_DISTINCT = 8
#: How far before a run its label may stand.
CONTEXT = 32
#: Parts of a run with fewer characters than this say nothing by themselves.
MIN_PART = 4
MASK = "[SECRET]"

_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_CHARS)
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_HEX = re.compile(r"(?:0x)?([0-9a-fA-F]+)")
_BASE64 = re.compile(r"([A-Za-z0-9+/_-]+)={0,2}")
_DATA_URI = re.compile(r"data:[\w.+-]+/[\w.+-]+(?:;[\w.+=-]+)*;base64,$", re.I)
_PART = re.compile(r"[^/_-]+")
_DIGEST_CHARS = {32, 40, 56, 64, 96, 128}
#: After a digest's label: also 64-bit sums and object ids; base64 of 16, 20, 28, 32, 48 and 64 bytes.
_LABELLED_HEX, _LABELLED_BASE64 = _DIGEST_CHARS | {16, 24}, {22, 27, 38, 43, 64, 86}
_INTEGRITY = re.compile(r"sha(?:1|224|256|384|512)-[A-Za-z0-9+/]+={0,2}")
_LABEL = re.compile(
    r"(?P<secret>token(?!iz|is)|secret|passw(?:or)?d|pwd|passphrase|api[_ -]?key|access[_ -]?key|private[_ -]?key|client[_ -]?key|auth(?!or(?!iz|is))|bearer|credential)"
    r"|(?P<digest>md5|sha-?\d+|sha\b|blake\d|crc\d*|digest|checksum|hash|commit|revision|\brev\b|etag|integrity|fingerprint|uuid|guid|\bid\b|base64,)",
    re.I,
)


class Finding(NamedTuple):
    start: int
    end: int
    n_tokens: int
    label: str | None


def _label(before: str) -> str | None:
    """``secret`` if such a word stands before a string, else ``digest`` if one of those does."""
    found = {m.lastgroup for m in _LABEL.finditer(before)}
    return "secret" if "secret" in found else "digest" if found else None


def _known(run: str, label: str | None) -> bool:
    """Whether a string is a digest or an identifier by its form, of which more count after a digest's label."""
    if label == "secret":
        return False
    if _UUID.fullmatch(run) or _INTEGRITY.fullmatch(run):
        return True
    if m := _HEX.fullmatch(run):
        return len(m[1]) in (_LABELLED_HEX if label == "digest" else _DIGEST_CHARS)
    return label == "digest" and bool(m := _BASE64.fullmatch(run)) and len(m[1]) in _LABELLED_BASE64 and any(c.isdigit() for c in run)


def _bound(s: str, label: str | None, max_ratio: float) -> float:
    return max(max_ratio, WIDE_RATIO) if label == "secret" or _HEX.fullmatch(s) else max_ratio


def _random(s: str, label: str | None, encode, max_ratio: float) -> int:
    """The tokens of a string that looks random, else 0."""
    if len(s) < MIN_CHARS or len(set(s)) < MIN_DISTINCT or not any(c.isalpha() for c in s):
        return 0
    n = len(encode(s))
    if label != "secret" and not any("0" <= c <= "9" for c in s):
        return n if s.upper() != s and s[1:] != s[1:].lower() and len(s) < min(max_ratio, LETTERS_RATIO) * n else 0
    return n if len(s) < _bound(s, label, max_ratio) * n else 0


def _parts(run: str, label: str | None, encode, max_ratio: float) -> Iterator[tuple[int, int]]:
    """(start, end) of each longest row of random parts between / - and _; short parts don't end a row."""
    start = end = -1
    for m in _PART.finditer(run):
        if len(m[0]) < MIN_PART:
            continue
        if len(m[0]) < _bound(m[0], label, max_ratio) * len(encode(m[0])):
            start, end = m.start() if start < 0 else start, m.end()
        elif start >= 0:
            yield start, end
            start = -1
    if start >= 0:
        yield start, end


def scan(text: str, encode, max_ratio: float = MAX_RATIO) -> list[Finding]:
    out = []
    for m in _RUN.finditer(text):
        run, at = m[0], m.start()
        label = _label(text[max(0, at - CONTEXT) : at])
        if _known(run, label) or label != "secret" and _DATA_URI.search(text[max(0, at - 4 * CONTEXT) : at]):
            continue
        if n := _random(run, label, encode, max_ratio):
            out.append(Finding(at, m.end(), n, label))
            continue
        if len(set(run)) < MIN_DISTINCT:
            continue
        for a, b in _parts(run, label, encode, max_ratio):
            own = label if label == "secret" else _label(text[max(0, at + a - CONTEXT) : at + a])
            if not _known(run[a:b], own) and (n := _random(run[a:b], own, encode, max_ratio)):
                out.append(Finding(at + a, at + b, n, own))
    return out


SCHEMA = "doc_id long, start long, end long, n_tokens long, chars_per_token double, labelled boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()), ("labelled", pa.bool_())])
_MAYBE = r"[A-Za-z0-9+/_-]{%d,}" % MIN_CHARS


def _suspects(text: pa.Array) -> list[int]:
    """Rows with a long run of key characters; the rest can have no finding."""
    ok = pc.match_substring_regex(text, _MAYBE)
    return pc.indices_nonzero(pc.fill_null(ok, False)).to_pylist()


def secrets(docs: DataFrame, path: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Each random string of each document: doc_id, start, end (in characters), n_tokens, chars_per_token, labelled.

    A string is a run of ASCII letters, digits and + / _ -, of ``MIN_CHARS`` or
    more with ``MIN_DISTINCT`` different ones at least; shorter ones and those
    of other characters aren't looked at. ``labelled`` tells whether a word like
    token or password stands within ``CONTEXT`` characters before. Digests of usual lengths and UUIDs count as known unless such a word
    does; after a word like sha256 or commit, more lengths and base64 do. Null and empty
    texts have no findings, a null doc_id stays null, repeated rows give their
    findings again. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in row_slices(batches, "text"):
            ids, text, rows = batch.column("doc_id"), batch.column("text"), []
            for i in _suspects(text):
                t = text[i].as_py()
                rows += [(ids[i].as_py(), f.start, f.end, f.n_tokens, (f.end - f.start) / f.n_tokens, f.label == "secret") for f in scan(t, encode, max_ratio)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), SCHEMA)


def redact(docs: DataFrame, path: str = VOCABULARY, max_ratio: float = MAX_RATIO, mask: str = MASK) -> DataFrame:
    """``docs`` with each finding of ``secrets`` replaced by ``mask``; all rows and columns stay, n_chars follows if it is there.

    Null and empty texts stay as they are, repeated rows are masked alike, an
    empty table stays empty.
    """
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in row_slices(batches, "text"):
            text = batch.column("text")
            new: dict[int, str] = {}
            for i in _suspects(text):
                t = text[i].as_py()
                if found := scan(t, encode, max_ratio):
                    parts, at = [], 0
                    for f in found:
                        parts += [t[at : f.start], mask]
                        at = f.end
                    new[i] = "".join([*parts, t[at:]])
            if new:
                values = text.to_pylist()
                for i, t in new.items():
                    values[i] = t
                text = pa.array(values, text.type)
            yield pa.RecordBatch.from_arrays([text if n == "text" else c for n, c in zip(batch.schema.names, batch.columns)], names=batch.schema.names)

    out = docs.mapInArrow(lean(run), docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
