"""The decoder over a column of file contents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vellumine import schemas
from vellumine.kernel.convert import convert
from vellumine.kernel.extract import extract
from vellumine.kernel.content import Span
from vellumine.kernel.objects import PdfError

MODES = ("PERMISSIVE", "FAILFAST")
#: Files or results that are held before they are passed on, in bytes of files and of what comes of them.
FLUSH = 2 << 20
#: Bytes of Python that a span takes; a rectangle or a role takes less and counts as much.
_SPAN = 660


def _kept(df: DataFrame, content: str, new: str) -> tuple[list[str], StructType]:
    """Columns that go through: all but the content and those that the result would repeat."""
    added = StructType.fromDDL(new)
    names = {f.name.lower() for f in added}
    keep = [c for c in df.columns if c != content and c.lower() not in names]
    return keep, StructType([*(df.schema[c] for c in keep), *added])


def _check(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")


def _size(row: dict) -> int:
    """Bytes, about, of what came of a file: it can be many times the file, as that is compressed."""
    drawn = sum(len(p["spans"]) + len(p["rects"]) for p in row.get("pages") or ()) + len(row.get("roles") or ())
    return len(row.get("markdown") or "") + _SPAN * drawn + sum(len(x["bytes"]) for x in row.get("images") or ())


def results(batches: Iterator[pa.RecordBatch], one: Callable[[bytes], dict], keep: list[str], fields: list[str], arrow: pa.Schema, mode: str) -> Iterator[pa.RecordBatch]:
    """Batches of ``keep`` and of what ``one`` makes of each content; those of a batch are passed on as they fill ``FLUSH``."""
    for batch in batches:
        values, lo, rows, size = batch.column("__content"), 0, [], 0
        for i in range(batch.num_rows):
            raw = values[i].as_py()
            try:
                if raw is None:
                    raise PdfError("NOT_PDF")
                row = one(raw) | {"error": None}
            except PdfError as e:
                if mode == "FAILFAST":
                    raise
                row = {"error": {"code": e.code, "message": str(e)}}
            rows.append(row)
            size += len(raw or b"") + _size(row)
            if size >= FLUSH or i + 1 == batch.num_rows:
                own = batch.slice(lo, len(rows))
                made = [pa.array([r.get(f) for r in rows], arrow.field(f).type) for f in fields]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in keep), *made], schema=arrow)
                lo, rows, size = i + 1, [], 0


def _run(df: DataFrame, content: str, new: str, mode: str, one: Callable[[bytes], dict]) -> DataFrame:
    _check(mode)
    keep, schema = _kept(df, content, new)
    arrow = to_arrow_schema(schema)
    fields = [f.name for f in StructType.fromDDL(new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return results(batches, one, keep, fields, arrow, mode)

    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{content}`").cast("binary").alias("__content")).mapInArrow(run, schema)


def convert_documents(df: DataFrame, content: str = "content", page_breaks: bool = False, image_dir: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """Columns markdown, images and error beside those of ``df``, without ``content``.

    One narrow step: a document is decoded and formatted in one task and nothing
    is shuffled. Images are read only with ``image_dir``, to which the links
    point. An unreadable or null content gives a null Markdown and an error with
    code and message, or raises in mode FAILFAST. Columns of ``df`` named like
    one of the three are replaced; an empty table stays empty.
    """

    def one(raw: bytes) -> dict:
        markdown, files = convert(raw, page_breaks, image_dir)
        return {"markdown": markdown, "images": [{"filename": n, "bytes": b} for n, b in files]}

    return _run(df, content, schemas.RESULT, mode, one)


def span_row(s: Span) -> dict:
    return {
        "text": s.text, "x": s.x, "y": s.y, "width": s.width, "height": s.height, "font_size": s.size, "bold": s.bold, "italic": s.italic, "mono": s.mono,
        "kind": "image" if s.image else "text", "mcid": s.mcid, "space_before": bool(s.space),
    }


def decode_documents(df: DataFrame, content: str = "content", with_images: bool = False, mode: str = "PERMISSIVE") -> DataFrame:
    """Columns pages, roles, images and error beside those of ``df``; errors and clashes as in ``convert_documents``."""

    def one(raw: bytes) -> dict:
        found = extract(raw, with_images)
        return {
            "pages": [{"page_idx": i, "spans": [span_row(s) for s in spans], "rects": [dict(zip("xywh", r)) for r in rects]} for i, (spans, rects) in enumerate(found.pages)],
            "roles": [{"page_idx": p, "mcid": m, "kind": kind, "level": level} for (p, m), (kind, level) in found.roles.items()],
            "images": [{"filename": n, "bytes": b} for n, b in found.images],
        }

    return _run(df, content, schemas.LAYOUT, mode, one)


def spans(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each span: key, page_idx, seq (order of painting) and the fields of a span."""
    pages = decoded.select(key, F.explode("pages").alias("p")).select(key, "p.page_idx", F.posexplode("p.spans").alias("seq", "s"))
    return pages.select(key, "page_idx", "seq", "s.*")


def rects(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    pages = decoded.select(key, F.explode("pages").alias("p")).select(key, "p.page_idx", F.posexplode("p.rects").alias("seq", "r"))
    return pages.select(key, "page_idx", "seq", "r.*")


def roles(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    return decoded.select(key, F.explode("roles").alias("r")).select(key, "r.*")


def images(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    return decoded.select(key, F.posexplode("images").alias("n", "i")).select(key, (F.col("n") + 1).cast("int").alias("img_no"), "i.*")
