"""Conversions for callers: of bytes, of files, of many, of folders, and from SQL."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine import schemas
from vellumine.kernel.convert import convert as kernel_convert
from vellumine.kernel.extract import extract
from vellumine.kernel.objects import PdfError
from vellumine.operators.decode import convert_documents, span_row
from vellumine.sources import files, sinks


@dataclass(frozen=True)
class Image:
    filename: str
    data: bytes

    def __repr__(self) -> str:
        return f"Image({self.filename!r}, {len(self.data)} bytes)"


@dataclass(frozen=True)
class ConvertResult:
    markdown: str
    images: list[Image] = field(default_factory=list)

    def __repr__(self) -> str:
        return f"ConvertResult({len(self.markdown)} characters, {len(self.images)} images)"

    def write_images(self, folder: str | os.PathLike) -> list[Path]:
        """Writes the images and gives their paths; the folder is made in any case."""
        folder = Path(folder)
        folder.mkdir(parents=True, exist_ok=True)
        out = []
        for image in self.images:
            out.append(folder / image.filename)
            out[-1].write_bytes(image.data)
        return out


def _result(markdown: str, images) -> ConvertResult:
    return ConvertResult(markdown, [Image(n, bytes(b)) for n, b in images or ()])


def convert(data: bytes | bytearray | memoryview, *, page_breaks: bool = False, image_dir: str | None = None) -> ConvertResult:
    """One document here and now, without a job."""
    if not isinstance(data, (bytes, bytearray, memoryview)):
        raise TypeError("data must be bytes, bytearray or memoryview")
    return _result(*kernel_convert(bytes(data), page_breaks, image_dir))


def convert_file(path: str | os.PathLike, *, page_breaks: bool = False, image_dir: str | None = None) -> ConvertResult:
    return convert(Path(path).read_bytes(), page_breaks=page_breaks, image_dir=image_dir)


def convert_many(spark: SparkSession, sources: Sequence, *, page_breaks: bool = False, image_dir: str | None = None, workers: int | None = None) -> list[ConvertResult]:
    """Paths and byte strings, converted by the executors, results in order of ``sources``; the first failure is raised.

    The list of results is held by the driver, Markdown and images of all sources
    together; for more than it can hold use ``convert_files`` or ``convert_folder``.
    """
    if workers is not None and workers < 1:
        raise ValueError("workers must be at least 1")
    if not sources:
        return []
    done = convert_documents(files.from_sources(spark, sources, workers), page_breaks=page_breaks, image_dir=image_dir)
    rows = done.orderBy("input_idx").collect()
    for row in rows:
        if row.error is not None:
            raise PdfError(row.error.code, row.error.message.partition(": ")[2])
    return [_result(r.markdown, r.images) for r in rows]


def convert_files(spark: SparkSession, path: str | list[str], *, page_breaks: bool = False, image_dir: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """path, stem, markdown, images, error of files; see ``operators.decode.convert_documents``."""
    found = files.read_files(spark, path).withColumn("stem", F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1))
    return convert_documents(found.select("path", "stem", "content"), page_breaks=page_breaks, image_dir=image_dir, mode=mode)


def convert_folder(spark: SparkSession, folder: str, out: str, *, page_breaks: bool = False) -> dict[str, int]:
    """Every PDF file of ``folder`` to a Markdown file in ``out``, past failures; how many of each there were."""
    done = convert_documents(files.read_folder(spark, folder).select("path", "stem", "content"), page_breaks=page_breaks)
    # one pass: what was written and what failed come from the same rows
    held = done.persist()
    try:
        failed = held.where("error IS NOT NULL").count()
        written = sinks.write_markdown(held, out).count()
    finally:
        held.unpersist()
    return {"converted": written, "failed": failed}


def pdf_to_markdown(content: pd.Series) -> pd.DataFrame:
    """SQL function: struct(markdown, images, error) of a binary column."""
    rows = []
    for raw in content:
        try:
            if raw is None:
                raise PdfError("NOT_PDF")
            rows.append((kernel_convert(bytes(raw))[0], [], None))
        except PdfError as e:
            rows.append((None, [], {"code": e.code, "message": str(e)}))
    return pd.DataFrame(rows, columns=["markdown", "images", "error"])


class PdfSpans:
    """SQL table function: the spans of one document; none if it can't be read."""

    def eval(self, content: bytes):
        try:
            pages = extract(bytes(content or b"")).pages
        except PdfError:
            return
        for i, (spans, _) in enumerate(pages):
            for n, s in enumerate(spans):
                yield i, n, *span_row(s).values()


def register(spark: SparkSession) -> None:
    """``pdf_to_markdown(content)``, ``pdf_spans(content)`` and the data source ``pdf`` for a session."""
    spark.udf.register("pdf_to_markdown", F.pandas_udf(pdf_to_markdown, schemas.RESULT))
    spark.udtf.register("pdf_spans", F.udtf(PdfSpans, returnType=f"page_idx int, seq int, {schemas.SPAN}"))
    files.register(spark)
