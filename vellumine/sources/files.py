"""Sources of documents: files, byte strings, standard input, URLs."""

from __future__ import annotations

import os
import re
import subprocess
import sys
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from typing import BinaryIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from vellumine import schemas
from vellumine.sources.storage import entries, files_below, is_folder, locate, read_whole, walk

PDF_GLOB = "*.[pP][dD][fF]"
USER_AGENT = "vellumine/0.1"
TIMEOUT = 120
#: Bytes of files or results that are held before they are passed on.
FLUSH = 4 << 20
#: Tasks that the data source makes at most, unless ``filesPerPartition`` says otherwise.
MOST_TASKS = 4096


def read_files(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, modificationTime, length, content) of files; the filters on time and length reach the listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def list_folder(spark: SparkSession, folder: str, ending: str, recursive: bool = False) -> DataFrame:
    """(path) of the files of a folder whose names end so in any case, dealt to tasks.

    The driver holds no list: one task lists the folder, and with ``recursive``
    many list the folders in it.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    # qualified as the JVM's sources do it
    root = ("file:" + locate(folder)[1] if locate(folder)[0].type_name == "local" else folder).rstrip("/")

    def batched(rows: Iterator[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, bool]] = []
        for row in rows:
            out.append(row)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.bool_()))], names=["path", "deep"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.bool_()))], names=["path", "deep"])

    def top(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched((f"{root}/{n}", deep) for n, deep in entries(root) if (recursive if deep else n.lower().endswith(ending)))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        yield from batched((p, False) for path, deep in rows for p in (walk(path) if deep else [path]) if p.lower().endswith(ending))

    found = spark.range(0, 1, 1, 1).mapInArrow(top, "path string, deep boolean")
    if recursive:
        found = found.repartition(parts).mapInArrow(below, "path string, deep boolean")
    return found.select("path").repartition(parts)


def read_listed(listed: DataFrame) -> DataFrame:
    """(path, modificationTime, length, content) of the files at ``path``, as ``read_files`` gives them, some megabytes at a time."""
    kinds = {"path": pa.string(), "modificationTime": pa.timestamp("us", tz="UTC"), "length": pa.int64(), "content": pa.binary()}

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=[*kinds])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                own, place = locate(path)
                data, time = read_whole(path), own.get_file_info(place).mtime
                rows.append((path, time or datetime.fromtimestamp(0, timezone.utc), len(data), data))
                size += len(data)
                if size >= FLUSH or len(rows) >= 1000:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    return listed.select("path").mapInArrow(load, "path string, modificationTime timestamp, length bigint, content binary")


def read_folder(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """The PDF files of a folder, with ``stem``, their names without the ending.

    A folder is listed and read by the executors; the JVM's source, which lists on
    the driver and makes a task for a few small files, reads what isn't a folder
    and what Arrow has no file system for.
    """
    plain = not re.search(r"[*?\[{]", path) and is_folder(path)
    found = read_listed(list_folder(spark, path, ".pdf", recursive)) if plain else read_files(spark, path, PDF_GLOB, recursive)
    return found.withColumn("stem", F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1))


def is_url(source: str) -> bool:
    return urlsplit(source).scheme in ("http", "https")


def fetch(url: str, command: str = "curl") -> bytes:
    """Bytes behind a URL by way of curl; anything but success is an error."""
    try:
        done = subprocess.run([command, "--fail", "--silent", "--show-error", "--location", "--max-time", str(TIMEOUT), "--user-agent", USER_AGENT, "--", url], capture_output=True)
    except OSError as e:
        raise OSError(f"{command} can't be run: {e}") from e
    if done.returncode:
        raise OSError(f"fetching {url} failed: {done.stderr.decode('utf-8', 'replace').strip() or done.returncode}")
    return done.stdout


def read_source(source: str, stdin: BinaryIO | None = None) -> bytes:
    """Bytes of a path, of a URL, or with ``-`` of standard input."""
    if source == "-":
        return (stdin or sys.stdin.buffer).read()
    if is_url(source):
        return fetch(source)
    with open(source, "rb") as f:
        return f.read()


def from_sources(spark: SparkSession, sources: Sequence[str | os.PathLike | bytes | bytearray | memoryview], workers: int | None = None) -> DataFrame:
    """(input_idx, path, content) of paths and byte strings; paths are read by the executors, ``workers`` tells how many tasks at most."""
    if workers is not None and workers < 1:
        raise ValueError("workers must be at least 1")
    rows = [(i, None, bytes(s)) if isinstance(s, (bytes, bytearray, memoryview)) else (i, os.fspath(s), None) for i, s in enumerate(sources)]
    df = spark.createDataFrame(rows, "input_idx bigint, path string, content binary")
    df = df.repartitionByRange(min(workers or len(rows) or 1, len(rows) or 1), "input_idx")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                path = own.column(1)[0].as_py()
                content = own.column(2) if path is None else pa.array([read_source(path)], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), content], names=["input_idx", "path", "content"])

    return df.mapInArrow(load, "input_idx bigint, path string, content binary")


class _Files(InputPartition):
    """Files, and folders that the task lists."""

    def __init__(self, paths: list[str], folders: list[str]) -> None:
        self.paths, self.folders = paths, folders


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], kinds: pa.Schema) -> None:
        self.kinds = kinds
        self.folder = options.get("path", "")
        self.breaks = options.get("pagebreaks", "false").lower() == "true"
        self.image_dir = options.get("imagedir")
        self.mode = options.get("mode", "PERMISSIVE").upper()
        self.size = int(options.get("filesperpartition", "0"))
        self.recursive = options.get("recursivefilelookup", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        found = files_below(self.folder, ".pdf")
        size = self.size or max(64, -(-len(found) // MOST_TASKS))
        out = [_Files(found[i : i + size], []) for i in range(0, len(found), size)]
        if self.recursive and is_folder(self.folder):
            deep = sorted(f"{self.folder.rstrip('/')}/{n}" for n, d in entries(self.folder) if d)
            step = -(-len(deep) // MOST_TASKS) or 1
            out += [_Files([], deep[i : i + step]) for i in range(0, len(deep), step)]
        return out or [_Files([], [])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        from vellumine.kernel.convert import convert
        from vellumine.kernel.objects import PdfError

        rows, size = [], 0
        below = (p for f in partition.folders for p in walk(f) if p.lower().endswith(".pdf"))
        for path in (p for own in (partition.paths, below) for p in own):
            data = read_whole(path)
            try:
                markdown, files = convert(data, self.breaks, self.image_dir)
                rows.append({"path": path, "markdown": markdown, "images": [{"filename": n, "bytes": b} for n, b in files]})
            except PdfError as e:
                if self.mode == "FAILFAST":
                    raise
                rows.append({"path": path, "error": {"code": e.code, "message": str(e)}})
            size += len(data)
            if size >= FLUSH or len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=self.kinds)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=self.kinds)


class PdfDataSource(DataSource):
    """``spark.read.format("pdf").load(folder)``: path, markdown, images, error. For folders by path or URI that every executor can read; options pageBreaks, imageDir, mode, filesPerPartition, recursiveFileLookup (a task for some of the folders in it)."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return f"path string, {schemas.RESULT}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()}, to_arrow_schema(schema))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfDataSource)
