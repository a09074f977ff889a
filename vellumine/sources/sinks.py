"""Sinks: a Markdown file for each document, image files, both written by the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.sources.storage import locate, make_folder, write_whole


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """Writes the files (name, data) and gives (name, path, size) once an action runs; a null name or null data has no file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, root = locate(folder)
        for batch in batches:
            out = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name is None or not data.is_valid:
                    continue
                raw = data.as_py()
                write_whole(own, f"{root.rstrip('/')}/{name}", raw)
                out.append((name, f"{folder.rstrip('/')}/{name}", len(raw)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))], names=["name", "path", "size"])

    return df.mapInArrow(run, "name string, path string, size bigint")


def write_markdown(results: DataFrame, folder: str, name: str = "stem") -> DataFrame:
    """``{name}.md`` in ``folder``, a path or URI that all executors share, for each row with Markdown; gives the list of files once an action runs."""
    make_folder(folder)
    return write_files(results.where("markdown IS NOT NULL").select(F.concat(F.col(name).cast("string"), F.lit(".md")).alias("name"), F.encode("markdown", "UTF-8").alias("data")), folder)


def write_images(results: DataFrame, folder: str, prefix: str | None = None) -> DataFrame:
    """The files of ``images``, in a folder of its own for each document with ``prefix``; the folder is made even without images."""
    make_folder(folder)
    name = F.col("i.filename") if prefix is None else F.concat_ws("/", F.col("__p").cast("string"), F.col("i.filename"))
    rows = results.select(*([F.col(prefix).alias("__p")] if prefix else []), F.explode("images").alias("i"))
    return write_files(rows.select(name.alias("name"), F.col("i.bytes").alias("data")), folder)
