"""Files are converted as they arrive; the converter keeps no state between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vellumine.operators.decode import convert_documents
from vellumine.sources.files import PDF_GLOB

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def stream_folder(spark: SparkSession, folder: str, page_breaks: bool = False, image_dir: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """A streaming DataFrame of path, modificationTime, length, markdown, images, error."""
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", PDF_GLOB).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return convert_documents(raw, page_breaks=page_breaks, image_dir=image_dir)


def write_stream(results: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends results as Parquet, each file once, from where ``checkpoint`` stands."""
    writer = results.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start(out)
