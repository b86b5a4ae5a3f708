"""Files as they arrive: pages of spans in append mode. Nothing aggregates across files,
so there is neither state nor a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagesift import api
from pagesift.sources import pdf


def stream_pages(spark: SparkSession, path: str, glob: str = "*.pdf", files_per_trigger: int = 1000, mode: str = pdf.PERMISSIVE) -> DataFrame:
    """``doc_id, page_no, spans, error`` of files new under ``path``."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    files = reader.option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return pdf.pages(files, mode=mode)


def write_bodies(pages: DataFrame, fmt: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each page's rendering as Parquet; ``once`` ends when what is there is done."""
    writer = api.page_bodies(pages, fmt).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
