"""Pages of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parchmill.sources import pdf


def page_stream(spark: SparkSession, path: str, delay: str = "1 day", **opts) -> DataFrame:
    """path, page_no, text of each page; a file that is delivered again within the delay counts once."""
    files = pdf.stream_files(spark, path).withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["path"])
    return pdf.extract_pages(files.select("path", "content"), **opts)


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Works off what is there and stops; run again, it carries on where it stopped."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
