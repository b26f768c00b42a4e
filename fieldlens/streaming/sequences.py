"""Streaming variants: captures to sessions per location, and files to detections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session_counts(captures: DataFrame, gap_s: int, late: str = "10 minutes") -> DataFrame:
    """location, start, end, n of sessions of a capture stream: a gap of more than gap_s ends one; rows later than the watermark are out.

    captures: location, captured_at (timestamp). Session state is one interval per
    open session, and closes with the watermark.
    """
    s = F.session_window("captured_at", f"{gap_s} seconds")
    counts = captures.withWatermark("captured_at", late).groupBy("location", s.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("location", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def category_counts(captures: DataFrame, window: str, late: str = "10 minutes") -> DataFrame:
    """Tumbling counts by category."""
    w = F.window("captured_at", window)
    return captures.withWatermark("captured_at", late).groupBy(w.alias("w"), "category").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "category", "n")


def detector_rows(files: DataFrame, detect: Callable[[bytes], list[dict]], batch: int = 8) -> DataFrame:
    """file, failure, detections: a plug-in model over file contents. A failure of one file is data, not an error.

    files: path, content; a batch table or a file stream (with maxFilesPerTrigger).
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, content in zip(p["path"], p["content"], strict=True):
                try:
                    rows.append((path, None, detect(content)))
                except Exception as e:  # the model's own error, kept with its file
                    rows.append((path, f"inference failed: {type(e).__name__}", None))
            yield pd.DataFrame(rows, columns=["file", "failure", "detections"])

    return files.select("path", "content").mapInPandas(run, "file string, failure string, detections array<struct<category:string,conf:double,bbox:array<double>>>")


def file_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """path, content of the files that come into a folder."""
    return spark.readStream.format("binaryFile").option("maxFilesPerTrigger", per_trigger).schema("path string, modificationTime timestamp, length long, content binary").load(folder)


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Exactly-once Parquet sink; a restart goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
