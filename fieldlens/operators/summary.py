"""Composed operators: results with truth to all figures of a report, and videos to results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.operators import compare, sequences
from fieldlens.streaming.sequences import detector_rows


def batch_report(images: DataFrame, detections: DataFrame, truth: DataFrame, conf: float = 0.2, almost: float = 0.1) -> dict[str, DataFrame]:
    """Tables of a report on results against image labels.

    images: image_id, failure. detections: image_id, category, conf. truth:
    image_id, positive (null: unknown, which doesn't count). Failed images and
    those without truth are left out of all figures but counts.

    counts: one row of images, failed, positive, almost (detections below conf
    but not below almost). scores: image_id, score, positive. curve: threshold,
    tp, n, precision, recall. confusion: one row at conf (strictly above).
    groups: images by their set of categories.
    """
    top = detections.groupBy("image_id").agg(F.max("conf").alias("score"))
    every = images.join(top, "image_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    counts = every.agg(
        F.count(F.lit(1)).alias("images"), F.count("failure").alias("failed"), F.count_if(F.col("failure").isNull() & (F.col("score") >= conf)).alias("positive"),
        F.count_if(F.col("failure").isNull() & (F.col("score") < conf) & (F.col("score") >= almost)).alias("almost"),
    )
    scores = every.filter("failure is null").join(truth.filter("positive is not null"), "image_id").select("image_id", "score", "positive")
    by_score = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.count_if("positive").alias("tp"))
    from fieldlens.operators.running import running

    total = scores.agg(F.count_if("positive").alias("_p"))
    summed = running(by_score.withColumnsRenamed({"n": "_n", "tp": "_tp"}), "score", {"tp": "_tp", "n": "_n"}, falling=True)
    curve = summed.join(F.broadcast(total)).select(F.col("score").alias("threshold"), "tp", "n", (F.col("tp") / F.col("n")).alias("precision"), (F.col("tp") / F.col("_p")).alias("recall"))
    above = F.col("score") > conf
    confusion = scores.agg(F.count_if(above & F.col("positive")).alias("tp"), F.count_if(above & ~F.col("positive")).alias("fp"), F.count_if(~above & F.col("positive")).alias("fn"), F.count_if(~above & ~F.col("positive")).alias("tn"))
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    confusion = confusion.withColumns({"precision": precision, "recall": recall, "f1": F.try_divide(2 * precision * recall, precision + recall)})
    return {"counts": counts, "scores": scores, "curve": curve, "confusion": confusion, "groups": compare.combination_groups(detections, conf)}


def video_results(frames: DataFrame, detect: Callable[[bytes], list[dict]], nth: int | None = 1) -> DataFrame:
    """Videos' detections from decoded frames (video_id, frame_number, content) and a plug-in model: per video and category the nth most confident."""
    key = F.concat_ws("/", F.col("video_id").cast("string"), F.col("frame_number").cast("string"))
    found = detector_rows(frames.select(key.alias("path"), "content"), detect)
    rows = found.select(F.substring_index("file", "/", 1).alias("video_id"), F.substring_index("file", "/", -1).cast("int").alias("frame_number"), F.explode("detections").alias("d"))
    return sequences.video_detections(rows.select("video_id", "frame_number", "d.category", "d.conf", "d.bbox"), nth)


def result_links(folders: DataFrame, files: DataFrame) -> DataFrame:
    """folder, n, link: results files by the dataset folder that they are in; of several the last by name, none is null. folders: folder; files: file."""
    inside = files.filter(F.lower("file").endswith(".json")).select(F.regexp_extract("file", r"^([^/]*)/", 1).alias("folder"), "file")
    last = inside.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.max("file").alias("link"))
    return folders.select("folder").join(last, "folder", "left").select("folder", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "link")
