"""Crops, tiles and video frames: rows that are made from images, and their results' way back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import paths
from fieldlens.functions.geometry import tiles


def crop_table(images: DataFrame, conf: float, categories: list[str] | None = None) -> DataFrame:
    """file, crop_id (place of the detection), crop_file, category, conf, bbox of detections to crop."""
    rows = images.select("file", F.posexplode("detections").alias("crop_id", "d")).filter(F.col("d.conf") >= conf)
    if categories:
        rows = rows.filter(F.col("d.category").isin(categories))
    return rows.select("file", "crop_id", paths.crop_name(F.col("file"), F.col("crop_id")).alias("crop_file"), "d.category", "d.conf", "d.bbox")


def classes_to_detections(detections: DataFrame, crops: DataFrame, results: DataFrame, top: int | None = None) -> DataFrame:
    """detections (file, det_ord, ...) with classifications of their crops' results (crop_file, classifications)."""
    by_crop = crops.select("file", F.col("crop_id").cast("long").alias("det_ord"), "crop_file").join(results, "crop_file")
    lists = F.col("classifications") if top is None else F.slice("classifications", 1, top)
    return detections.drop("classifications").join(by_crop.select("file", "det_ord", lists.alias("classifications")), ["file", "det_ord"], "left")


def tile_table(images: DataFrame, tile: int, stride: int | None = None) -> DataFrame:
    """image_id, tile_x, tile_y of the tiles that cover each image (image_id, width, height)."""
    return images.select("image_id", F.explode(tiles(F.col("width"), F.col("height"), tile, tile, stride, stride)).alias("t")).select("image_id", F.col("t.x").alias("tile_x"), F.col("t.y").alias("tile_y"))


def tiles_to_images(found: DataFrame, images: DataFrame, tile: int) -> DataFrame:
    """Detections of tiles (image_id, tile_x, tile_y, conf, x, y, w, h relative to the tile) in their image's coordinates."""
    j = found.join(images.select("image_id", "width", "height"), "image_id")
    wide, high = F.least(F.lit(tile), F.col("width")), F.least(F.lit(tile), F.col("height"))
    return j.select(
        "image_id", "category", "conf",
        ((F.col("tile_x") + F.col("x") * wide) / F.col("width")).alias("x"), ((F.col("tile_y") + F.col("y") * high) / F.col("height")).alias("y"),
        (F.col("w") * wide / F.col("width")).alias("w"), (F.col("h") * high / F.col("height")).alias("h"),
    )


def sampled_frames(frames: DataFrame, every: float, rate: str = "frame_rate") -> DataFrame:
    """Every n-th frame; a negative number is a time in seconds."""
    step = F.lit(int(every)) if every > 0 else F.greatest(F.lit(1), F.round(-every * F.col(rate)).cast("int"))
    return frames.filter(F.col("frame_number") % step == 0)


def resized(annotations: DataFrame, images: DataFrame, sizes: DataFrame) -> DataFrame:
    """Annotations (bbox in pixels) of images whose size changes. images, sizes: image_id, width, height."""
    from fieldlens.functions.geometry import rescale

    j = annotations.join(images.select("image_id", "width", "height"), "image_id").join(sizes.select("image_id", F.col("width").alias("w1"), F.col("height").alias("h1")), "image_id")
    return j.withColumn("bbox", rescale(F.col("bbox"), F.col("w1") / F.col("width"), F.col("h1") / F.col("height"))).drop("width", "height", "w1", "h1")


def with_sizes(images: DataFrame, sizes: DataFrame) -> DataFrame:
    """Widths and heights from a size table where they are missing or not positive."""
    j = images.join(sizes.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "image_id", "left")
    lacks = (F.coalesce("width", F.lit(0)) <= 0) | (F.coalesce("height", F.lit(0)) <= 0)
    return j.withColumn("width", F.when(lacks, F.col("_w")).otherwise(F.col("width"))).withColumn("height", F.when(lacks, F.col("_h")).otherwise(F.col("height"))).drop("_w", "_h")


def class_lists(wide: DataFrame, classes: list[str], keep: list[str], threshold: float, top: int | None = None) -> DataFrame:
    """keep columns with classifications: (id, conf) of the class columns at or above a threshold, in falling confidence."""
    pairs = F.array(*[F.struct((-F.col(c)).alias("k"), F.lit(str(i)).alias("id"), F.col(c).alias("conf")) for i, c in enumerate(classes)])
    ok = F.transform(F.array_sort(F.filter(pairs, lambda p: p["conf"] >= threshold)), lambda p: F.struct(p["id"].alias("id"), p["conf"].alias("conf")))
    return wide.select(*keep, (ok if top is None else F.slice(ok, 1, top)).alias("classifications"))
