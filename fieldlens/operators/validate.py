"""Validators: each gives a table of violations, so a clean input gives no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _issues(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _rule(rows: DataFrame, name: str, key: str, broken) -> DataFrame:
    return rows.filter(F.coalesce(broken, F.lit(False))).select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"))


def results(images: DataFrame, detections: DataFrame, categories: dict[str, str], key: str = "image_id") -> DataFrame:
    """rule, key of violations in a result set. images: key, failure, no_result; detections: key, category, conf, x, y, w, h."""
    known = F.col("category").cast("string").isin(list(categories))
    return _issues(
        _rule(images.groupBy(key).count(), "repeated_image", key, F.col("count") > 1),
        _rule(images, "failure_with_detections", key, F.col("failure").isNotNull() & ~F.col("no_result")),
        _rule(images, "missing_detections", key, F.col("failure").isNull() & F.col("no_result")),
        _rule(detections, "unknown_category", key, ~known),
        _rule(detections, "confidence_range", key, ~F.col("conf").between(-1, 1)),
        _rule(detections, "box_range", key, (F.col("w") < 0) | (F.col("h") < 0)),
    )


def versioned(documents: DataFrame) -> DataFrame:
    """rule, key for documents (key, version, is_video, images with frame_rate etc.): what each format version asks for."""
    v = F.col("version").try_cast("double")
    return _issues(
        _rule(documents, "version", "key", v.isNull() | (v < 1.3)),
        _rule(documents, "video_frame_rate", "key", (v >= 1.4) & F.col("is_video") & F.col("frame_rate").isNull()),
        _rule(documents, "video_frames_processed", "key", (v >= 1.5) & F.col("is_video") & F.col("frames_processed").isNull()),
    )


def annotation_db(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """rule, key of violations of an annotation database: uniqueness, references, sizes, boxes."""
    w, h = F.col("width"), F.col("height")
    b = F.col("bbox")
    return _issues(
        _rule(images.groupBy("id").count(), "repeated_image_id", "id", F.col("count") > 1),
        _rule(images.groupBy("file_name").count(), "repeated_file", "file_name", F.col("count") > 1),
        _rule(annotations.groupBy("id").count(), "repeated_annotation_id", "id", F.col("count") > 1),
        _rule(categories.groupBy("name").count(), "repeated_category", "name", F.col("count") > 1),
        _rule(images, "half_a_size", "id", w.isNull() != h.isNull()),
        _rule(annotations.join(images.select(F.col("id").alias("image_id")), "image_id", "left_anti"), "no_image", "id", F.lit(True)),
        _rule(annotations.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_anti"), "no_category", "id", F.lit(True)),
        _rule(annotations, "box", "id", F.exists(b, lambda x: x < 0) | (b[2] <= 0) | (b[3] <= 0)),
    )


def db_summary(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row: images, annotations, unannotated, multi_annotated, locations, sequences."""
    per = annotations.groupBy("image_id").agg(F.count(F.lit(1)).alias("k"))
    j = images.join(per, "image_id", "left")
    return j.agg(
        F.count(F.lit(1)).alias("images"),
        F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("annotations"),
        F.count_if(F.col("k").isNull()).alias("unannotated"),
        F.count_if(F.col("k") > 1).alias("multi_annotated"),
        F.count_distinct("location").alias("locations"),
    )


def per_category(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """name, annotations, images of each category, unused ones too."""
    n = annotations.groupBy("category_id").agg(F.count(F.lit(1)).alias("annotations"), F.count_distinct("image_id").alias("images"))
    j = categories.join(n, categories["id"] == n["category_id"], "left")
    return j.select("name", F.coalesce("annotations", F.lit(0)).cast("long").alias("annotations"), F.coalesce("images", F.lit(0)).cast("long").alias("images"))


def label_lines(lines: DataFrame, classes: list[int]) -> DataFrame:
    """file, line_no, error of detector label lines (file, line_no, line): five numbers, a known class; # lines are skipped."""
    t = F.split(F.trim("line"), r"\s+")
    bad = (
        F.when(~F.size(t).isin(5, 6), "tokens")
        .when(t[0].try_cast("int").isNull() | ~F.coalesce(t[0].try_cast("int").isin(classes), F.lit(False)), "class")
        .when(F.exists(F.slice(t, 2, 4), lambda x: x.try_cast("double").isNull()), "number")
    )
    return lines.filter(~F.col("line").startswith("#") & (F.trim("line") != "")).select("file", "line_no", bad.alias("error")).filter("error is not null")


def unpaired(images: DataFrame, labels: DataFrame) -> DataFrame:
    """stem, side of images without label file and of label files without image."""
    from fieldlens.operators.combine import set_report

    return set_report(images, labels, "stem").filter("side <> 'both'")


def file_sets_equal(predictions: DataFrame, instances: DataFrame, key: str = "filepath") -> DataFrame:
    """One row: failures, missing, extra."""
    p = predictions.select(key, F.col("failures").isNotNull().alias("failed"))
    j = p.withColumn("_p", F.lit(1)).join(instances.select(key).distinct().withColumn("_i", F.lit(1)), key, "full")
    return j.agg(F.count_if(F.col("failed")).alias("failures"), F.count_if(F.col("_p").isNull()).alias("missing"), F.count_if(F.col("_i").isNull()).alias("extra"))


def disjoint_splits(splits: DataFrame) -> DataFrame:
    """Locations that are in more than one split. splits: split, dataset, location."""
    return splits.groupBy("dataset", "location").agg(F.array_sort(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)
