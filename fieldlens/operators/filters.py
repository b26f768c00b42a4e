"""Filters over images with nested detections, and over annotation tables.

Row-local ones use higher-order functions, so nothing is exploded or shuffled.
Null detections (failed images) pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.model import max_conf


def _detections(keep) -> Column:
    return F.filter("detections", keep)


def by_confidence(images: DataFrame, threshold: float) -> DataFrame:
    """Detections of at least that confidence."""
    return images.withColumn("detections", _detections(lambda d: d["conf"] >= threshold))


def subset_max_conf(before: Column, after: Column) -> Column:
    """The greatest confidence after a filter; where none is left, the old one if that was 0 or less, else -1."""
    old = max_conf(before)
    return F.when(F.size(after) > 0, max_conf(after)).when(old <= 0, old).otherwise(-1.0)


def by_category_thresholds(images: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Detections of the listed categories above (not at) their thresholds."""
    limits = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])
    return images.withColumn("detections", _detections(lambda d: F.coalesce(d["conf"] > limits[d["category"]], F.lit(False))))


def by_size(images: DataFrame, least: float | None = None, most: float | None = None) -> DataFrame:
    """Detections whose relative area is in a closed range."""

    def keep(d: Column) -> Column:
        area = d["bbox"][2] * d["bbox"][3]
        return (F.lit(True) if least is None else area >= least) & (F.lit(True) if most is None else area <= most)

    return images.withColumn("detections", _detections(keep))


def by_files(images: DataFrame, files: DataFrame, key: str = "file") -> DataFrame:
    """Images that a list has; a semi-join, after slashes are made one way."""
    wanted = files.select(F.replace(F.col(key), F.lit("\\"), F.lit("/")).alias("_wanted")).distinct()
    return images.join(wanted, F.replace(F.col(key), F.lit("\\"), F.lit("/")) == F.col("_wanted"), "left_semi")


def without_failures(images: DataFrame) -> DataFrame:
    return images.filter("failure is null")


def by_query(images: DataFrame, query: str = "", replacement: str | None = None, prefix: bool = False) -> DataFrame:
    """Images whose name has a text (prefix: begins with it), which is then replaced."""
    f = F.col("file")
    out = images.filter(f.startswith(query) if prefix else f.contains(query)) if query else images
    if replacement is None:
        return out
    if not query:
        return out.withColumn("file", F.concat(F.lit(replacement), f))
    if prefix:
        return out.withColumn("file", F.concat(F.lit(replacement), F.substring(f, len(query) + 1, 1 << 20)))
    return out.withColumn("file", F.replace(f, F.lit(query), F.lit(replacement)))


def without_rare_classes(images: DataFrame, least: int) -> DataFrame:
    """Without the classes that fewer detections have, at any rank, over all images."""
    ids = images.select(F.explode(F.flatten(F.transform("detections", lambda d: F.coalesce(F.transform(d["classifications"], lambda c: c["id"]), F.array().cast("array<string>"))))).alias("id"))
    often = ids.groupBy("id").count().filter(F.col("count") >= least).agg(F.collect_set("id").alias("_often"))  # one row, of category ids
    kept = images.join(F.broadcast(often))
    out = kept.withColumn(
        "detections",
        F.transform("detections", lambda d: d.withField("classifications", F.filter(d["classifications"], lambda c: F.array_contains("_often", c["id"])))),
    )
    return out.drop("_often")


def subset(images: DataFrame, *, query: str = "", replacement: str | None = None, drop_failures: bool = False, confidence: float | None = None, categories: dict[str, float] | None = None, class_count: int | None = None, files: DataFrame | None = None, sizes: tuple[float | None, float | None] | None = None) -> DataFrame:
    """All subset filters, in an order that is part of the result: query, failures, confidence, categories, class counts, list, size."""
    out = by_query(images, query, replacement) if query or replacement is not None else images
    out = without_failures(out) if drop_failures else out
    out = out if confidence is None else by_confidence(out, confidence)
    out = out if categories is None else by_category_thresholds(out, categories)
    out = out if class_count is None else without_rare_classes(out, class_count)
    out = out if files is None else by_files(out, files)
    return out if sizes is None else by_size(out, *sizes)


def split_by_folder(images: DataFrame, levels: int = 1) -> DataFrame:
    """images with the folder that a split writes them to; write.partitionBy("folder") makes the split."""
    parts = F.split("file", "/")
    return images.withColumn("folder", F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(levels), F.size(parts) - 1)), "/"))


def any_above(images: DataFrame, threshold: float, categories: list[str] | None = None) -> DataFrame:
    """Images with detections, whose greatest confidence over the categories (0 at least) reaches the threshold."""
    chosen = F.filter("detections", lambda d: d["category"].isin(categories) if categories else F.lit(True))
    return images.filter((F.size("detections") > 0) & (F.greatest(max_conf(chosen), F.lit(0.0)) >= threshold))


def threshold_for(category: Column, thresholds: float | dict[str, float]) -> Column:
    """A category's threshold, from one number or a map with a default."""
    if not isinstance(thresholds, dict):
        return F.lit(float(thresholds))
    limits = F.create_map(*[F.lit(x) for k, v in thresholds.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(limits, category), F.lit(float(thresholds["default"])) if "default" in thresholds else F.lit(None).cast("double"))


def positive(detections: Column, thresholds: float | dict[str, float]) -> Column:
    """Detections at or above their category's threshold."""
    return F.filter(detections, lambda d: d["conf"] >= threshold_for(d["category"], thresholds))


def positive_categories(detections: Column, thresholds: float | dict[str, float]) -> Column:
    """Their distinct categories, sorted."""
    return F.array_sort(F.array_distinct(F.transform(positive(detections, thresholds), lambda d: d["category"])))


def has_positive(detections: Column, thresholds: float | dict[str, float]) -> Column:
    return F.coalesce(F.exists(detections, lambda d: d["conf"] >= threshold_for(d["category"], thresholds)), F.lit(False))


def annotations_by_score(annotations: DataFrame, threshold: float, field: str = "score", missing: str = "error") -> DataFrame:
    """Annotations whose score reaches the threshold. missing: error, or drop."""
    score = F.col(field)
    if missing == "error":
        score = F.coalesce(score, F.raise_error(F.lit(f"annotation without {field}")).cast("double"))
    return annotations.filter(score >= threshold)


def labels_and_datasets(rows: DataFrame, label: str, datasets: list[str] | None = None) -> DataFrame:
    out = rows.filter(F.array_contains("labels", label))
    return out.filter(F.col("dataset").isin(datasets)) if datasets else out


def enough_locations(rows: DataFrame, least: int, label: str = "label") -> DataFrame:
    """Rows whose label occurs at that many distinct locations."""
    kept = rows.groupBy(label).agg(F.count_distinct("dataset", "location").alias("_n")).filter(F.col("_n") >= least).select(label)
    return rows.join(kept, label, "left_semi")


def existing(rows: DataFrame, listing: DataFrame, key: str = "file") -> DataFrame:
    return rows.join(listing.select(key).distinct(), key, "left_semi")


def missing(rows: DataFrame, listing: DataFrame, key: str = "file") -> DataFrame:
    return rows.join(listing.select(key).distinct(), key, "left_anti")


def mislabelled(wide: DataFrame, classes: list[str], label: str, margin: float) -> DataFrame:
    """Rows of class probabilities whose best class beats the labelled one by a margin."""
    top = F.array_max(F.array(*[F.struct(F.col(c).alias("p"), F.lit(c).alias("name")) for c in classes]))
    own = F.try_element_at(F.create_map(*[x for c in classes for x in (F.lit(c), F.col(c))]), F.col(label))
    return wide.withColumn("pred", top["name"]).withColumn("pred_conf", top["p"]).withColumn("label_conf", own).filter(F.col("pred_conf") >= F.col("label_conf") + margin)


def with_boxes(images: DataFrame, annotations: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, several: bool = False) -> DataFrame:
    """Images by their annotations: with a box, of some classes, without others, or of more than one class. annotations: image_id, name, bbox."""
    per = annotations.groupBy("image_id").agg(F.max(F.col("bbox").isNotNull()).alias("boxed"), F.collect_set("name").alias("names")).filter("boxed")
    if include:
        per = per.filter(F.arrays_overlap("names", F.array(*map(F.lit, include))))
    if exclude:
        per = per.filter(~F.arrays_overlap("names", F.array(*map(F.lit, exclude))))
    if several:
        per = per.filter(F.size("names") > 1)
    return images.join(per.select("image_id"), "image_id", "left_semi")


def urls_of_species(rows: DataFrame, species: list[str], name: str = "common_name", url: str = "url") -> DataFrame:
    """The urls by dataset of rows whose name has one of the species."""
    hit = F.exists(F.array(*map(F.lit, species)), lambda s: F.lower(F.col(name)).contains(s))
    return rows.filter((F.trim(name) != "") & hit).select("dataset", F.col(url).alias("url"))
