"""Comparisons of two result sets, and the per-image report."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.operators.overlap import best_match, unmatched


def shown_sets(images: DataFrame, detections: DataFrame, threshold: float) -> DataFrame:
    """image_id, cats (sorted categories at or above the threshold), top (greatest confidence, 0 without any)."""
    d = detections.groupBy("image_id").agg(F.array_sort(F.collect_set(F.when(F.col("conf") >= threshold, F.col("category")))).alias("cats"), F.max("conf").alias("top"))
    return images.filter("failure is null").select("image_id").join(d, "image_id", "left").select("image_id", F.coalesce("cats", F.array().cast(d.schema["cats"].dataType)).alias("cats"), F.coalesce("top", F.lit(0.0)).alias("top"))


def compare_sets(a: DataFrame, b: DataFrame, agnostic: bool = False) -> DataFrame:
    """image_id, outcome, sort_conf for two tables as from shown_sets; images that failed in either are out."""
    rows = a.select("image_id", F.col("cats").alias("ca"), F.col("top").alias("ta")).join(b.select("image_id", F.col("cats").alias("cb"), F.col("top").alias("tb")), "image_id")
    in_a, in_b = F.size("ca") > 0, F.size("cb") > 0
    same = F.lit(True) if agnostic else F.col("ca") == F.col("cb")
    outcome = F.when(in_a & in_b, F.when(same, "common_detections").otherwise("class_transitions")).when(in_a, "detections_a_only").when(in_b, "detections_b_only").otherwise("common_non_detections")
    conf = F.when(in_a & ~in_b, F.col("ta")).when(in_b & ~in_a, F.col("tb")).otherwise(F.greatest("ta", "tb"))
    return rows.select("image_id", outcome.alias("outcome"), conf.alias("sort_conf"))


def by_truth(types_a: Column, types_b: Column) -> Column:
    """Outcome of an image from the result types (tp, fp, fn, tn) that two models have on it."""

    def good(t: Column) -> Column:
        return ~F.array_contains(t, "fp") & ~F.array_contains(t, "fn")

    return (
        F.when(good(types_a) & good(types_b), F.when(F.array_contains(types_a, "tp"), "common_tp").otherwise("common_tn"))
        .when(good(types_a), F.when(F.array_contains(types_b, "fn"), "fn_b_only").otherwise("fp_b_only"))
        .when(good(types_b), F.when(F.array_contains(types_a, "fn"), "fn_a_only").otherwise("fp_a_only"))
        .when(F.array_contains(types_a, "fn") & F.array_contains(types_b, "fn"), "common_fn")
        .when(F.array_contains(types_a, "fp") & F.array_contains(types_b, "fp"), "common_fp")
        .otherwise("mixed_errors")
    )


def by_label_sets(found: Column, truth: Column) -> Column:
    """Result types of category-name sets: right, too many, missing."""
    return F.array_compact(
        F.array(
            F.when(F.size(F.array_intersect(found, truth)) > 0, "tp"),
            F.when(F.size(F.array_except(found, truth)) > 0, "fp"),
            F.when(F.size(F.array_except(truth, found)) > 0, "fn"),
            F.when((F.size(found) == 0) & (F.size(truth) == 0), "tn"),
        )
    )


def confidence_pairs(a: DataFrame, b: DataFrame, conf: float, least_iou: float) -> DataFrame:
    """Each detection of a with its best match in b: image_id, category, conf_a, conf_b, iou."""
    m = best_match(a.filter(F.col("conf") >= conf), b.filter(F.col("conf") >= conf), ["image_id", "category"], least_iou, ["image_id", "det_ord"])
    return m.select(F.col("a_image_id").alias("image_id"), F.col("a_det_ord").alias("det_ord"), F.col("a_category").alias("category"), F.col("a_conf").alias("conf_a"), F.col("b_conf").alias("conf_b"), "iou")


def largest_errors(a: DataFrame, b: DataFrame, least_iou: float = 0.85) -> DataFrame:
    """One row: conf_error and coord_error between two detection tables, both ways; what has no match counts with its confidence."""
    parts = []
    for x, y in ((a, b), (b, a)):
        m = best_match(x, y, ["image_id", "category"], least_iou, ["image_id", "det_ord"])
        coord = F.greatest(*[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in "xywh"])
        parts.append(m.select(F.abs(F.col("a_conf") - F.col("b_conf")).alias("c"), coord.alias("p")))
        parts.append(unmatched(x, y, ["image_id", "category"], least_iou).select(F.col("conf").alias("c"), F.lit(0.0).alias("p")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.agg(F.coalesce(F.max("c"), F.lit(0.0)).alias("conf_error"), F.coalesce(F.max("p"), F.lit(0.0)).alias("coord_error"))


def n_way(sets: list[DataFrame], images: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """All pairs of result sets: a, b, outcome, n."""
    limits = thresholds or [0.15] * len(sets)
    shown = [shown_sets(images, s, t) for s, t in zip(sets, limits, strict=True)]
    out = None
    for i, j in combinations(range(len(sets)), 2):
        part = compare_sets(shown[i], shown[j]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("a"), F.lit(j).alias("b"), "outcome", "n")
        out = part if out is None else out.unionByName(part)
    return out


def report(images: DataFrame, detections: DataFrame, conf: float = 0.2, class_conf: float = 0.5) -> DataFrame:
    """image_id, category, class, n, max_conf, max_class_conf: one row per category and top class of an image, and rows for errors and empty images.

    detections: image_id, category, conf, class, class_conf (of the top class).
    """
    d = detections.filter(F.col("conf") >= conf)
    cls = F.when(F.col("class_conf") >= class_conf, F.col("class")).otherwise("")
    groups = d.groupBy("image_id", F.col("category").cast("string").alias("category"), cls.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.max("conf").alias("max_conf"), F.max(F.when(F.col("class_conf") >= class_conf, F.col("class_conf"))).alias("max_class_conf"))
    without = images.join(d.select("image_id").distinct(), "image_id", "left_anti")
    rest = without.select("image_id", F.when(F.col("failure").isNull(), "empty").otherwise("error").alias("category"), F.lit("").alias("class"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("max_conf"), F.lit(None).cast("double").alias("max_class_conf"))
    return groups.unionByName(rest)


def combination_groups(detections: DataFrame, threshold: float) -> DataFrame:
    """cats, n: images by the sorted set of their categories at or above the threshold."""
    per = detections.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("conf") >= threshold, F.col("category").cast("string")))), "_").alias("cats"))
    return per.groupBy("cats").agg(F.count(F.lit(1)).alias("n"))


def routing(images: DataFrame, detections: DataFrame, thresholds: dict[str, float], names: dict[str, str]) -> DataFrame:
    """image_id, folder: names of the categories over their thresholds joined by _, or empty, or failure."""
    from fieldlens.operators.categories import lookup
    from fieldlens.operators.filters import threshold_for

    c = F.col("category").cast("string")
    hit = detections.filter(F.col("conf") >= threshold_for(c, thresholds)).groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_set(lookup(names)[c])), "_").alias("f"))
    return images.join(hit, "image_id", "left").select("image_id", F.when(F.col("failure").isNotNull(), "failure").otherwise(F.coalesce("f", F.lit("empty"))).alias("folder"))
