"""Metrics against truth: status, precision and recall, confusion, calibration, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.operators.running import running

#: Names that mean nothing was there, and that nothing is known.
NEGATIVE = ("empty",)
UNKNOWN = ("unknown", "unlabeled", "ambiguous")


def image_status(labels: DataFrame, images: DataFrame, negative: tuple[str, ...] = NEGATIVE, unknown: tuple[str, ...] = UNKNOWN) -> DataFrame:
    """image_id, status (negative, positive, unknown, ambiguous), only (the one category, if it is one). labels: image_id, name."""
    sets = images.select("image_id").join(labels.groupBy("image_id").agg(F.collect_set("name").alias("names")), "image_id", "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    neg, unk = F.arrays_overlap(names, F.array(*map(F.lit, negative))), F.arrays_overlap(names, F.array(*map(F.lit, unknown)))
    pos = F.size(F.array_except(names, F.array(*map(F.lit, negative + unknown)))) > 0
    kinds = neg.cast("int") + unk.cast("int") + pos.cast("int")
    status = F.when(kinds > 1, "ambiguous").when(neg, "negative").when(pos, "positive").otherwise("unknown")
    return sets.select("image_id", status.alias("status"), F.when(F.size(names) == 1, names[0]).alias("only"))


def pr_points(scored: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """score, tp, n, precision, recall: one row per distinct score, for the threshold at it.

    The running sums go over distinct scores, after aggregation.
    """
    per = scored.groupBy(score).agg(F.sum(truth).cast("long").alias("p"), F.count(F.lit(1)).alias("k"))
    out = running(per.withColumnRenamed(score, "score"), "score", {"tp": "p", "n": "k"}, falling=True).select("score", "tp", "n")
    total = per.agg(F.sum("p").alias("total"))
    return out.join(F.broadcast(total)).select("score", "tp", "n", (F.col("tp") / F.col("n")).alias("precision"), (F.col("tp") / F.col("total")).alias("recall"))


def running_steps(points: DataFrame) -> DataFrame:
    """points with step, the positives at each score: the difference of tp to the next higher score, by a lag within buckets of scores.

    The first score of a bucket takes its predecessor from the buckets' last rows, which are a few.
    """
    b = F.floor(F.col("score") * 64)
    rows = points.withColumn("_b", b)
    inner = Window.partitionBy("_b").orderBy(F.col("score").desc())
    ends = rows.groupBy("_b").agg(F.max("tp").alias("_e"))
    outer = Window.orderBy(F.col("_b").desc())
    before = ends.select("_b", F.coalesce(F.lag("_e").over(outer), F.lit(0)).alias("_p"))
    return rows.join(F.broadcast(before), "_b").withColumn("step", F.col("tp") - F.coalesce(F.lag("tp").over(inner), F.col("_p"))).drop("_b", "_p")


def average_precision(points: DataFrame) -> DataFrame:
    """One row: ap, the sum of precision times the recall gained."""
    # the recall gained at a score is its own positives' share: running sums of sums need no order here
    total = points.agg(F.max("tp").alias("total"))
    own = running_steps(points)
    return own.join(F.broadcast(total)).agg(F.sum(F.col("step") / F.col("total") * F.col("precision")).alias("ap"))


def precision_at(points: DataFrame, recall: float) -> DataFrame:
    """One row: the precision at the highest threshold that reaches a recall (else 0), and that threshold."""
    top = points.filter(F.col("recall") >= recall).agg(F.max(F.struct("score", "precision")).alias("b"))
    return top.select(F.coalesce("b.precision", F.lit(0.0)).alias("precision"), F.col("b.score").alias("threshold"))


def counts_at(scored: DataFrame, threshold: float, score: str = "score", truth: str = "truth") -> DataFrame:
    """One row: tp, fp, fn, tn at scores above (not at) the threshold, precision, recall, f1."""
    p, t = F.col(score) > threshold, F.col(truth) == 1
    row = scored.agg(*[F.count_if(c).alias(n) for n, c in (("tp", p & t), ("fp", p & ~t), ("fn", ~p & t), ("tn", ~p & ~t))])
    row = row.withColumn("precision", F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))).withColumn("recall", F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")))
    return row.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(pairs: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """truth, pred, n, share of the truth's row."""
    n = pairs.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / (F.sum("n").over(Window.partitionBy(truth)) + 1e-7))


def label_stats(matrix: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """label, precision, recall from a confusion table; recall null without truth, precision with 1e-8 against division by zero."""
    t = matrix.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("rows"), F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)).alias("hit"))
    p = matrix.groupBy(F.col(pred).alias("label")).agg(F.sum("n").alias("cols"))
    both = t.join(p, "label", "full")
    hit = F.coalesce("hit", F.lit(0))
    return both.select("label", (hit / (F.coalesce("cols", F.lit(0)) + 1e-8)).alias("precision"), F.when(F.col("rows").isNotNull(), hit / F.col("rows")).alias("recall"))


def calibration_error(scored: DataFrame, bins: int = 10, score: str = "score", truth: str = "truth") -> DataFrame:
    """One row: the expected calibration error over equal-width bins."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    per = scored.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.avg(F.col(truth).cast("double")).alias("acc"), F.avg(score).alias("mean"))
    return per.agg((F.sum(F.col("k") * F.abs(F.col("acc") - F.col("mean"))) / F.sum("k")).alias("ece"))


def equivalent_threshold(a: DataFrame, b: DataFrame, threshold: float = 0.2, conf: str = "conf") -> DataFrame:
    """One row, threshold: of b's confidences the one that leaves the share that `threshold` leaves of a's.

    An exact order statistic: counts by distinct confidence, then running sums over these.
    """
    share = a.agg((F.count_if(F.col(conf) >= threshold) / F.count(F.lit(1))).alias("share"), F.count_if(F.col(conf) >= threshold).alias("na"))
    per = b.groupBy(F.col(conf).alias("c")).agg(F.count(F.lit(1)).alias("k"))
    total = b.agg(F.count(F.lit(1)).alias("nb"), F.count_if(F.col(conf) >= threshold).alias("nb_t"))
    ranks = running(per, "c", {"upto": "k"})
    # rank (from 0) of the wanted one: nb - round(nb * share)
    need = ranks.join(F.broadcast(share.join(total))).withColumn("rank", F.col("nb") - F.bround(F.col("nb") * F.col("share"), 0).cast("long"))
    found = need.filter(F.col("upto") > F.col("rank")).agg(F.min("c").alias("t"), F.first("na").alias("na"), F.first("nb_t").alias("nb_t"))
    return found.select(F.when(F.col("na") == F.col("nb_t"), F.lit(threshold)).otherwise(F.col("t")).alias("threshold"))


def detection_outcomes(detections: DataFrame, truth: DataFrame, threshold: float, least_iou: float = 0.5) -> DataFrame:
    """image_id, outcome (tp, fp, fn) for detections above the threshold and truth boxes: equal category and enough overlap match."""
    from fieldlens.operators.overlap import unmatched

    shown = detections.filter(F.col("conf") > threshold).select("image_id", "category", "x", "y", "w", "h").withColumn("_i", F.monotonically_increasing_id())
    wrong = unmatched(shown.drop("_i"), truth, ["image_id", "category"], least_iou).select("image_id", F.lit("fp").alias("outcome"))
    missed = unmatched(truth, shown.drop("_i"), ["image_id", "category"], least_iou).select("image_id", F.lit("fn").alias("outcome"))
    n = shown.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).join(wrong.groupBy("image_id").agg(F.count(F.lit(1)).alias("f")), "image_id", "left")
    right = n.select("image_id", F.explode(F.array_repeat(F.lit("tp"), (F.col("n") - F.coalesce("f", F.lit(0))).cast("int"))).alias("outcome"))
    return right.unionByName(wrong).unionByName(missed)


def top_category(detections: DataFrame, threshold: float, empty: str = "empty") -> Column:
    """Category of the greatest confidence above the threshold in an array; of equal ones the first."""
    best = F.array_max(F.transform(F.filter(detections, lambda d: d["conf"] > threshold), lambda d, i: F.struct(d["conf"].alias("conf"), (-i).alias("i"), d["category"].cast("string").alias("c"))))
    return F.coalesce(best["c"], F.lit(empty))


def multilabel_scores(truth: DataFrame, pred: DataFrame, key: str = "image_id") -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1. Both: key, label (distinct)."""
    t, p = truth.select(key, "label").distinct().withColumn("_t", F.lit(1)), pred.select(key, "label").distinct().withColumn("_p", F.lit(1))
    both = t.join(p, [key, "label"], "full").groupBy("label")
    n = both.agg(F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    n = n.withColumn("precision", F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))).withColumn("recall", F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")))
    return n.withColumn("f1", F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")))


def multilabel_confusion(sets: DataFrame) -> DataFrame:
    """truth, pred, n over pairs of an entity's labels, without pairs of two labels that are both right. sets: truth, pred (arrays)."""
    rows = sets.select("truth", "pred", F.explode("truth").alias("t")).select("truth", "pred", "t", F.explode("pred").alias("p"))
    mutual = F.array_contains("truth", F.col("p")) & F.array_contains("pred", F.col("t")) & (F.col("t") != F.col("p"))
    return rows.filter(~mutual).groupBy(F.col("t").alias("truth"), F.col("p").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def collapsed(categories: Column, generic: tuple[str, ...] = ("animal", "mammal", "bird"), unknown: tuple[str, ...] = ("unknown",)) -> Column:
    """A sequence's category set without empty, unknown and generic ones where a more specific one is there."""
    out = categories
    for group in (("empty",), unknown, generic):
        rest = F.array_except(out, F.array(*map(F.lit, group)))
        out = F.when(F.size(rest) > 0, rest).otherwise(out)
    return out


def one_label(counts: DataFrame, key: str = "image_id") -> DataFrame:
    """The most frequent label of each key; then greater confidence, then name."""
    by = Window.partitionBy(key).orderBy(F.col("n").desc(), F.col("conf").desc(), "label")
    return counts.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")


def inverse_frequency(rows: DataFrame, split: str = "split", label: str = "label", weight: str = "weight") -> DataFrame:
    """Weights that give each label of a split the same sum."""
    s, sl = Window.partitionBy(split), Window.partitionBy(split, label)
    labels = F.size(F.collect_set(label).over(s))
    return rows.withColumn("weight", F.col(weight) * (F.sum(weight).over(s) / labels) / F.sum(weight).over(sl))


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def rank_correct(scores: Column, label: Column, k: int) -> Column:
    """Whether the label is among the k greatest of an array of scores."""
    order = F.transform(F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))), lambda x: x["i"])
    return F.array_contains(F.slice(order, 1, k), label)


def predicted_categories(detections: DataFrame, conf: float, class_conf: float, names: dict[str, str]) -> DataFrame:
    """image_id, label, n, conf: an image's predicted labels. A confident class counts by its name, else the detection category; images below conf are empty. Rows: image_id, category, conf, class, class_conf."""
    from fieldlens.operators.categories import lookup

    shown = F.col("conf") >= conf
    label = F.when(~shown, "empty").when(F.col("class_conf") >= class_conf, F.col("class")).otherwise(lookup(names)[F.col("category").cast("string")])
    d = detections.withColumn("label", label).withColumn("_any", F.max(shown.cast("int")).over(Window.partitionBy("image_id")))
    return d.filter(shown | (F.col("_any") == 0)).groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"), F.max("conf").alias("conf"))


def adjustments(rows: DataFrame, source: str = "geofence") -> DataFrame:
    """from, to, n of predictions (classes, prediction, prediction_source) that a source has changed, most frequent first."""
    from fieldlens.functions.taxa import display_name

    hit = rows.filter(F.col("prediction_source").contains(source))
    pairs = hit.select(display_name(F.col("classes")[0]).alias("from"), display_name(F.col("prediction")).alias("to"))
    return pairs.groupBy("from", "to").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "from", "to")


def calibrated(score: Column, points: list[tuple[float, float]]) -> Column:
    """Linear interpolation of a score between calibration points (score, accuracy)."""
    ps = sorted(points)
    out = F.lit(ps[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(ps, ps[1:], strict=False))):
        out = F.when(score < x1, y0 + (score - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(score <= ps[0][0], ps[0][1]).otherwise(out)


def ordered(rows: DataFrame, key: str, falling: bool = False, nulls: str = "smallest") -> DataFrame:
    """ORDER BY with nulls as smallest or largest, or an error."""
    if nulls == "error":
        kind = rows.schema[key].dataType
        rows = rows.withColumn(key, F.coalesce(key, F.raise_error(F.lit(f"null {key}")).cast(kind)))
    c, first = F.col(key), (nulls != "largest") != falling
    order = (c.desc_nulls_first() if first else c.desc_nulls_last()) if falling else (c.asc_nulls_first() if first else c.asc_nulls_last())
    return rows.orderBy(order)


def sorted_map(m: Column, by_value: bool = False, falling: bool = False) -> Column:
    """Entries of a map in order of keys or values."""
    entries = F.transform(F.map_entries(m), lambda e, i: F.struct((e["value"] if by_value else e["key"]).alias("k"), i.alias("i"), e.alias("e")))
    out = F.transform(F.array_sort(entries), lambda x: x["e"])
    return F.reverse(out) if falling else out


def throughput(speeds: DataFrame, factors: DataFrame) -> DataFrame:
    """device, model, images_per_second: a device's speed times a model's factor."""
    return speeds.join(F.broadcast(factors)).select("device", "model", (F.col("speed") * F.col("factor")).alias("images_per_second"))


def epoch_metrics(rows: DataFrame, ks: tuple[int, ...] = (1, 3), weight: str | None = None) -> DataFrame:
    """Per label and over all (label -1): n, loss (mean of -log of the label's probability) and top_k accuracies. rows: label (place), scores (probabilities)."""
    w = F.col(weight) if weight else F.lit(1.0)
    own = F.get("scores", F.col("label").cast("int"))
    marked = rows.select("label", w.alias("_w"), (-F.log(own)).alias("_loss"), *[rank_correct(F.col("scores"), F.col("label").cast("int"), k).cast("double").alias(f"_k{k}") for k in ks])
    both = marked.unionByName(marked.withColumn("label", F.lit(-1).cast(marked.schema["label"].dataType)))
    mean = [(F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(name) for c, name in (("_loss", "loss"), *((f"_k{k}", f"top_{k}") for k in ks))]
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *mean)


def category_stats(text: Column, category: str = "all") -> Column:
    """(images, labels, p, r, map50, map) of a category's row of a metrics table that a training tool prints."""
    row = rf"(?m)^\s*{category}\s+(\d+)\s+(\d+)\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)"
    return F.when(text.rlike(row), F.struct(*[F.regexp_extract(text, row, k + 1).cast("long" if k < 2 else "double").alias(c) for k, c in enumerate(("images", "labels", "p", "r", "map50", "map"))]))


def gray_fraction(pixels: Column) -> Column:
    """Share of an array of pixels (r, g, b) whose three values are equal; null for none."""
    return F.when(F.size(pixels) > 0, F.size(F.filter(pixels, lambda p: (p["r"] == p["g"]) & (p["g"] == p["b"]))) / F.size(pixels))
