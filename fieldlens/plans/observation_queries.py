"""Queries over images, detections, truth and sequences, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.model import nest
from fieldlens.operators import categories as cat
from fieldlens.operators import combine, compare, evaluate, filters, overlap, sampling, smoothing, validate
from fieldlens.operators import sequences as seqs
from fieldlens.plans.fixtures import Tables, fx
from fieldlens.plans.registry import query

D = "image_id, det_ord, category, conf, x, y, w, h"
IOU = "(greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0.0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0.0))"
IOU = f"CASE WHEN a.w > 0 AND a.h > 0 AND b.w > 0 AND b.h > 0 THEN {IOU} / (a.w * a.h + b.w * b.h - {IOU}) END"


def nested(t: Tables) -> DataFrame:
    """Images with an array of detections; box as an array and the category as text."""
    d = t["fx_detections"].select("image_id", "det_ord", F.col("category").cast("string").alias("category"), "conf", F.array("x", "y", "w", "h").alias("bbox"))
    images = t["fx_images"].withColumn("file", F.concat(F.lit("loc"), F.col("location").cast("string"), F.lit("/img"), F.col("image_id").cast("string"), F.lit(".jpg")))
    return nest(images, d)


def flat(images: DataFrame) -> DataFrame:
    return images.select("image_id", F.explode("detections").alias("d")).select("image_id", "d.det_ord", "d.category", "d.conf")


@query("report_image_categories", fx("fx_images", "fx_classes") + """
, d AS (SELECT d.image_id, CAST(category AS VARCHAR) AS category, conf, class_name, class_conf FROM fx_detections d JOIN fx_classes c ON d.image_id = c.image_id AND d.det_ord = c.det_ord WHERE conf >= 0.2)
SELECT image_id, category, CASE WHEN class_conf >= 0.5 THEN class_name ELSE '' END AS class, count(*) AS n, max(conf) AS max_conf, max(CASE WHEN class_conf >= 0.5 THEN class_conf END) AS max_class_conf FROM d GROUP BY ALL
UNION ALL SELECT image_id, CASE WHEN failure IS NULL THEN 'empty' ELSE 'error' END, '', 0, NULL, NULL FROM fx_images i WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.image_id = i.image_id)""")  # fmt: skip
def report_image_categories(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    d = t["fx_detections"].join(t["part"].select("p_partkey", F.col("p_type").alias("class"), (F.col("p_size") / F.lit(50.0)).alias("class_conf")), F.col("part_id") == F.col("p_partkey"))
    return compare.report(t["fx_images"], d)


@query("filter_confidence", fx("fx_detections") + " SELECT image_id, det_ord, CAST(category AS VARCHAR) AS category, conf FROM fx_detections WHERE conf >= 0.8")
def filter_confidence(spark, sf):
    return flat(filters.by_confidence(nested(Tables(spark, sf)), 0.8))


@query("filter_category_thresholds", fx("fx_detections") + " SELECT image_id, det_ord, CAST(category AS VARCHAR) AS category, conf FROM fx_detections WHERE (category = 1 AND conf > 0.5) OR (category = 2 AND conf > 0.9)")
def filter_category_thresholds(spark, sf):
    return flat(filters.by_category_thresholds(nested(Tables(spark, sf)), {"1": 0.5, "2": 0.9}))


@query("filter_size", fx("fx_detections") + " SELECT image_id, det_ord, CAST(category AS VARCHAR) AS category, conf FROM fx_detections WHERE w * h >= 0.04 AND w * h <= 0.1")
def filter_size(spark, sf):
    return flat(filters.by_size(nested(Tables(spark, sf)), 0.04, 0.1))


@query("filter_query", fx("fx_images") + " SELECT image_id, 'cam' || substr('loc' || location || '/img' || image_id || '.jpg', 4) AS file FROM fx_images WHERE starts_with('loc' || location || '/img' || image_id || '.jpg', 'loc1')")
def filter_query(spark, sf):
    return filters.by_query(nested(Tables(spark, sf)), "loc1", "cam1", prefix=True).select("image_id", "file")


@query("filter_failures", fx("fx_images") + " SELECT image_id, location FROM fx_images WHERE failure IS NULL")
def filter_failures(spark, sf):
    return filters.without_failures(Tables(spark, sf)["fx_images"]).select("image_id", "location")


@query("filter_list", fx("fx_images") + " SELECT image_id, location FROM fx_images WHERE image_id IN (SELECT item_id FROM benchmark)")
def filter_list(spark, sf):
    t = Tables(spark, sf)
    images = t["fx_images"].withColumn("file", F.col("image_id").cast("string"))
    return filters.by_files(images, t["benchmark"].select(F.col("item_id").cast("string").alias("file"))).select("image_id", "location")


@query("filter_rare_classes", fx("fx_classes") + " SELECT image_id, det_ord, class_name FROM fx_classes WHERE class_name IN (SELECT class_name FROM fx_classes GROUP BY 1 HAVING count(*) >= (SELECT count(*) / 150 FROM fx_classes))")
def filter_rare_classes(spark, sf):
    c = Tables(spark, sf)["fx_classes"]
    images = c.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("det_ord", F.array(F.struct(F.col("class_name").alias("id"), F.col("class_conf").alias("conf"))).alias("classifications")))).alias("detections"))
    n = c.count()
    out = filters.without_rare_classes(images, -(-n // 150))
    return out.select("image_id", F.explode("detections").alias("d")).select("image_id", "d.det_ord", F.explode("d.classifications").alias("c")).select("image_id", "det_ord", F.col("c.id").alias("class_name"))


@query("filter_pipeline", fx("fx_detections", "fx_images") + " SELECT image_id, det_ord, CAST(category AS VARCHAR) AS category, conf FROM fx_detections WHERE conf >= 0.3 AND ((category = 1 AND conf > 0.4) OR (category = 3 AND conf > 0.2)) AND w * h <= 0.09")
def filter_pipeline(spark, sf):
    return flat(filters.subset(nested(Tables(spark, sf)), drop_failures=True, confidence=0.3, categories={"1": 0.4, "3": 0.2}, sizes=(None, 0.09)))


@query("filter_any_above", fx("fx_detections") + " SELECT DISTINCT image_id FROM fx_detections WHERE conf >= 0.98 AND category IN (1, 2)")
def filter_any_above(spark, sf):
    return filters.any_above(nested(Tables(spark, sf)), 0.98, ["1", "2"]).select("image_id")


@query("subset_max_conf", fx("fx_images", "fx_detections") + ", m AS (SELECT image_id, max(conf) AS m FROM fx_detections GROUP BY 1) SELECT i.image_id, CASE WHEN m >= 0.6 THEN m WHEN coalesce(m, 0.0) <= 0 THEN coalesce(m, 0.0) ELSE -1.0 END AS max_conf FROM fx_images i LEFT JOIN m USING (image_id) WHERE failure IS NULL")
def subset_max_conf(spark, sf):
    images = nested(Tables(spark, sf)).filter("failure is null").withColumn("before", F.col("detections"))
    return filters.by_confidence(images, 0.6).select("image_id", filters.subset_max_conf(F.col("before"), F.col("detections")).alias("max_conf"))


@query("positive_categories", fx("fx_images", "fx_detections") + " SELECT i.image_id, coalesce(string_agg(DISTINCT CAST(category AS VARCHAR), ',' ORDER BY CAST(category AS VARCHAR)) FILTER (WHERE conf >= CASE WHEN category = 1 THEN 0.5 ELSE 0.8 END), '') AS cats FROM fx_images i LEFT JOIN fx_detections d ON i.image_id = d.image_id WHERE failure IS NULL GROUP BY 1")
def positive_categories(spark, sf):
    images = nested(Tables(spark, sf)).filter("failure is null")
    return images.select("image_id", F.array_join(filters.positive_categories(F.col("detections"), {"1": 0.5, "default": 0.8}), ",").alias("cats"))


@query("locations_per_class", fx("fx_images", "fx_classes") + ", c AS (SELECT class_name, location, f.image_id FROM fx_classes f JOIN fx_images i ON f.image_id = i.image_id) SELECT image_id, class_name, location FROM c WHERE class_name IN (SELECT class_name FROM c GROUP BY 1 HAVING count(DISTINCT location) >= 60)")
def locations_per_class(spark, sf):
    t = Tables(spark, sf)
    c = t["fx_classes"].join(t["fx_images"].select("image_id", "location"), "image_id").withColumn("dataset", F.lit("a"))
    return filters.enough_locations(c, 60, "class_name").select("image_id", "class_name", "location")


@query("remap_categories", fx("fx_detections") + " SELECT image_id, det_ord, CASE category WHEN 1 THEN '7' WHEN 2 THEN '8' ELSE '9' END AS category FROM fx_detections")
def remap_categories(spark, sf):
    d = Tables(spark, sf)["fx_detections"].select("image_id", "det_ord", "category")
    return cat.remapped(d, {"1": "animal", "2": "person", "3": "vehicle"}, {"person": "human"}, {"7": "animal", "8": "human"})


@query("size_categories", fx("fx_detections") + " SELECT image_id, det_ord, CASE WHEN w * h >= 0.1 THEN 'large' WHEN w * h >= 0.04 THEN 'medium' ELSE 'small' END AS size FROM fx_detections")
def size_categories(spark, sf):
    d = Tables(spark, sf)["fx_detections"]
    return d.select("image_id", "det_ord", cat.size_category(F.col("w") * F.col("h"), [(0.04, "medium"), (0.1, "large")], "small").alias("size"))


@query("merge_class_ids", """WITH t AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_partkey % 3 = 0), tn AS (SELECT name, CAST(row_number() OVER (ORDER BY name) AS INT) AS id FROM t),
 s AS (SELECT DISTINCT p_brand AS name FROM part), sn AS (SELECT name, CAST(row_number() OVER (ORDER BY name DESC) AS INT) AS id FROM s)
 SELECT CAST(sn.id AS VARCHAR) AS old_id, CAST(coalesce(tn.id, (SELECT max(id) FROM tn) + row_number() OVER (PARTITION BY tn.id IS NULL ORDER BY sn.id)) AS VARCHAR) AS new_id, sn.name FROM sn LEFT JOIN tn ON sn.name = tn.name""")
def merge_class_ids(spark, sf):
    from pyspark.sql import Window

    p = Tables(spark, sf)["part"]
    t = p.filter("p_partkey % 3 = 0").select(F.col("p_brand").alias("name")).distinct().select("name", F.row_number().over(Window.orderBy("name")).cast("string").alias("id"))
    s = p.select(F.col("p_brand").alias("name")).distinct().select("name", F.row_number().over(Window.orderBy(F.col("name").desc())).cast("string").alias("id"))
    return cat.merged_categories(t, s)


@query("combine_sets", fx("fx_images") + ", r AS (SELECT image_id, location, 0 AS s FROM fx_images WHERE image_id % 2 = 0 UNION ALL SELECT image_id, location + 1000, 1 FROM fx_images WHERE image_id % 3 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN s = 0 AND image_id % 5 = 0 THEN 1 ELSE 0 END, s) AS n FROM r) SELECT image_id, location FROM k WHERE n = 1")
def combine_sets(spark, sf):
    i = Tables(spark, sf)["fx_images"].select("image_id", "location")
    a = i.filter("image_id % 2 = 0").withColumn("detections", F.when(F.col("image_id") % 5 != 0, F.array(F.lit(1))))
    b = i.filter("image_id % 3 = 0").withColumn("location", F.col("location") + 1000).withColumn("detections", F.array(F.lit(1)))
    return combine.combined([a, b], "image_id", unique=False).select("image_id", "location")


@query("set_report", fx("fx_images") + " SELECT coalesce(a.image_id, b.image_id) AS image_id, CASE WHEN a.image_id IS NULL THEN 'b' WHEN b.image_id IS NULL THEN 'a' ELSE 'both' END AS side FROM (SELECT DISTINCT image_id FROM fx_images WHERE image_id % 2 = 0) a FULL JOIN (SELECT DISTINCT image_id FROM fx_images WHERE image_id % 3 = 0) b ON a.image_id = b.image_id")
def set_report(spark, sf):
    i = Tables(spark, sf)["fx_images"]
    return combine.set_report(i.filter("image_id % 2 = 0"), i.filter("image_id % 3 = 0"), "image_id")


@query("iou_pairs", fx("fx_detections") + f" SELECT a.image_id, a.det_ord AS a_ord, b.det_ord AS b_ord, round({IOU}, 9) AS iou FROM fx_detections a JOIN fx_detections b ON a.image_id = b.image_id AND a.category = b.category AND a.det_ord < b.det_ord WHERE {IOU} >= 0.1")
def iou_pairs(spark, sf):
    d = Tables(spark, sf)["fx_detections"].select("image_id", "det_ord", "category", "x", "y", "w", "h")
    p = overlap.overlaps(d, d, ["image_id", "category"], 0.1).filter("a_det_ord < b_det_ord")
    return p.select(F.col("a_image_id").alias("image_id"), F.col("a_det_ord").alias("a_ord"), F.col("b_det_ord").alias("b_ord"), F.round("iou", 9).alias("iou"))


@query("location_overlaps", fx("fx_detections", "fx_images") + f", d AS (SELECT d.image_id, det_ord, category, conf, x, y, w, h, location FROM fx_detections d JOIN fx_images i ON d.image_id = i.image_id WHERE conf >= 0.1) SELECT a.location, a.category, count(*) AS pairs FROM d a JOIN d b ON a.location = b.location AND a.category = b.category AND (a.image_id < b.image_id OR (a.image_id = b.image_id AND a.det_ord < b.det_ord)) WHERE {IOU} >= 0.9 GROUP BY ALL")
def location_overlaps(spark, sf):
    t = Tables(spark, sf)
    d = t["fx_detections"].filter("conf >= 0.1").join(t["fx_images"].select("image_id", "location"), "image_id").select("image_id", "det_ord", "category", "x", "y", "w", "h", "location")
    p = overlap.overlaps(d, d, ["location", "category"], 0.9, grid=True)
    p = p.filter("a_image_id < b_image_id or (a_image_id = b_image_id and a_det_ord < b_det_ord)")
    return p.groupBy(F.col("a_location").alias("location"), F.col("a_category").alias("category")).agg(F.count(F.lit(1)).alias("pairs"))


@query("best_matches", fx("fx_detections") + f", a AS (SELECT {D} FROM fx_detections WHERE det_ord % 2 = 0), b AS (SELECT {D} FROM fx_detections WHERE det_ord % 2 = 1), p AS (SELECT a.image_id, a.det_ord, a.conf AS conf_a, b.conf AS conf_b, b.det_ord AS bo, {IOU} AS iou FROM a JOIN b ON a.image_id = b.image_id AND a.category = b.category) SELECT image_id, det_ord, conf_a, conf_b FROM p WHERE iou >= 0.2 QUALIFY row_number() OVER (PARTITION BY image_id, det_ord ORDER BY iou DESC, bo) = 1")
def best_matches(spark, sf):
    d = Tables(spark, sf)["fx_detections"].select("image_id", "det_ord", "category", "conf", "x", "y", "w", "h")
    return compare.confidence_pairs(d.filter("det_ord % 2 = 0"), d.filter("det_ord % 2 = 1"), 0.0, 0.2).select("image_id", "det_ord", "conf_a", "conf_b")


@query("merge_detections", fx("fx_detections") + f", t AS (SELECT * FROM fx_detections WHERE det_ord % 2 = 0), s AS (SELECT * FROM fx_detections WHERE det_ord % 2 = 1) SELECT image_id, category, conf, x, y, w, h FROM t UNION ALL SELECT image_id, category, conf, x, y, w, h FROM s a WHERE conf >= 0.2 AND NOT EXISTS (SELECT 1 FROM t b WHERE a.image_id = b.image_id AND a.category = b.category AND b.conf >= 0.2 AND {IOU} >= 0.65)")
def merge_detections(spark, sf):
    d = Tables(spark, sf)["fx_detections"].select("image_id", "det_ord", "category", "conf", "x", "y", "w", "h")
    return overlap.merged(d.filter("det_ord % 2 = 0"), [d.filter("det_ord % 2 = 1")]).select("image_id", "category", "conf", "x", "y", "w", "h")


@query("truth_outcomes", fx("fx_detections", "fx_truth") + f", d AS (SELECT * FROM fx_detections WHERE conf > 0.4), o AS (SELECT image_id, CASE WHEN EXISTS (SELECT 1 FROM fx_truth b WHERE a.image_id = b.image_id AND a.category = b.category AND {IOU} >= 0.5) THEN 'tp' ELSE 'fp' END AS outcome FROM d a UNION ALL SELECT image_id, 'fn' FROM fx_truth a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE a.image_id = b.image_id AND a.category = b.category AND {IOU} >= 0.5)) SELECT image_id, outcome, count(*) AS n FROM o GROUP BY ALL")
def truth_outcomes(spark, sf):
    t = Tables(spark, sf)
    o = evaluate.detection_outcomes(t["fx_detections"], t["fx_truth"], 0.4)
    return o.groupBy("image_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("compare_outcomes", fx("fx_images", "fx_detections") + """, a AS (SELECT i.image_id, coalesce(string_agg(DISTINCT category, ',' ORDER BY category) FILTER (WHERE conf >= 0.5), '') AS c, coalesce(max(conf), 0.0) AS t FROM fx_images i LEFT JOIN fx_detections d ON i.image_id = d.image_id AND det_ord % 2 = 0 WHERE failure IS NULL GROUP BY 1),
 b AS (SELECT i.image_id, coalesce(string_agg(DISTINCT category, ',' ORDER BY category) FILTER (WHERE conf >= 0.7), '') AS c, coalesce(max(conf), 0.0) AS t FROM fx_images i LEFT JOIN fx_detections d ON i.image_id = d.image_id AND det_ord % 2 = 1 WHERE failure IS NULL GROUP BY 1)
 SELECT a.image_id, CASE WHEN a.c <> '' AND b.c <> '' THEN CASE WHEN a.c = b.c THEN 'common_detections' ELSE 'class_transitions' END WHEN a.c <> '' THEN 'detections_a_only' WHEN b.c <> '' THEN 'detections_b_only' ELSE 'common_non_detections' END AS outcome,
 CASE WHEN a.c <> '' AND b.c = '' THEN a.t WHEN b.c <> '' AND a.c = '' THEN b.t ELSE greatest(a.t, b.t) END AS sort_conf FROM a JOIN b ON a.image_id = b.image_id""")
def compare_outcomes(spark, sf):
    t = Tables(spark, sf)
    d = t["fx_detections"]
    return compare.compare_sets(compare.shown_sets(t["fx_images"], d.filter("det_ord % 2 = 0"), 0.5), compare.shown_sets(t["fx_images"], d.filter("det_ord % 2 = 1"), 0.7))


@query("combination_groups", fx("fx_detections") + ", p AS (SELECT image_id, coalesce(string_agg(DISTINCT CAST(category AS VARCHAR), '_' ORDER BY CAST(category AS VARCHAR)) FILTER (WHERE conf >= 0.5), '') AS cats FROM fx_detections GROUP BY 1) SELECT cats, count(*) AS n FROM p GROUP BY 1")
def combination_groups(spark, sf):
    return compare.combination_groups(Tables(spark, sf)["fx_detections"], 0.5)


@query("route_folders", fx("fx_images", "fx_detections") + ", h AS (SELECT image_id, string_agg(DISTINCT CASE category WHEN 1 THEN 'animal' WHEN 2 THEN 'person' ELSE 'vehicle' END, '_' ORDER BY CASE category WHEN 1 THEN 'animal' WHEN 2 THEN 'person' ELSE 'vehicle' END) AS f FROM fx_detections WHERE conf >= CASE category WHEN 1 THEN 0.3 ELSE 0.6 END GROUP BY 1) SELECT i.image_id, CASE WHEN failure IS NOT NULL THEN 'failure' ELSE coalesce(f, 'empty') END AS folder FROM fx_images i LEFT JOIN h ON i.image_id = h.image_id")
def route_folders(spark, sf):
    t = Tables(spark, sf)
    return compare.routing(t["fx_images"], t["fx_detections"], {"1": 0.3, "default": 0.6}, {"1": "animal", "2": "person", "3": "vehicle"})


@query("make_sequences", fx("fx_capture") + """, m AS (SELECT image_id, location, captured_at, CASE WHEN p IS NULL OR captured_at IS NULL OR epoch_us(captured_at) - epoch_us(p) > 3600000000 THEN 1 ELSE 0 END AS s FROM (SELECT *, lag(captured_at) OVER (PARTITION BY location ORDER BY captured_at NULLS LAST, image_id) AS p FROM fx_capture)),
 q AS (SELECT *, CAST(sum(s) OVER (PARTITION BY location ORDER BY captured_at NULLS LAST, image_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS seq_index FROM m)
 SELECT image_id, location, seq_index, 'location_' || location || '_sequence_index_' || lpad(CAST(seq_index AS VARCHAR), 5, '0') AS seq_id, row_number() OVER (PARTITION BY location, seq_index ORDER BY captured_at NULLS LAST, image_id) - 1 AS frame_num, count(*) OVER (PARTITION BY location, seq_index) AS seq_num_frames FROM q""")
def make_sequences(spark, sf):
    return seqs.sequences(Tables(spark, sf)["fx_capture"], 3600).select("image_id", "location", "seq_index", "seq_id", "frame_num", "seq_num_frames")


@query("sequence_categories", fx("fx_capture") + ", q AS (SELECT location AS seq_id, string_agg(DISTINCT category, ',' ORDER BY category) AS text FROM fx_capture GROUP BY 1) SELECT seq_id, text FROM q")
def sequence_categories(spark, sf):
    c = Tables(spark, sf)["fx_capture"]
    return seqs.annotations_by(c.select("image_id", F.col("category").alias("name")), c.select("image_id", F.col("location").alias("seq_id"))).select("seq_id", "text")


@query("sequence_fill", fx("fx_capture") + " SELECT image_id, location FROM fx_capture QUALIFY row_number() OVER (PARTITION BY location ORDER BY image_id) <= 3")
def sequence_fill(spark, sf):
    return seqs.at_most(Tables(spark, sf)["fx_capture"], "location", 3, "image_id").select("image_id", "location")


@query("video_rollup", fx("fx_frames") + " SELECT video_id, category, frame_number, conf FROM fx_frames QUALIFY row_number() OVER (PARTITION BY video_id, category ORDER BY conf DESC, frame_number) = 2")
def video_rollup(spark, sf):
    return seqs.video_detections(Tables(spark, sf)["fx_frames"], 2).select("video_id", "category", "frame_number", "conf")


@query("image_status_all", fx("fx_capture") + ", l AS (SELECT CAST(image_id // 3 AS BIGINT) AS image_id, CASE category WHEN 'click' THEN 'empty' WHEN 'view' THEN 'unknown' ELSE category END AS name FROM fx_capture), s AS (SELECT image_id, bool_or(name = 'empty') AS n, bool_or(name = 'unknown') AS u, bool_or(name NOT IN ('empty', 'unknown')) AS p, count(DISTINCT name) AS k, min(name) AS m FROM l GROUP BY 1) SELECT image_id, CASE WHEN CAST(n AS INT) + CAST(u AS INT) + CAST(p AS INT) > 1 THEN 'ambiguous' WHEN n THEN 'negative' WHEN p THEN 'positive' ELSE 'unknown' END AS status, CASE WHEN k = 1 THEN m END AS \"only\" FROM s")
def image_status_all(spark, sf):
    """Status by the labels of all captures, three to an image."""
    c = Tables(spark, sf)["fx_capture"]
    name = F.when(F.col("category") == "click", "empty").when(F.col("category") == "view", "unknown").otherwise(F.col("category"))
    image = F.floor(F.col("image_id") / 3).alias("image_id")
    return evaluate.image_status(c.select(image, name.alias("name")), c.select(image).distinct())


PR = fx("fx_scored") + ", p AS (SELECT score, sum(truth) AS p, count(*) AS k FROM fx_scored GROUP BY 1), r AS (SELECT score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(k) OVER w AS BIGINT) AS n FROM p WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), q AS (SELECT score, tp, n, tp / CAST(n AS DOUBLE) AS precision, tp / CAST((SELECT sum(truth) FROM fx_scored) AS DOUBLE) AS recall FROM r)"


@query("pr_curve", PR + " SELECT * FROM q")
def pr_curve(spark, sf):
    return evaluate.pr_points(Tables(spark, sf)["fx_scored"])


@query("average_precision", PR + " SELECT round(sum(precision * (recall - prev)), 9) AS ap FROM (SELECT *, coalesce(lag(recall) OVER (ORDER BY score DESC), 0.0) AS prev FROM q)")
def average_precision(spark, sf):
    return evaluate.average_precision(evaluate.pr_points(Tables(spark, sf)["fx_scored"])).select(F.round("ap", 9).alias("ap"))


@query("precision_at_recall", PR + " SELECT precision, score AS threshold FROM q WHERE recall >= 0.6 ORDER BY score DESC LIMIT 1")
def precision_at_recall(spark, sf):
    return evaluate.precision_at(evaluate.pr_points(Tables(spark, sf)["fx_scored"]), 0.6)


@query("confusion_at_threshold", fx("fx_scored") + ", c AS (SELECT count(*) FILTER (WHERE score > 0.5 AND truth = 1) AS tp, count(*) FILTER (WHERE score > 0.5 AND truth <> 1) AS fp, count(*) FILTER (WHERE score <= 0.5 AND truth = 1) AS fn, count(*) FILTER (WHERE score <= 0.5 AND truth <> 1) AS tn FROM fx_scored), m AS (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(tp + fn AS DOUBLE) AS recall FROM c) SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM m")
def confusion_at_threshold(spark, sf):
    return evaluate.counts_at(Tables(spark, sf)["fx_scored"], 0.5)


CM = "WITH c AS (SELECT c_mktsegment AS truth, CASE WHEN c_custkey % 4 = 0 THEN 'OTHER' ELSE c_mktsegment END AS pred FROM customer), m AS (SELECT truth, pred, count(*) AS n FROM c GROUP BY ALL)"


def _pairs(spark, sf):
    return Tables(spark, sf)["customer"].select(F.col("c_mktsegment").alias("truth"), F.when(F.col("c_custkey") % 4 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("pred"))


@query("confusion_matrix", CM + " SELECT truth, pred, n, round(n / (sum(n) OVER (PARTITION BY truth) + 1e-7), 12) AS share FROM m")
def confusion_matrix(spark, sf):
    return evaluate.confusion(_pairs(spark, sf)).withColumn("share", F.round("share", 12))


@query("label_stats", CM + ", t AS (SELECT truth AS label, sum(n) AS r, sum(n) FILTER (WHERE truth = pred) AS h FROM m GROUP BY 1), p AS (SELECT pred AS label, sum(n) AS k FROM m GROUP BY 1) SELECT coalesce(t.label, p.label) AS label, round(coalesce(h, 0) / (coalesce(k, 0) + 1e-8), 9) AS precision, round(h / r, 9) AS recall FROM t FULL JOIN p ON t.label = p.label")
def label_stats(spark, sf):
    return evaluate.label_stats(evaluate.confusion(_pairs(spark, sf))).select("label", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("calibration_error", fx("fx_scored") + ", b AS (SELECT least(CAST(floor(score * 10) AS INT), 9) AS bin, count(*) AS k, avg(CAST(truth AS DOUBLE)) AS acc, avg(score) AS m FROM fx_scored GROUP BY 1) SELECT round(sum(k * abs(acc - m)) / sum(k), 9) AS ece FROM b")
def calibration_error(spark, sf):
    return evaluate.calibration_error(Tables(spark, sf)["fx_scored"]).select(F.round("ece", 9).alias("ece"))


@query("equivalent_threshold", fx("fx_detections") + ", a AS (SELECT conf FROM fx_detections WHERE det_ord % 2 = 0), b AS (SELECT conf * conf AS conf FROM fx_detections WHERE det_ord % 2 = 1), s AS (SELECT count(*) FILTER (WHERE conf >= 0.5) / CAST(count(*) AS DOUBLE) AS f FROM a), r AS (SELECT conf, row_number() OVER (ORDER BY conf) - 1 AS k, count(*) OVER () AS n FROM b) SELECT conf AS threshold FROM r, s WHERE k = n - CAST(round_even(n * f, 0) AS BIGINT)")
def equivalent_threshold(spark, sf):
    d = Tables(spark, sf)["fx_detections"]
    return evaluate.equivalent_threshold(d.filter("det_ord % 2 = 0"), d.filter("det_ord % 2 = 1").select((F.col("conf") * F.col("conf")).alias("conf")), 0.5)


def _two_label_sets(t: Tables) -> DataFrame:
    """image_id, truth, pred of all captures, three to an image; the third is predicted as the category after its own."""
    c = t["fx_capture"]
    names = [r[0] for r in c.select("category").distinct().orderBy("category").collect()]
    after = F.create_map(*[F.lit(x) for pair in zip(names, names[1:] + names[:1], strict=True) for x in pair])
    return c.select(F.floor(F.col("image_id") / 3).alias("image_id"), F.col("category").alias("truth"), F.when(F.col("image_id") % 3 == 0, after[F.col("category")]).otherwise(F.col("category")).alias("pred"))


#: As _two_label_sets().
TWO = fx("fx_capture") + ", n AS (SELECT category, coalesce(lead(category) OVER (ORDER BY category), first(category) OVER (ORDER BY category)) AS after FROM (SELECT DISTINCT category FROM fx_capture)), c AS (SELECT CAST(image_id // 3 AS BIGINT) AS image_id, f.category AS truth, CASE WHEN image_id % 3 = 0 THEN after ELSE f.category END AS pred FROM fx_capture f JOIN n ON f.category = n.category)"


@query("multilabel_scores_all", TWO + ", t AS (SELECT DISTINCT image_id, truth AS label FROM c), p AS (SELECT DISTINCT image_id, pred AS label FROM c), b AS (SELECT coalesce(t.label, p.label) AS label, count(*) FILTER (WHERE t.label IS NOT NULL AND p.label IS NOT NULL) AS tp, count(*) FILTER (WHERE t.label IS NULL) AS fp, count(*) FILTER (WHERE p.label IS NULL) AS fn FROM t FULL JOIN p ON t.image_id = p.image_id AND t.label = p.label GROUP BY 1) SELECT label, tp, fp, fn, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 9) AS precision, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 9) AS recall, round(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 9) AS f1 FROM b")
def multilabel_scores_all(spark, sf):
    """Scores by label over all captures."""
    c = _two_label_sets(Tables(spark, sf))
    s = evaluate.multilabel_scores(c.select("image_id", F.col("truth").alias("label")), c.select("image_id", F.col("pred").alias("label")))
    return s.withColumns({m: F.round(m, 9) for m in ("precision", "recall", "f1")})


@query("one_label", fx("fx_capture") + ", c AS (SELECT location AS image_id, category AS label, count(*) AS n, max(conf) AS conf FROM fx_capture GROUP BY ALL) SELECT image_id, label FROM c QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, conf DESC, label) = 1")
def one_label(spark, sf):
    c = Tables(spark, sf)["fx_capture"].groupBy(F.col("location").alias("image_id"), F.col("category").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.max("conf").alias("conf"))
    return evaluate.one_label(c).select("image_id", "label")


@query("inverse_frequency", "WITH r AS (SELECT c_custkey AS id, c_mktsegment AS label, c_nationkey % 3 AS split, CAST(1 AS DOUBLE) AS w FROM customer) SELECT id, round(w * (sum(w) OVER (PARTITION BY split) / k) / sum(w) OVER (PARTITION BY split, label), 9) AS weight FROM (SELECT r.*, k FROM r JOIN (SELECT split, count(DISTINCT label) AS k FROM r GROUP BY 1) q ON r.split = q.split)")
def inverse_frequency(spark, sf):
    r = Tables(spark, sf)["customer"].select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), (F.col("c_nationkey") % 3).alias("split"), F.lit(1.0).alias("weight"))
    return evaluate.inverse_frequency(r).select("id", F.round("weight", 9).alias("weight"))


@query("top_k_confident", fx("fx_detections") + " SELECT category, image_id, det_ord FROM fx_detections QUALIFY row_number() OVER (PARTITION BY category ORDER BY conf DESC, image_id, det_ord) <= 10")
def top_k_confident(spark, sf):
    d = Tables(spark, sf)["fx_detections"]
    return evaluate.top_k(d, ["category"], [F.col("conf").desc(), F.col("image_id"), F.col("det_ord")], 10).select("category", "image_id", "det_ord")


@query("class_counts", fx("fx_detections", "fx_classes") + " SELECT d.image_id, class_name AS class, count(*) AS n, min(d.det_ord) AS first FROM fx_detections d JOIN fx_classes c ON d.image_id = c.image_id AND d.det_ord = c.det_ord WHERE conf >= 0.15 AND class_conf >= 0.5 GROUP BY ALL")
def class_counts(spark, sf):
    return smoothing.class_counts(_classified(Tables(spark, sf)))


def _classified(t: Tables) -> DataFrame:
    c = t["fx_classes"]
    return t["fx_detections"].join(c, ["image_id", "det_ord"]).select("image_id", "det_ord", "category", "conf", F.col("class_name").alias("class"), "class_conf")


def _grouped(t: Tables) -> DataFrame:
    """Detections by location, with few classes, so that groups have repeats."""
    kind = F.element_at(F.split("class", " "), -1)
    d = _classified(t).withColumn("class", F.when(kind == "TIN", "other").otherwise(kind))
    return d.join(t["fx_images"].select("image_id", "location"), "image_id").withColumn("group", F.col("location") * 50 + F.col("image_id") % 50).withColumn("det_ord", F.col("image_id") * 100 + F.col("det_ord"))


@query("smooth_groups", fx("fx_images", "fx_classes") + """, r AS (SELECT i.location * 50 + d.image_id % 50 AS g, d.image_id * 100 + d.det_ord AS o, CASE WHEN string_split(class_name, ' ')[-1] = 'TIN' THEN 'other' ELSE string_split(class_name, ' ')[-1] END AS c, conf >= 0.15 AND class_conf >= 0.5 AS e FROM fx_detections d JOIN fx_classes c ON d.image_id = c.image_id AND d.det_ord = c.det_ord JOIN fx_images i ON d.image_id = i.image_id),
 n1 AS (SELECT g, c, count(*) AS n, min(o) AS f FROM r WHERE e GROUP BY ALL), d1 AS (SELECT g, c AS dom, n AS nd, count(*) OVER (PARTITION BY g) AS k FROM n1 QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, c = 'other', f) = 1),
 r1 AS (SELECT r.g, o, e, CASE WHEN e AND k > 1 AND c = 'other' AND dom <> 'other' AND nd >= 2 THEN dom ELSE c END AS c FROM r LEFT JOIN d1 ON r.g = d1.g),
 n2 AS (SELECT g, c, count(*) AS n, min(o) AS f FROM r1 WHERE e GROUP BY ALL), d2 AS (SELECT g, c AS dom, n AS nd, count(*) OVER (PARTITION BY g) AS k FROM n2 QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, f) = 1)
 SELECT r1.g AS "group", o AS det_ord, CASE WHEN e AND k > 1 AND dom <> 'other' AND nd >= 4 AND n2.n < nd AND n2.n <= 1 THEN dom ELSE r1.c END AS class FROM r1 LEFT JOIN d2 ON r1.g = d2.g LEFT JOIN n2 ON r1.g = n2.g AND r1.c = n2.c""")
def smooth_groups(spark, sf):
    return smoothing.smooth(_grouped(Tables(spark, sf)), group="group").select("group", "det_ord", "class")


@query("ntile_chunks", "SELECT c_custkey AS id, CAST(ntile(7) OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS chunk FROM customer")
def ntile_chunks(spark, sf):
    c = Tables(spark, sf)["customer"].select(F.col("c_custkey").alias("id"))
    return sampling.n_chunks(c, 7, "id")


@query("fixed_chunks", "SELECT c_custkey AS id, CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 64) AS BIGINT) AS chunk FROM customer")
def fixed_chunks(spark, sf):
    return sampling.chunks_of(Tables(spark, sf)["customer"].select(F.col("c_custkey").alias("id")), 64, "id")


@query("proportional_sample", "WITH c AS (SELECT c_mktsegment AS cell, count(*) AS n FROM customer GROUP BY 1) SELECT cell, n, CAST(CASE WHEN t <= 100 THEN n ELSE greatest(1, floor(n * 100 / t)) END AS BIGINT) AS take FROM c, (SELECT sum(n) AS t FROM c)")
def proportional_sample(spark, sf):
    c = Tables(spark, sf)["customer"].groupBy(F.col("c_mktsegment").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return sampling.proportional(c, 100)


@query("validate_results", fx("fx_detections") + " SELECT 'unknown_category' AS rule, CAST(image_id AS VARCHAR) AS key FROM fx_detections WHERE category NOT IN (1, 2)")
def validate_results(spark, sf):
    t = Tables(spark, sf)
    images = t["fx_images"].withColumn("no_result", F.col("failure").isNotNull())
    return validate.results(images, t["fx_detections"], {"1": "animal", "2": "person"})


@query("annotation_counts", "SELECT n_name AS name, count(c_custkey) AS annotations, count(DISTINCT c_mktsegment) AS images FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def annotation_counts(spark, sf):
    t = Tables(spark, sf)
    ann = t["customer"].select(F.col("c_nationkey").alias("category_id"), F.col("c_mktsegment").alias("image_id"))
    return validate.per_category(ann, t["nation"].select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


@query("detection_iou_geometry", fx("fx_detections") + " SELECT image_id, det_ord, round(sqrt((x + w / 2) * (x + w / 2) + (y + h / 2) * (y + h / 2)), 9) AS dist, round(sqrt(pow(greatest(x - 0.1, 0.0, 0.0 - (x + w)), 2) + pow(greatest(y - 0.1, 0.0, 0.0 - (y + h)), 2)), 9) AS gap FROM fx_detections")
def detection_iou_geometry(spark, sf):
    from fieldlens.functions import geometry as g

    d = Tables(spark, sf)["fx_detections"]
    b, unit = F.array("x", "y", "w", "h"), F.array(*map(F.lit, (0.0, 0.0, 0.1, 0.1)))
    c = g.corner_to_center(b)
    return d.select("image_id", "det_ord", F.round(g.distance(F.lit(0.0), F.lit(0.0), c[0], c[1]), 9).alias("dist"), F.round(g.gap(b, unit, corners=False), 9).alias("gap"))




@query("predicted_labels", fx("fx_classes") + ", r AS (SELECT d.image_id, conf, CASE WHEN conf < 0.5 THEN 'empty' WHEN class_conf >= 0.5 THEN class_name ELSE CASE category WHEN 1 THEN 'animal' WHEN 2 THEN 'person' ELSE 'vehicle' END END AS label, max(conf) OVER (PARTITION BY d.image_id) >= 0.5 AS a FROM fx_detections d JOIN fx_classes c ON d.image_id = c.image_id AND d.det_ord = c.det_ord) SELECT image_id, label, count(*) AS n, max(conf) AS conf FROM r WHERE conf >= 0.5 OR NOT a GROUP BY ALL")
def predicted_labels(spark, sf):
    return evaluate.predicted_categories(_classified(Tables(spark, sf)), 0.5, 0.5, {"1": "animal", "2": "person", "3": "vehicle"})


@query("confidence_with_truth", fx("fx_detections", "fx_truth") + f", a AS (SELECT {D} FROM fx_detections WHERE det_ord % 2 = 0) SELECT image_id, det_ord, EXISTS (SELECT 1 FROM fx_truth b WHERE a.image_id = b.image_id AND a.category = b.category AND {IOU} >= 0.5) AS truth FROM a")
def confidence_with_truth(spark, sf):
    t = Tables(spark, sf)
    d = t["fx_detections"].filter("det_ord % 2 = 0").select("image_id", "det_ord", "category", "conf", "x", "y", "w", "h")
    return overlap.with_truth(d.select("image_id", "det_ord"), d, d, t["fx_truth"], 0.5)


def _errors(x: str, y: str) -> str:
    return f"SELECT * FROM (SELECT a.conf AS ca, b.conf AS cb, {IOU} AS iou, greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.w - b.w), abs(a.h - b.h)) AS p, row_number() OVER (PARTITION BY a.image_id, a.det_ord ORDER BY {IOU} DESC, b.det_ord) AS k FROM {x} a LEFT JOIN {y} b ON a.image_id = b.image_id AND a.category = b.category) WHERE k = 1"


@query("largest_errors_all", fx("fx_detections") + f""", o AS (SELECT {D} FROM fx_detections), v AS (SELECT * REPLACE (CASE WHEN image_id % 5 = 0 THEN conf - CAST(0.001 AS DOUBLE) ELSE conf END AS conf, CASE WHEN image_id % 3 = 0 THEN x + CAST(0.004 AS DOUBLE) ELSE x END AS x) FROM o),
 m AS ({_errors('o', 'v')} UNION ALL {_errors('v', 'o')}) SELECT round(max(CASE WHEN iou >= 0.85 THEN abs(ca - cb) ELSE ca END), 9) AS conf_error, round(max(CASE WHEN iou >= 0.85 THEN p ELSE 0.0 END), 9) AS coord_error FROM m""")
def largest_errors_all(spark, sf):
    """Over all boxes, several of one category in an image too."""
    d = Tables(spark, sf)["fx_detections"].select("image_id", "det_ord", "category", "conf", "x", "y", "w", "h")
    k = F.col("image_id")
    shifted = d.withColumn("conf", F.when(k % 5 == 0, F.col("conf") - 0.001).otherwise(F.col("conf"))).withColumn("x", F.when(k % 3 == 0, F.col("x") + 0.004).otherwise(F.col("x")))
    return compare.largest_errors(d, shifted).select(*[F.round(c, 9).alias(c) for c in ("conf_error", "coord_error")])


@query("review_order")
def review_order(spark, sf):
    t = Tables(spark, sf)
    d = t["fx_detections"].join(t["fx_images"].select("image_id", "location"), "image_id")
    c = d.groupBy("location", "x", "y", "w", "h").agg(F.min(F.col("image_id") * 100 + F.col("det_ord")).alias("cluster"))
    return overlap.by_place(c)


@query("cell_confusion_all", TWO + ", s AS (SELECT image_id, list(DISTINCT truth) AS t, list(DISTINCT pred) AS p FROM c GROUP BY 1), e AS (SELECT t AS ts, p AS ps, unnest(t) AS a FROM s), f AS (SELECT ts, ps, a, unnest(ps) AS b FROM e) SELECT a AS truth, b AS pred, count(*) AS n FROM f WHERE NOT (list_contains(ts, b) AND list_contains(ps, a) AND a <> b) GROUP BY ALL")
def cell_confusion_all(spark, sf):
    """Confusion of all captures' label sets, three captures to an image."""
    s = _two_label_sets(Tables(spark, sf)).groupBy("image_id").agg(F.collect_set("truth").alias("truth"), F.collect_set("pred").alias("pred"))
    return evaluate.multilabel_confusion(s)


@query("annotations_with_score", fx("fx_capture") + " SELECT image_id, category FROM fx_capture WHERE image_id % 3 <> 0 AND conf >= 0.1")
def annotations_with_score(spark, sf):
    c = Tables(spark, sf)["fx_capture"].withColumn("score", F.when(F.col("image_id") % 3 != 0, F.col("conf")))
    return filters.annotations_by_score(c, 0.1, missing="drop").select("image_id", "category")


@query("sized_confidences", fx("fx_detections") + " SELECT image_id, det_ord, round(CASE WHEN conf <= 0.2 THEN 0.1 WHEN conf < 0.6 THEN 0.1 + (conf - 0.2) * ((0.5 - 0.1) / (0.6 - 0.2)) WHEN conf < 0.9 THEN 0.5 + (conf - 0.6) * ((0.95 - 0.5) / (0.9 - 0.6)) ELSE 0.95 END, 9) AS weight FROM fx_detections")
def sized_confidences(spark, sf):
    d = Tables(spark, sf)["fx_detections"]
    return d.select("image_id", "det_ord", F.round(evaluate.calibrated(F.col("conf"), [(0.2, 0.1), (0.6, 0.5), (0.9, 0.95)]), 9).alias("weight"))


@query("video_frames", fx("fx_frames") + " SELECT video_id, frame_number, category FROM fx_frames WHERE frame_number % 2 = 0")
def video_frames(spark, sf):
    from fieldlens.operators.crops import sampled_frames

    return sampled_frames(Tables(spark, sf)["fx_frames"], 2).select("video_id", "frame_number", "category")
