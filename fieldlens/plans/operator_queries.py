"""Queries through further operators, each with its oracle SQL; ordered folds are list_reduce there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import numbers, paths, strings, times
from fieldlens.operators import categories as cat
from fieldlens.operators import combine, compare, crops, evaluate, overlap, sampling, sequences, summary, taxonomy
from fieldlens.plans.fixtures import Tables, fx
from fieldlens.plans.format_queries import FILE, images, ordinary
from fieldlens.plans.registry import query
from fieldlens.sources import documents, sinks
from fieldlens.sources.scratch import scratch
from fieldlens.streaming import sequences as streams

AREA = "(greatest(least(q.x + q.w, d.x + d.w) - greatest(q.x, d.x), 0.0) * greatest(least(q.y + q.h, d.y + d.h) - greatest(q.y, d.y), 0.0))"
IOU = f"({AREA} / (q.w * q.h + d.w * d.h - {AREA}))"


def kept(limit: float, extra: str = "true") -> str:
    """A list_reduce that keeps what no kept one overlaps by more than a limit."""
    return f"list_reduce(l, lambda k, d: CASE WHEN len(list_filter(k, lambda q: {IOU} > {limit} AND {extra})) > 0 THEN k ELSE list_append(k, d) END, list_slice(l, 1, 0))"


ROW = "{'det_ord': det_ord, 'category': category, 'conf': conf, 'x': x, 'y': y, 'w': w, 'h': h}"


@query("suppress_per_class", fx("fx_detections") + f", g AS (SELECT image_id, list({ROW} ORDER BY conf DESC, det_ord) AS l FROM fx_detections GROUP BY 1), k AS (SELECT image_id, unnest({kept(0.3, 'q.category = d.category')}) AS d FROM g) SELECT image_id, d.det_ord AS det_ord, CAST(d.category AS VARCHAR) AS category, d.conf AS conf FROM k")
def suppress_per_class(spark, sf):
    from fieldlens.plans.observation_queries import flat, nested

    rows = nested(Tables(spark, sf)).filter("failure is null")
    return flat(rows.withColumn("detections", overlap.suppressed(F.col("detections"), 0.3, True)))


@query("suppress_overlaps", fx("fx_detections") + f", g AS (SELECT image_id, list({ROW} ORDER BY conf DESC, det_ord) AS l FROM fx_detections GROUP BY 1), k AS (SELECT image_id, unnest({kept(0.45)}) AS d FROM g) SELECT image_id, d.det_ord AS det_ord, CAST(d.category AS VARCHAR) AS category, d.conf AS conf FROM k")
def suppress_overlaps(spark, sf):
    from fieldlens.plans.observation_queries import flat, nested

    rows = nested(Tables(spark, sf)).filter("failure is null")
    return flat(rows.withColumn("detections", overlap.suppressed(F.col("detections"), 0.45)))


def repeats(least: int, where: str = "true") -> str:
    """The clusters of repeated detections: founders by an ordered fold, then all that overlap them."""
    found = "list_reduce(l, lambda k, d: CASE WHEN len(list_filter(k, lambda q: " + IOU + " >= 0.9)) > 0 THEN k ELSE list_append(k, d) END, list_slice(l, 1, 0))"
    return fx("fx_images", "fx_detections") + f""", v AS (SELECT d.*, location, row_number() OVER (PARTITION BY location, category ORDER BY d.image_id, det_ord) AS r FROM fx_detections d JOIN fx_images i ON d.image_id = i.image_id WHERE {where}),
 g AS (SELECT location, category, list({{'r': r, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY r) AS l FROM v GROUP BY ALL), f AS (SELECT location, category, {found} AS k FROM g),
 u AS (SELECT location, category, unnest(k) AS q, generate_subscripts(k, 1) - 1 AS cluster FROM f), m AS (SELECT d.*, cluster FROM v d JOIN u ON d.location = u.location AND d.category = u.category AND d.r >= u.q.r AND {IOU.replace('q.', 'u.q.')} >= 0.9),
 c AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY location, category, cluster) >= {least})"""


@query("repeat_clusters", repeats(2, "conf >= 0.1") + " SELECT location, category, image_id, CAST(cluster AS BIGINT) AS cluster, det_ord FROM c")
def repeat_clusters(spark, sf):
    t = Tables(spark, sf)
    d = t["fx_detections"].filter("conf >= 0.1").join(t["fx_images"].select("image_id", "location"), "image_id")
    return overlap.repeated(d, 0.9, 2)


@query("repeat_negated", repeats(3) + " SELECT image_id, det_ord, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.image_id = v.image_id AND c.det_ord = v.det_ord) THEN -conf ELSE conf END AS conf FROM v")
def repeat_negated(spark, sf):
    t = Tables(spark, sf)
    d = t["fx_detections"].join(t["fx_images"].select("image_id", "location"), "image_id")
    return overlap.negated(d, overlap.repeated(d, 0.9, 3)).select("image_id", "det_ord", "conf")


@query("n_way_comparison", fx("fx_images", "fx_detections") + """, s AS (SELECT i.image_id, k, coalesce(string_agg(DISTINCT category, ',' ORDER BY category) FILTER (WHERE conf >= 0.15), '') AS c FROM fx_images i CROSS JOIN range(3) r(k) LEFT JOIN fx_detections d ON d.image_id = i.image_id AND det_ord % 3 = k WHERE failure IS NULL GROUP BY ALL)
 SELECT CAST(a.k AS INT) AS a, CAST(b.k AS INT) AS b, CASE WHEN a.c <> '' AND b.c <> '' THEN CASE WHEN a.c = b.c THEN 'common_detections' ELSE 'class_transitions' END WHEN a.c <> '' THEN 'detections_a_only' WHEN b.c <> '' THEN 'detections_b_only' ELSE 'common_non_detections' END AS outcome, count(*) AS n FROM s a JOIN s b ON a.image_id = b.image_id AND a.k < b.k GROUP BY ALL""")
def n_way_comparison(spark, sf):
    t = Tables(spark, sf)
    d = t["fx_detections"]
    return compare.n_way([d.filter(F.col("det_ord") % 3 == k) for k in range(3)], t["fx_images"])


@query("sample_per_category", fx("fx_detections") + " SELECT image_id, category FROM (SELECT DISTINCT image_id, category FROM fx_detections) QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5('3|' || image_id), image_id) <= 25")
def sample_per_category(spark, sf):
    return sampling.per_group(Tables(spark, sf)["fx_detections"].select("image_id", "category").distinct(), ["category"], 25, seed=3)


@query("sample_by_tier", fx("fx_detections") + " SELECT image_id, det_ord FROM fx_detections QUALIFY row_number() OVER (PARTITION BY category ORDER BY det_ord, md5('0|' || image_id), image_id) <= 40")
def sample_by_tier(spark, sf):
    return sampling.by_priority(Tables(spark, sf)["fx_detections"], 40, label="category", tier="det_ord").select("image_id", "det_ord")


@query("detector_output", fx("fx_detections") + f""", c AS (SELECT image_id, det_ord, CASE WHEN conf >= 1 - conf THEN 0 ELSE 1 END AS category, greatest(conf, 1 - conf) * 0.9 AS conf, x, y, w, h FROM fx_detections), o AS (SELECT * FROM c WHERE conf > 0.5),
 g AS (SELECT image_id, list({ROW} ORDER BY conf DESC, category, x, y, w, h) AS l FROM o GROUP BY 1) SELECT image_id, CAST(len({kept(0.45, 'q.category = d.category')}) AS BIGINT) AS n, list_max(list_transform(l, lambda d: d.conf)) AS top FROM g""")
def detector_output(spark, sf):
    d = Tables(spark, sf)["fx_detections"].orderBy("image_id")
    raw = d.select("image_id", F.array("x", "y", "w", "h").alias("bbox"), F.lit(0.9).alias("objectness"), F.array("conf", 1 - F.col("conf")).alias("class_scores"))
    out = overlap.detector_nms(raw, 0.5, 0.45)
    return out.select("image_id", F.size("detections").cast("long").alias("n"), F.array_max(F.transform("detections", lambda x: x["conf"])).alias("top"))


@query("resized_annotations", fx("fx_detections") + " SELECT image_id, det_ord, round(x * 100 * (CASE WHEN image_id % 2 = 0 THEN 300 ELSE 50 END) / 100.0, 6) AS x, round(h * 80 * 160 / 80.0, 6) AS h FROM fx_detections")
def resized_annotations(spark, sf):
    t = Tables(spark, sf)
    a = t["fx_detections"].select("image_id", "det_ord", F.array(F.col("x") * 100, F.col("y") * 80, F.col("w") * 100, F.col("h") * 80).alias("bbox"))
    i = t["fx_images"].select("image_id", F.lit(100).alias("width"), F.lit(80).alias("height"))
    new = t["fx_images"].select("image_id", F.when(F.col("image_id") % 2 == 0, 300).otherwise(50).alias("width"), F.lit(160).alias("height"))
    return crops.resized(a, i, new).select("image_id", "det_ord", F.round(F.col("bbox")[0], 6).alias("x"), F.round(F.col("bbox")[3], 6).alias("h"))


@query("image_sizes_filled", fx("fx_images") + " SELECT image_id, CAST(CASE image_id % 3 WHEN 0 THEN 640 WHEN 1 THEN CASE WHEN image_id % 5 <> 0 THEN 100 + location END ELSE CASE WHEN image_id % 5 <> 0 THEN 100 + location END END AS BIGINT) AS width FROM fx_images")
def image_sizes_filled(spark, sf):
    i = Tables(spark, sf)["fx_images"]
    w = F.when(F.col("image_id") % 3 == 0, 640).when(F.col("image_id") % 3 == 1, -1).cast("long")
    known = i.filter("image_id % 5 <> 0").select("image_id", (100 + F.col("location")).cast("long").alias("width"), F.lit(1).cast("long").alias("height"))
    return crops.with_sizes(i.select("image_id", w.alias("width"), F.when(F.col("image_id") % 3 == 0, 480).cast("long").alias("height")), known).select("image_id", "width")


@query("dated_names", "SELECT event_id, 'a_b_' || event_id || '.' || strftime(ts, '%Y-%m-%d-%H-%M-%S') || '.jpg' AS name, CASE WHEN event_id % 2 = 0 THEN 'https://new/x/' || event_id END AS url FROM events")
def dated_names(spark, sf):
    e = Tables(spark, sf)["events"]
    text = F.col("event_id").cast("string")
    name = paths.dated_name(F.concat(F.lit("a/b/"), text, F.lit(".jpg")), times.format_exif(F.col("ts")))
    url = F.concat(F.when(F.col("event_id") % 2 == 0, "https://old/a/").otherwise("https://other/a/"), text)
    return e.select("event_id", F.regexp_replace(name, r"^(.*)[._]([0-9-]{19})\.jpg$", "$1.$2.jpg").alias("name"), strings.other_base(url, "https://old/a/", "https://new/x/").alias("url"))


@query("insert_new_rows", "SELECT o_orderkey, o_custkey FROM orders")
def insert_new_rows(spark, sf):
    o = Tables(spark, sf)["orders"].select("o_orderkey", "o_custkey")
    return combine.insert_only(o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 2 = 0 or o_orderkey % 3 = 0"), "o_orderkey")


@query("classified_crops", fx("fx_images", "fx_detections") + f" SELECT {FILE} AS file, det_ord, CASE WHEN conf >= 0.5 THEN CASE WHEN conf >= 0.8 THEN '0' ELSE '1' END END AS best, CASE WHEN conf >= 0.5 THEN CASE WHEN conf >= 0.8 THEN conf ELSE 0.8 END END AS best_conf FROM fx_detections d JOIN fx_images i ON d.image_id = i.image_id")
def classified_crops(spark, sf):
    t = Tables(spark, sf)
    table = crops.crop_table(images(t).filter("failure is null"), 0.5)
    wide = table.select("crop_file", F.col("conf").alias("a"), F.lit(0.8).alias("b"))
    found = crops.class_lists(wide, ["a", "b"], ["crop_file"], 0.0, 2)
    out = crops.classes_to_detections(ordinary(t).select("file", "det_ord"), table, found, 1)
    one = F.col("classifications")[0]
    return out.select("file", "det_ord", one["id"].alias("best"), one["conf"].cast("double").alias("best_conf"))


TAXA = "WITH t AS (SELECT CAST(n_nationkey AS VARCHAR) AS taxon_id, lower('mammalia;' || r_name || ';f;' || n_name || ';' || CASE WHEN n_nationkey % 2 = 0 THEN 's' ELSE '' END) AS taxonomy, lower('the ' || n_name) AS common, lower(CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' s' ELSE '' END) AS binomial, lower(CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' s' ELSE n_name END) AS latin FROM nation JOIN region ON n_regionkey = r_regionkey)"


def taxa(t: Tables) -> DataFrame:
    rows = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat_ws(";", F.col("n_nationkey").cast("string"), F.lit("Mammalia"), "r_name", F.lit("F"), "n_name", F.when(F.col("n_nationkey") % 2 == 0, "S").otherwise(""), F.concat(F.lit("The "), F.col("n_name")))
    lines = rows.select(F.col("n_nationkey").alias("ord"), line.alias("line"))
    # a line that a later one with the same names replaces
    return taxonomy.load_taxa(lines.union(lines.select(F.col("ord") - 100, F.concat(F.lit("9"), F.col("line")))))


@query("taxa_of_lines", TAXA + " SELECT taxon_id, taxonomy, common, binomial, latin FROM t")
def taxa_of_lines(spark, sf):
    return taxa(Tables(spark, sf))


@query("names_resolved", TAXA + " SELECT CASE WHEN CAST(taxon_id AS INT) % 3 = 0 THEN taxonomy WHEN CAST(taxon_id AS INT) % 3 = 1 THEN ' ' || upper(common) WHEN binomial <> '' THEN binomial ELSE common END AS name, taxonomy FROM t")
def names_resolved(spark, sf):
    t = taxa(Tables(spark, sf))
    k = F.col("taxon_id").cast("int") % 3
    asked = F.when(k == 0, F.col("taxonomy")).when(k == 1, F.concat(F.lit(" "), F.upper("common"))).when(F.col("binomial") != "", F.col("binomial")).otherwise(F.col("common"))
    return taxonomy.resolved(t.select(asked.alias("name")), t)


@query("taxonomy_edges", "SELECT DISTINCT n_nationkey AS node_id, CAST(1000 + n_regionkey AS BIGINT) AS parent_id, n_name AS name FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_regionkey, n_name FROM nation)")
def taxonomy_edges(spark, sf):
    text = F.format_string("[(%s, 'genus', '%s', []), (%s, 'order', 'o', ['x', 'y'])]", F.col("n_nationkey").cast("string"), "n_name", (1000 + F.col("n_regionkey")).cast("string"))
    rows = Tables(spark, sf)["nation"].select(taxonomy.parse_entries(text).alias("e"))
    return rows.select(F.explode(taxonomy.edges(F.col("e"))).alias("p"), F.col("e")[0]["name"].alias("name")).select("p.node_id", "p.parent_id", "name")


@query("sequence_categories_collapsed", fx("fx_capture") + ", s AS (SELECT location, list(DISTINCT CASE category WHEN 'click' THEN 'empty' WHEN 'view' THEN 'animal' ELSE category END) AS c FROM fx_capture GROUP BY 1), n AS (SELECT location, CASE WHEN len(list_filter(c, lambda x: x <> 'empty')) > 0 THEN list_filter(c, lambda x: x <> 'empty') ELSE c END AS c FROM s) SELECT location, array_to_string(list_sort(CASE WHEN len(list_filter(c, lambda x: x <> 'animal')) > 0 THEN list_filter(c, lambda x: x <> 'animal') ELSE c END), ',') AS cats FROM n")
def sequence_categories_collapsed(spark, sf):
    name = F.when(F.col("category") == "click", "empty").when(F.col("category") == "view", "animal").otherwise(F.col("category"))
    sets = Tables(spark, sf)["fx_capture"].groupBy("location").agg(F.collect_set(name).alias("c"))
    return sets.select("location", F.array_join(F.array_sort(evaluate.collapsed(F.col("c"))), ",").alias("cats"))


@query("top_categories", fx("fx_images", "fx_detections") + " , r AS (SELECT image_id, CAST(category AS VARCHAR) AS c, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_ord) AS k FROM fx_detections WHERE conf > 0.4) SELECT i.image_id, coalesce(c, 'empty') AS category FROM fx_images i LEFT JOIN r ON i.image_id = r.image_id AND k = 1 WHERE failure IS NULL")
def top_categories(spark, sf):
    from fieldlens.plans.observation_queries import nested

    rows = nested(Tables(spark, sf)).filter("failure is null")
    return rows.select("image_id", evaluate.top_category(F.col("detections"), 0.4).alias("category"))


@query("sums_by_target", fx("fx_detections") + " SELECT image_id, det_ord, x + y AS places, w AS wide FROM fx_detections")
def sums_by_target(spark, sf):
    return cat.sum_by_target(Tables(spark, sf)["fx_detections"], {"places": ["x", "y"], "wide": ["w"]}, ["image_id", "det_ord"])


@query("targets_of_classes", "SELECT n_name AS class, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN r_name ELSE 'other' END AS target FROM nation JOIN region ON n_regionkey = r_regionkey")
def targets_of_classes(spark, sf):
    t = Tables(spark, sf)
    classes = t["nation"].select(F.col("n_name").alias("name"), F.array(F.col("n_nationkey").cast("long")).alias("nodes"))
    targets = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).filter("r_name in ('ASIA', 'EUROPE')").groupBy(F.col("r_name").alias("name")).agg(F.collect_set(F.col("n_nationkey").cast("long")).alias("nodes"))
    return cat.assigned_targets(classes, targets)


@query("geofence_adjustments", "SELECT 'panthera leo' AS \"from\", CASE n_regionkey % 2 WHEN 0 THEN 'panthera species' ELSE 'felidae family' END AS \"to\", count(*) AS n FROM nation WHERE n_nationkey % 3 <> 0 GROUP BY 2")
def geofence_adjustments(spark, sf):
    to = F.when(F.col("n_regionkey") % 2 == 0, "u;mammalia;carnivora;felidae;panthera;;").otherwise("u;mammalia;carnivora;felidae;;;")
    rows = Tables(spark, sf)["nation"].select(F.array(F.lit("u;mammalia;carnivora;felidae;panthera;leo;")).alias("classes"), to.alias("prediction"), F.when(F.col("n_nationkey") % 3 != 0, "classifier+geofence+x").otherwise("classifier").alias("prediction_source"))
    return evaluate.adjustments(rows)


MOTION = fx("fx_capture") + ", m AS (SELECT location, list({'id': image_id, 'v': conf * 100} ORDER BY captured_at, image_id) AS l FROM (SELECT * FROM fx_capture) GROUP BY 1)"


def motion_frames(t: Tables) -> DataFrame:
    return t["fx_capture"].select(F.col("location").alias("camera"), F.struct("captured_at", "image_id").alias("frame_number"), F.col("image_id").alias("id"), (F.col("conf") * 100).alias("value"))


@query("motion_history", MOTION + ", f AS (SELECT location AS camera, list_reduce(list_transform(l, lambda q: [{'id': q.id, 'h': q.v}]), lambda a, b: list_append(a, {'id': b[1].id, 'h': 0.5 * a[-1].h + b[1].h})) AS l FROM m) SELECT camera, u.id AS id, u.h AS history FROM (SELECT camera, unnest(l) AS u FROM f)")
def motion_history(spark, sf):
    return sequences.motion_history(motion_frames(Tables(spark, sf)), 0.5, motion="value").select("camera", "id", "history")


@query("motion_image", MOTION + ", f AS (SELECT location AS camera, list_reduce(list_transform(l, lambda q: [{'id': q.id, 'v': q.v, 'h': 0.0::FLOAT}]), lambda a, b: list_append(a, {'id': b[1].id, 'v': b[1].v, 'h': (CASE WHEN abs(b[1].v - a[-1].v) > 20 THEN 255 ELSE greatest(0::FLOAT, a[-1].h - 63.75::FLOAT) END)::FLOAT})) AS l FROM m) SELECT camera, u.id AS id, CAST(floor(u.h) AS INT) AS mhi FROM (SELECT camera, unnest(l) AS u FROM f)")
def motion_image(spark, sf):
    return sequences.motion_image(motion_frames(Tables(spark, sf)), 20, 4.0, keys=("camera",)).select("camera", "id", "mhi")


@query("previous_frames", fx("fx_capture") + " SELECT image_id, lag(conf) OVER (PARTITION BY location ORDER BY image_id) AS previous FROM fx_capture")
def previous_frames(spark, sf):
    return sequences.previous(Tables(spark, sf)["fx_capture"], "location", "image_id", "conf").select("image_id", "previous")


@query("sorted_lists", fx("fx_detections") + " SELECT image_id, list(conf ORDER BY det_ord) = list_sort(list(conf ORDER BY det_ord)) AS rising, array_to_string(list_transform(list({'a': conf, 'b': det_ord} ORDER BY conf, det_ord), lambda q: q.b), ',') AS by_conf FROM fx_detections GROUP BY 1")
def sorted_lists(spark, sf):
    g = Tables(spark, sf)["fx_detections"].groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("det_ord", "conf"))).alias("l"))
    m = F.map_from_arrays(F.transform("l", lambda q: q["det_ord"]), F.transform("l", lambda q: q["conf"]))
    keys = F.transform(evaluate.sorted_map(m, by_value=True), lambda e: e["key"])
    return g.select("image_id", numbers.is_sorted(F.transform("l", lambda q: q["conf"])).alias("rising"), F.array_join(keys, ",").alias("by_conf"))


@query("ordered_rows", fx("fx_images") + " SELECT image_id, failure, row_number() OVER (ORDER BY failure DESC NULLS LAST, image_id) AS r FROM fx_images QUALIFY r <= 100")
def ordered_rows(spark, sf):
    top = evaluate.ordered(Tables(spark, sf)["fx_images"].select(F.struct("failure", (-F.col("image_id")).alias("k")).alias("s"), "image_id", "failure"), "s", falling=True)
    return sampling.chunks_of(top.limit(100).withColumn("k", F.when(F.col("failure").isNull(), 10**9 + F.col("image_id")).otherwise(F.col("image_id"))), 1, "k").select("image_id", "failure", (F.col("chunk") + 1).cast("long").alias("r"))


@query("locations_by_size", fx("fx_images") + ", s AS (SELECT location, CASE WHEN location < 50 THEN 'a' ELSE 'b' END AS dataset, count(*) AS n FROM fx_images GROUP BY 1) SELECT location, dataset, n FROM s")
def locations_by_size(spark, sf):
    s = Tables(spark, sf)["fx_images"].groupBy("location").agg(F.when(F.col("location") < 50, "a").otherwise("b").alias("dataset"), F.count(F.lit(1)).alias("n"))
    return sampling.sorted_locations(s, ["b"]).select("location", "dataset", "n")


@query("images_per_second", "SELECT CAST(n_nationkey AS VARCHAR) AS device, r_name AS model, CAST((n_nationkey + 1) * (r_regionkey + 1) / 4.0 AS DOUBLE) AS images_per_second FROM nation, region")
def images_per_second(spark, sf):
    t = Tables(spark, sf)
    return evaluate.throughput(t["nation"].select(F.col("n_nationkey").cast("string").alias("device"), (F.col("n_nationkey") + 1).cast("double").alias("speed")), t["region"].select(F.col("r_name").alias("model"), ((F.col("r_regionkey") + 1) / 4.0).alias("factor")))


SCORES = fx("fx_detections") + ", s AS (SELECT image_id, det_ord, CAST(category - 1 AS INT) AS label, [conf / 2 + 0.05, (1 - conf) / 2 + 0.1, 0.3] AS p FROM fx_detections), r AS (SELECT *, len(list_filter(range(3), lambda i: p[i + 1] > p[label + 1] OR (p[i + 1] = p[label + 1] AND i < label))) AS above FROM s)"


def scored(t: Tables) -> DataFrame:
    return t["fx_detections"].select("image_id", "det_ord", (F.col("category") - 1).cast("int").alias("label"), F.array(F.col("conf") / 2 + 0.05, (1 - F.col("conf")) / 2 + 0.1, F.lit(0.3)).alias("scores"))


@query("rank_correct", SCORES + " SELECT image_id, det_ord, above < 2 AS correct FROM r")
def rank_correct(spark, sf):
    return scored(Tables(spark, sf)).select("image_id", "det_ord", evaluate.rank_correct(F.col("scores"), F.col("label"), 2).alias("correct"))


@query("epoch_metrics", SCORES + ", b AS (SELECT label, p[label + 1] AS own, above FROM r UNION ALL SELECT -1, p[label + 1], above FROM r) SELECT label, count(*) AS n, round(avg(-ln(own)), 9) AS loss, round(avg(CASE WHEN above < 1 THEN 1.0 ELSE 0.0 END), 9) AS top_1, round(avg(CASE WHEN above < 2 THEN 1.0 ELSE 0.0 END), 9) AS top_2 FROM b GROUP BY 1")
def epoch_metrics(spark, sf):
    out = evaluate.epoch_metrics(scored(Tables(spark, sf)), (1, 2))
    return out.select("label", "n", *[F.round(c, 9).alias(c) for c in ("loss", "top_1", "top_2")])


@query("model_versions", "SELECT n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'v5a' WHEN 1 THEN 'v4' WHEN 2 THEN 'v1000-cedar' ELSE 'unknown' END AS version, CASE n_nationkey % 4 WHEN 1 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS threshold FROM nation")
def model_versions(spark, sf):
    file = F.element_at(F.array(*map(F.lit, ("/m/md_V5A.0.0.pt", "x\\md_v4.1.0.pb", "md_v1000.0.0-cedar.pt v1000-cedar", "other.pt"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return Tables(spark, sf)["nation"].select(F.col("n_name").alias("name"), documents.model_version(file).alias("version"), documents.usual_threshold(F.lit(None).cast("string"), file).cast("double").alias("threshold"))


@query("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events")
def iso_times(spark, sf):
    return Tables(spark, sf)["events"].select("event_id", times.iso(F.col("ts")).alias("at"))


def words_as_detections(content: bytes) -> list[dict]:
    """A stand-in for a model: a detection for each line of a file; one without lines is an error."""
    lines = content.decode().splitlines()
    if not lines:
        raise ValueError("no lines")
    return [{"category": x, "conf": len(x) / 100, "bbox": [0.0, 0.0, 1.0, 1.0]} for x in lines]


@query("detector_stream", "SELECT n_name AS category, CAST(length(n_name) / 100.0 AS DOUBLE) AS conf, 0 AS failures FROM nation UNION ALL SELECT p_type, CAST(length(p_type) / 100.0 AS DOUBLE), 0 FROM part")
def detector_stream(spark, sf):
    t = Tables(spark, sf)
    folder, out, state = (scratch(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    t["nation"].select("n_name").union(t["part"].select("p_type")).repartition(5).write.text(folder)
    rows = streams.detector_rows(streams.file_stream(spark, f"{folder}/part-*", 2), words_as_detections)
    streams.append_to(rows, out, state).awaitTermination()
    found = spark.read.schema(rows.schema).parquet(out)
    failures = F.lit(0)
    return found.select(F.explode("detections").alias("d"), "failure").select("d.category", "d.conf", F.when(F.col("failure").isNull(), failures).otherwise(1).alias("failures"))


@query("detector_failures", "SELECT CAST(conv_id AS VARCHAR) || '/' || turn AS file, CASE WHEN turn % 4 = 0 THEN 'inference failed: ValueError' END AS failure, CASE WHEN turn % 4 <> 0 THEN 1 END AS n FROM conversations")
def detector_failures(spark, sf):
    c = Tables(spark, sf)["conversations"]
    files = c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.when(F.col("turn") % 4 == 0, F.lit("")).otherwise(F.col("role")).cast("binary").alias("content"))
    out = streams.detector_rows(files, words_as_detections)
    return out.select("file", "failure", F.when(F.col("failure").isNull(), F.size("detections")).alias("n"))


@query("video_results", "SELECT CAST(conv_id AS VARCHAR) AS video_id, role AS category, min(turn) AS frame_number, CAST(length(role) / 100.0 AS DOUBLE) AS conf FROM conversations WHERE role IS NOT NULL GROUP BY conv_id, role")
def video_results(spark, sf):
    c = Tables(spark, sf)["conversations"].filter("role is not null")
    frames = c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("frame_number"), F.col("role").cast("binary").alias("content"))
    return summary.video_results(frames, words_as_detections).select("video_id", "category", F.col("frame_number").cast(c.schema["turn"].dataType).alias("frame_number"), "conf")


REPORT = fx("fx_images", "fx_detections") + ", t AS (SELECT image_id, max(conf) AS m FROM fx_detections GROUP BY 1), e AS (SELECT i.image_id, failure, coalesce(m, 0.0) AS score, CASE WHEN i.image_id % 7 = 0 THEN NULL ELSE i.image_id % 3 = 0 END AS positive FROM fx_images i LEFT JOIN t USING (image_id)), s AS (SELECT * FROM e WHERE failure IS NULL AND positive IS NOT NULL)"


def batch(t: Tables) -> dict[str, DataFrame]:
    truth = t["fx_images"].select("image_id", F.when(F.col("image_id") % 7 != 0, F.col("image_id") % 3 == 0).alias("positive"))
    return summary.batch_report(t["fx_images"], t["fx_detections"], truth, 0.6, 0.4)


@query("batch_counts", REPORT + " SELECT count(*) AS images, count(failure) AS failed, count(*) FILTER (WHERE failure IS NULL AND score >= 0.6) AS positive, count(*) FILTER (WHERE failure IS NULL AND score >= 0.4 AND score < 0.6) AS almost FROM e")
def batch_counts(spark, sf):
    return batch(Tables(spark, sf))["counts"]


@query("batch_curve", REPORT + ", g AS (SELECT score AS threshold, count(*) AS n, count(*) FILTER (WHERE positive) AS tp FROM s GROUP BY 1), c AS (SELECT threshold, CAST(sum(tp) OVER o AS BIGINT) AS tp, CAST(sum(n) OVER o AS BIGINT) AS n FROM g WINDOW o AS (ORDER BY threshold DESC)) SELECT threshold, tp, n, tp / n AS precision, tp / (SELECT count(*) FROM s WHERE positive) AS recall FROM c")
def batch_curve(spark, sf):
    return batch(Tables(spark, sf))["curve"]


@query("batch_confusion", REPORT + ", c AS (SELECT count(*) FILTER (WHERE score > 0.6 AND positive) AS tp, count(*) FILTER (WHERE score > 0.6 AND NOT positive) AS fp, count(*) FILTER (WHERE score <= 0.6 AND positive) AS fn, count(*) FILTER (WHERE score <= 0.6 AND NOT positive) AS tn FROM s) SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1 FROM c")
def batch_confusion(spark, sf):
    return batch(Tables(spark, sf))["confusion"]


@query("result_links", "WITH f AS (SELECT n_name || '/' || p_partkey || CASE p_partkey % 2 WHEN 0 THEN '.json' ELSE '.csv' END AS file, n_name AS folder, p_partkey AS k FROM part JOIN nation ON p_partkey % 20 = n_nationkey) SELECT n_name AS folder, count(file) AS n, max(file) AS link FROM nation LEFT JOIN f ON folder = n_name AND k % 2 = 0 GROUP BY 1")
def result_links(spark, sf):
    t = Tables(spark, sf)
    files = t["part"].join(t["nation"], F.col("p_partkey") % 20 == F.col("n_nationkey")).select(F.concat(F.col("n_name"), F.lit("/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".json").otherwise(".csv")).alias("file"))
    return summary.result_links(t["nation"].select(F.col("n_name").alias("folder")), files)


@query("training_tables", "SELECT n_name AS name, CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey * 10 AS BIGINT) END AS labels, CASE WHEN n_nationkey % 5 <> 0 THEN CAST(0.25 AS DOUBLE) END AS r FROM nation")
def training_tables(spark, sf):
    row = F.format_string("   Class  Images  Labels  P  R  mAP@.5  mAP@.5:.95\n %s  100  %s  0.5  0.25  0.3  0.1\n", F.when(F.col("n_nationkey") % 5 != 0, "all").otherwise("some"), (F.col("n_nationkey") * 10).cast("string"))
    s = evaluate.category_stats(row)
    return Tables(spark, sf)["nation"].select(F.col("n_name").alias("name"), s["labels"].alias("labels"), s["r"].alias("r"))


@query("gray_fractions", fx("fx_detections") + " SELECT image_id, count(*) FILTER (WHERE round(x * 20) = round(y * 20) AND round(y * 20) = category) / count(*) AS gray FROM fx_detections GROUP BY 1")
def gray_fractions(spark, sf):
    d = Tables(spark, sf)["fx_detections"]
    pixels = d.groupBy("image_id").agg(F.collect_list(F.struct(F.round(F.col("x") * 20).alias("r"), F.round(F.col("y") * 20).alias("g"), F.col("category").cast("double").alias("b"))).alias("p"))
    return pixels.select("image_id", evaluate.gray_fraction(F.col("p")).alias("gray"))


@query("update_payloads", fx("fx_scored") + " SELECT doc_id, 'p1' AS project_id, 'blank' AS prediction, 'manual_update' AS source FROM fx_scored")
def update_payloads(spark, sf):
    text = Tables(spark, sf)["fx_scored"].select("doc_id", sinks.payload("doc_id", "p1", F.lit("blank")).alias("json"))
    return text.select("doc_id", *[F.get_json_object("json", f"$.{k}").alias(v) for k, v in (("project_id", "project_id"), ("prediction", "prediction"), ("prediction_source", "source"))])
