"""Queries through readers and writers: tables are written in a format, read again, and compared with themselves by the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.functions import paths, times
from fieldlens.model import max_conf
from fieldlens.operators import categories as cat
from fieldlens.plans.fixtures import Tables, fx
from fieldlens.plans.observation_queries import nested
from fieldlens.plans.registry import query
from fieldlens.sources import documents, formats, sinks
from fieldlens.sources.scratch import scratch

FILE = "'loc' || location || '/img' || i.image_id || '.jpg'"
NAMES = {"1": "animal", "2": "person", "3": "vehicle"}
#: Sides of the images in pixels.
WIDTH, HEIGHT = 1000, 800
#: So many image ids at most share a document of a cache, however many images there are.
BATCH = 1000


def images(t: Tables, *more: str) -> DataFrame:
    """location, file, failure, detections (category, conf, bbox), as results have them; more columns come first."""
    plain = F.transform("detections", lambda d: F.struct(d["category"].alias("category"), d["conf"].alias("conf"), d["bbox"].alias("bbox")))
    return nested(t).select(*more, "location", "file", "failure", plain.alias("detections"))


def boxes(rows: DataFrame) -> DataFrame:
    """file, category, conf, x, y, w, h of all detections."""
    d = rows.select("file", F.explode("detections").alias("d"))
    return d.select("file", "d.category", "d.conf", *[F.col("d.bbox")[k].alias(c) for k, c in enumerate("xywh")])


def sized(t: Tables) -> DataFrame:
    return images(t).withColumns({"width": F.lit(WIDTH), "height": F.lit(HEIGHT)})


def ordinary(t: Tables) -> DataFrame:
    """Rows of detections in pixels: image_id, file, det_ord, category, conf, x, y, w, h."""
    i = t["fx_images"].select("image_id", F.concat(F.lit("loc"), F.col("location").cast("string"), F.lit("/img"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("file"))
    return t["fx_detections"].join(i, "image_id")


def written(rows: DataFrame, name: str) -> str:
    """Where the column value of rows was written as lines of text."""
    path = scratch(rows.sparkSession, name)
    rows.select("value").write.text(path)
    return path


def results(spark: SparkSession, sf: str) -> DataFrame:
    """The images, written as one results document for each location and read again."""
    lines = sinks.document_lines(images(Tables(spark, sf)), "location", {"format_version": "1.5", "detector": "some_v5a.0.0"}, NAMES)
    return documents.read_results(spark, written(lines, "results"), per_line=True)


ALL = fx("fx_images", "fx_detections") + f", b AS (SELECT {FILE} AS file, d.*, CAST(category AS VARCHAR) AS cat FROM fx_detections d JOIN fx_images i ON d.image_id = i.image_id WHERE failure IS NULL)"


@query("results_documents", ALL + " SELECT file, cat AS category, conf, x, y, w, h FROM b")
def results_documents(spark, sf):
    return boxes(documents.image_table(results(spark, sf)))


@query("results_image_table", ALL + f", m AS (SELECT image_id, max(conf) AS m FROM b GROUP BY 1) SELECT replace({FILE}, 'loc', 'site') AS file, failure, coalesce(m, 0.0) AS max_detection_conf, '1.5' AS version, '0.2' AS threshold FROM fx_images i LEFT JOIN m USING (image_id)")
def results_image_table(spark, sf):
    rows = documents.image_table(results(spark, sf), [("loc", "site")])
    usual = documents.usual_threshold(F.lit(None).cast("string"), F.col("info.detector")).cast("string")
    return rows.select("file", "failure", "max_detection_conf", F.col("info.format_version").alias("version"), usual.alias("threshold"))


@query("results_lines", ALL + f", m AS (SELECT image_id, count(*) AS n, max(conf) AS top FROM b GROUP BY 1) SELECT {FILE} AS file, failure, n, top FROM fx_images i LEFT JOIN m USING (image_id)")
def results_lines(spark, sf):
    path = scratch(spark, "lines")
    sinks.write_lines(images(Tables(spark, sf)), path)
    rows = spark.read.schema("file string, failure string, detections array<struct<category:string,conf:double,bbox:array<double>>>").json(path)
    return rows.select("file", "failure", F.nullif(F.size("detections").cast("long"), F.lit(0).cast("long")).alias("n"), F.get("detections", F.lit(0))["conf"].alias("top")).withColumn("n", F.when(F.col("n") > 0, F.col("n")))


@query("predictions_documents", ALL + f" SELECT file, cat AS category, conf, round(x, 5) AS x, round(y, 5) AS y, round(w, 5) AS w, round(h, 5) AS h, CASE category WHEN 1 THEN 'animal' WHEN 2 THEN 'person' ELSE 'vehicle' END AS label FROM b UNION ALL SELECT {FILE}, NULL, NULL, NULL, NULL, NULL, NULL, 'Failure: DETECTOR' FROM fx_images i WHERE failure IS NOT NULL")
def predictions_documents(spark, sf):
    rows = documents.predictions_from_images(images(Tables(spark, sf)))
    lines = rows.groupBy(paths.dirname(F.col("filepath")).alias("k")).agg(F.collect_list(F.struct("filepath", "failures", "detections")).alias("predictions"))
    read = documents.image_table(documents.read_results(spark, written(lines.select(F.to_json(F.struct("predictions")).alias("value")), "predictions"), per_line=True))
    found = boxes(read).withColumn("label", cat.lookup(documents.DETECTION_NAMES)[F.col("category")])
    none = [F.lit(None).cast(k).alias(c) for c, k in found.dtypes[1:-1]]
    return found.union(read.filter("failure is not null").select("file", *none, "failure"))


@query("results_csv", ALL + " SELECT file, cat AS category, conf, x, y, (x + w) - x AS w, (y + h) - y AS h, max(conf) OVER (PARTITION BY file) AS max_confidence FROM b")
def results_csv(spark, sf):
    path = scratch(spark, "csv")
    sinks.csv_table(images(Tables(spark, sf)), NAMES).select("image_path", "max_confidence", "detections").write.csv(path, header=True, escape='"')
    rows = documents.read_results_csv(spark, path)
    return boxes(rows).join(rows.select("file", "max_confidence"), "file")


@query("csv_category_columns", ALL + f", m AS (SELECT image_id, max(conf) AS m, max(conf) FILTER (WHERE category = 1 AND conf >= 0.4) AS a, max(conf) FILTER (WHERE category = 3 AND conf >= 0.4) AS v FROM b GROUP BY 1) SELECT {FILE} AS image_path, coalesce(m, 0.0) AS max_confidence, coalesce(a, 0.0) AS max_conf_animal, coalesce(v, 0.0) AS max_conf_vehicle FROM fx_images i LEFT JOIN m USING (image_id)")
def csv_category_columns(spark, sf):
    return sinks.csv_table(images(Tables(spark, sf)), NAMES, 0.4).select("image_path", "max_confidence", "max_conf_animal", "max_conf_vehicle")


@query("checkpoint_remaining", fx("fx_images") + f" SELECT {FILE} AS file FROM fx_images i WHERE location % 3 = 0")
def checkpoint_remaining(spark, sf):
    rows = images(Tables(spark, sf))
    done = rows.filter("location % 3 <> 0").groupBy("location").agg(F.collect_list(F.struct("file", "failure", "detections")).alias("checkpoint"))
    read = documents.read_checkpoint(spark, written(done.select(F.to_json(F.struct("checkpoint")).alias("value")), "checkpoint"), per_line=True)
    return documents.remaining(rows.select("file"), read)


@query("merged_documents", ALL + " SELECT file, count(*) AS n, max(conf) AS max_conf FROM b GROUP BY 1")
def merged_documents(spark, sf):
    """Two caches, each of documents of a bounded size, written in one pass and merged."""
    key = F.struct((F.col("location") % 2).alias("part"), F.floor(F.col("image_id") / BATCH).alias("batch"))
    rows = images(Tables(spark, sf), "image_id").withColumn("key", key).drop("image_id", "location")
    path = scratch(spark, "caches")
    sinks.document_lines(rows, "key", {"format_version": "1.5"}, NAMES).select("key.part", "value").write.partitionBy("part").text(path, compression="lz4")
    return documents.merge_caches(spark, path, per_line=True).filter(F.size("detections") > 0).select("file", F.size("detections").cast("long").alias("n"), max_conf(F.col("detections")).alias("max_conf"))


def annotation_db(spark: SparkSession, sf: str) -> documents.AnnotationDb:
    """The detections as an annotation database of one document for each location."""
    t = Tables(spark, sf)
    i = t["fx_images"].select("image_id", "location")
    d = t["fx_detections"].select("image_id", F.array(*[F.col(c) * side for c, side in zip("xywh", (WIDTH, HEIGHT) * 2, strict=True)]).alias("bbox"), F.col("category").cast("int").alias("category_id"), "conf", "det_ord")
    a = d.join(i, "image_id").groupBy("location").agg(F.collect_list(F.struct(F.concat_ws("-", "image_id", "det_ord").alias("id"), F.col("image_id").cast("string").alias("image_id"), "category_id", "bbox", F.col("conf").alias("score"))).alias("annotations"))
    p = i.groupBy("location").agg(F.collect_list(F.struct(F.col("image_id").cast("string").alias("id"), F.concat(F.lit("Loc"), F.col("location").cast("string"), F.lit("/img"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.col("location").cast("string").alias("location"))).alias("images"))
    kinds = F.array(*[F.struct(F.lit(int(k)).alias("id"), F.lit(v.title()).alias("name")) for k, v in NAMES.items()]).alias("categories")
    lines = p.join(a, "location", "left").select(F.to_json(F.struct("images", F.coalesce("annotations", F.array().cast(a.schema["annotations"].dataType)).alias("annotations"), kinds)).alias("value"))
    return documents.AnnotationDb(spark, written(lines, "annotations"), per_line=True)


@query("db_annotations_of_images", fx("fx_images", "fx_detections") + f" SELECT CAST(i.image_id AS VARCHAR) AS id, count(d.det_ord) AS n, CAST(sum(CAST(round(d.x * {WIDTH}) AS BIGINT)) AS BIGINT) AS sum_x, count(DISTINCT category) AS kinds FROM fx_images i LEFT JOIN fx_detections d USING (image_id) GROUP BY 1")
def db_annotations_of_images(spark, sf):
    a = annotation_db(spark, sf).annotations_of_images()
    xs = F.aggregate("annotations", F.lit(0).cast("long"), lambda s, x: s + F.round(x["bbox"][0]).cast("long"))
    return a.select("id", F.size("annotations").cast("long").alias("n"), F.when(F.size("annotations") > 0, xs).alias("sum_x"), F.size(F.array_distinct(F.transform("annotations", lambda x: x["category_id"]))).cast("long").alias("kinds"))


@query("db_classes_of_images", fx("fx_images", "fx_detections") + " SELECT CAST(i.image_id AS VARCHAR) AS id, coalesce(string_agg(DISTINCT CASE category WHEN 1 THEN 'animal' WHEN 2 THEN 'person' WHEN 3 THEN 'vehicle' END, ',' ORDER BY CASE category WHEN 1 THEN 'animal' WHEN 2 THEN 'person' WHEN 3 THEN 'vehicle' END), '') AS classes FROM fx_images i LEFT JOIN fx_detections d USING (image_id) GROUP BY 1")
def db_classes_of_images(spark, sf):
    return annotation_db(spark, sf).classes_of_images().select("id", F.array_join("classes", ",").alias("classes"))


@query("db_subset", fx("fx_images", "fx_detections") + " SELECT CAST(i.image_id AS VARCHAR) AS image_id, category AS category_id, conf AS score FROM fx_images i JOIN fx_detections d USING (image_id) WHERE contains('loc' || location || '/img' || i.image_id, 'loc1')")
def db_subset(spark, sf):
    return annotation_db(spark, sf).subset("LOC1", ignore_case=True)[1].select("image_id", F.col("category_id").cast("long").alias("category_id"), "score")


@query("db_locations", fx("fx_images", "fx_detections") + " SELECT CAST(location AS VARCHAR) AS location, count(DISTINCT i.image_id) AS images, count(d.det_ord) AS annotations FROM fx_images i LEFT JOIN fx_detections d USING (image_id) WHERE location IN (3, 7, 100) GROUP BY 1")
def db_locations(spark, sf):
    i, a = annotation_db(spark, sf).for_locations(["3", "7", "100"])
    n = a.groupBy(F.col("image_id").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    return i.join(n, "id", "left").groupBy("location").agg(F.count(F.lit(1)).alias("images"), F.coalesce(F.sum("k"), F.lit(0)).alias("annotations"))


@query("db_detections", fx("fx_images", "fx_detections") + f" SELECT 'Loc' || location || '/img' || i.image_id || '.jpg' AS file, CAST(category AS VARCHAR) AS category, conf, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM fx_images i JOIN fx_detections d USING (image_id)")
def db_detections(spark, sf):
    db = annotation_db(spark, sf)
    rows = boxes(sinks.detections_from_annotations(db.images, db.annotations))
    return rows.withColumns({c: F.round(c, 6) for c in "xywh"})


@query("annotation_rows", ALL + f" SELECT sha256(file) AS image_id, category AS category_id, round(x * {WIDTH}, 3) AS x, round(y * {HEIGHT}, 3) AS y, round(w * {WIDTH}, 3) AS w, round(h * {HEIGHT}, 3) AS h, conf AS score FROM b WHERE conf >= 0.3")
def annotation_rows(spark, sf):
    rows = sinks.annotation_rows(sized(Tables(spark, sf)), 0.3, NAMES)
    return rows.select("image_id", F.col("category_id").cast("long").alias("category_id"), *[F.col("bbox")[k].alias(c) for k, c in enumerate("xywh")], "score")


LINES = ALL + """, c AS (SELECT file, det_ord, category, conf, greatest(x, 0.0) AS x0, greatest(y, 0.0) AS y0, least(x + w, 1.0) AS x1, least(y + h, 1.0) AS y1 FROM b),
 l AS (SELECT file, category, row_number() OVER (PARTITION BY file ORDER BY det_ord) AS line_no, round(x0 + (x1 - x0) / 2, 6) AS xc, round(y0 + (y1 - y0) / 2, 6) AS yc, round(x1 - x0, 6) AS w, round(y1 - y0, 6) AS h FROM c WHERE x1 > x0 AND y1 > y0)"""


def label_text(spark: SparkSession, sf: str) -> DataFrame:
    """file, line_no, line of the detections' label lines, written and read again."""
    text = sinks.label_lines(images(Tables(spark, sf)), {"1": 0, "2": 1, "3": 2})
    path = scratch(spark, "labels")
    text.write.json(path)
    rows = spark.read.schema("file string, text string").json(path)
    return rows.select("file", F.posexplode(F.split("text", "\n")).alias("n", "line")).filter("line <> ''").select("file", (F.col("n") + 1).cast("long").alias("line_no"), "line")


@query("label_lines", LINES + " SELECT file, line_no, CAST(category - 1 AS INT) AS class, xc, yc, w, h FROM l")
def label_lines(spark, sf):
    parts = F.split("line", " ")
    return label_text(spark, sf).select("file", "line_no", parts[0].cast("int").alias("class"), *[parts[k + 1].cast("double").alias(c) for k, c in enumerate(("xc", "yc", "w", "h"))])


@query("label_lines_to_detections", LINES + " SELECT file, CAST(category AS VARCHAR) AS category, CAST(1 AS DOUBLE) AS conf, round(xc - w / 2, 5) AS x, round(yc - h / 2, 5) AS y, w, h FROM l")
def label_lines_to_detections(spark, sf):
    return boxes(formats.from_label_lines(label_text(spark, sf))).withColumn("x", F.round("x", 5)).withColumn("y", F.round("y", 5))


@query("label_lines_to_annotations", LINES + f" SELECT file, line_no, CAST(category - 1 AS INT) AS category_id, CAST(round((xc - w / 2) * {WIDTH}, 2) AS DOUBLE) AS x, round(w * {WIDTH}, 2) AS w FROM l")
def label_lines_to_annotations(spark, sf):
    sizes = sized(Tables(spark, sf)).select("file", "width", "height")
    a = formats.annotations_from_lines(label_text(spark, sf), sizes)[1]
    return a.select("file", "line_no", "category_id", F.round(F.col("bbox")[0], 2).alias("x"), F.round(F.col("bbox")[2], 2).alias("w"))


@query("label_lines_valid", LINES + " SELECT file, count(*) AS n FROM l GROUP BY 1")
def label_lines_valid(spark, sf):
    return label_text(spark, sf).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("class_list", "SELECT CAST(row_number() OVER (ORDER BY n_name) - 1 AS INT) AS id, n_name AS name FROM nation")
def class_list(spark, sf):
    names = [r["n_name"] for r in Tables(spark, sf)["nation"].select("n_name").orderBy("n_name").collect()]  # a model's classes
    text = spark.createDataFrame([(sinks.dataset_yaml("/data", names, "train", "val"),)], "text string")
    return text.select(F.explode(formats.label_classes(F.col("text"))).alias("id", "name"))


SHAPES = ALL + f", s AS (SELECT file, cat, round(x * {WIDTH}) AS x0, round(y * {HEIGHT}) AS y0, round(round(x * {WIDTH}) + w * {WIDTH}) AS x1, round(round(y * {HEIGHT}) + h * {HEIGHT}) AS y1 FROM b WHERE conf >= 0.5)"


def drawn(spark: SparkSession, sf: str) -> DataFrame:
    """file, width, height, shapes of the confident detections, written as JSON and read again."""
    text = sinks.shapes(sized(Tables(spark, sf)).filter("failure is null"), NAMES, 0.5)
    read = spark.read.schema("shapes array<struct<label:string,shape_type:string,points:array<array<double>>>>, imagePath string, imageWidth int, imageHeight int").json(written(text.select(F.col("json").alias("value")), "shapes"))
    return read.select(F.col("imagePath").alias("file"), F.col("imageWidth").alias("width"), F.col("imageHeight").alias("height"), "shapes")


@query("shapes_to_boxes", SHAPES + f" SELECT file, CASE cat WHEN '1' THEN 'animal' WHEN '2' THEN 'person' ELSE 'vehicle' END AS name, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM s UNION ALL SELECT {FILE}, 'empty', NULL, NULL, NULL, NULL FROM fx_images i WHERE failure IS NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.image_id = i.image_id AND conf >= 0.5)")
def shapes_to_boxes(spark, sf):
    return formats.from_shapes(drawn(spark, sf)).select("file", "name", *[F.col("bbox")[k].alias(c) for k, c in enumerate("xywh")])


@query("shape_states", SHAPES + f" SELECT {FILE} AS file, CASE WHEN failure IS NOT NULL THEN 'no_json' WHEN EXISTS (SELECT 1 FROM b WHERE b.image_id = i.image_id AND conf >= 0.5) THEN 'shapes' ELSE 'empty' END AS state FROM fx_images i")
def shape_states(spark, sf):
    return formats.shape_states(images(Tables(spark, sf)), drawn(spark, sf))


@query("lines_from_shapes", SHAPES + f""", r AS (SELECT file, cat, x0, y0, greatest(x0, 0) / {WIDTH - 1}.0 AS a, least(x1, {WIDTH - 1}) / {WIDTH - 1}.0 AS b, greatest(y0, 0) / {HEIGHT - 1}.0 AS c, least(y1, {HEIGHT - 1}) / {HEIGHT - 1}.0 AS d FROM s WHERE x0 <= {WIDTH - 1} AND y0 <= {HEIGHT - 1})
 SELECT file, count(*) AS n, CAST(sum(CAST(cat AS BIGINT)) AS BIGINT) AS classes, round(sum(b - a), 1) AS widths FROM r GROUP BY 1""")
def lines_from_shapes(spark, sf):
    rows = formats.lines_from_shapes(drawn(spark, sf), {v: int(k) for k, v in NAMES.items()}).filter("text <> ''")
    parts = rows.select("file", F.explode(F.split("text", "\n")).alias("line")).select("file", F.split("line", " ").alias("p"))
    return parts.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("p")[0].cast("long")).alias("classes"), F.round(F.sum(F.col("p")[3].cast("double")), 1).alias("widths"))


CLASSES = fx("fx_images", "fx_classes") + ", k AS (SELECT c.*, c.image_id * 10 + c.det_ord AS row_no FROM fx_classes c), o AS (SELECT class_name, min(row_no) AS first FROM k GROUP BY 1), n AS (SELECT class_name, CAST(row_number() OVER (ORDER BY first) - 1 AS VARCHAR) AS id FROM o)"


def class_rows(t: Tables) -> DataFrame:
    d = ordinary(t).withColumn("row_no", F.col("image_id") * 10 + F.col("det_ord"))
    c = t["fx_classes"].select("image_id", "det_ord", F.col("class_name").alias("class"), F.col("class_conf").alias("classification_conf"))
    return d.join(c, ["image_id", "det_ord"]).withColumnsRenamed({"conf": "detection_conf", "x": "bbox1", "y": "bbox2", "w": "bbox3", "h": "bbox4"})


@query("classes_first_seen", CLASSES + " SELECT class_name AS class, id FROM n")
def classes_first_seen(spark, sf):
    return cat.first_seen(class_rows(Tables(spark, sf)), "class", "row_no")


@query("detection_rows_to_images", CLASSES + f" SELECT {FILE} AS file, CAST(d.category AS VARCHAR) AS category, d.conf, d.x, n.id AS class_id, k.class_conf FROM k JOIN n USING (class_name) JOIN fx_detections d ON d.image_id = k.image_id AND d.det_ord = k.det_ord JOIN fx_images i ON i.image_id = k.image_id")
def detection_rows_to_images(spark, sf):
    d = formats.from_rows(class_rows(Tables(spark, sf))).select("file", F.explode("detections").alias("d"))
    return d.select("file", "d.category", "d.conf", F.col("d.bbox")[0].alias("x"), F.col("d.classifications")[0]["id"].alias("class_id"), F.col("d.classifications")[0]["conf"].alias("class_conf"))


@query("wide_labels_to_detections", ALL + " , v AS (SELECT file, max(conf) AS a, min(conf) AS z FROM b GROUP BY 1) SELECT file, category, conf FROM (SELECT file, 'best' AS category, a AS conf FROM v UNION ALL SELECT file, 'least', z FROM v)")
def wide_labels_to_detections(spark, sf):
    b = boxes(images(Tables(spark, sf)))
    v = b.groupBy("file").agg(F.lit("best").alias("top_1_label"), F.max("conf").alias("top_1_probability"), F.lit("least").alias("top_2_label"), F.min("conf").alias("top_2_probability"))
    return boxes(formats.from_wide(v)).select("file", "category", "conf")


@query("wide_images_to_detections", ALL + f" SELECT file, '1' AS category, conf, x, w, CASE WHEN conf >= x THEN 'p' ELSE 'q' END AS best FROM (SELECT file, conf, round(x, 6) AS x, round(w, 6) AS w FROM b)")
def wide_images_to_detections(spark, sf):
    d = ordinary(Tables(spark, sf)).withColumn("row_no", F.col("det_ord"))
    wide = d.select("file", "row_no", (F.col("x") * WIDTH).alias("x1"), (F.col("y") * HEIGHT).alias("y1"), (F.col("x") * WIDTH + F.col("w") * WIDTH).alias("x2"), (F.col("y") * HEIGHT + F.col("h") * HEIGHT).alias("y2"), "conf", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.col("conf").alias("p"), F.round("x", 6).alias("q"))
    d = formats.from_wide(wide, ["p", "q"], 1, -1.0).select("file", F.explode("detections").alias("d"))
    names = F.col("d.classifications")[0]["id"]
    return d.select("file", "d.category", "d.conf", F.round(F.col("d.bbox")[0], 6).alias("x"), F.round(F.col("d.bbox")[2], 6).alias("w"), F.when(names.isin("0", "p"), "p").otherwise("q").alias("best"))


@query("flat_detections_to_images", ALL + f" SELECT {FILE} AS file, i.failure, count(b.det_ord) AS n, coalesce(round(sum(round(b.x, 4)), 6), 0.0) AS xs, max(round(b.conf, 3)) AS top FROM fx_images i LEFT JOIN b USING (image_id) GROUP BY 1, 2")
def flat_detections_to_images(spark, sf):
    t = Tables(spark, sf)
    i = t["fx_images"].select("image_id", F.concat(F.lit("loc"), F.col("location").cast("string"), F.lit("/img"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("file"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
    d = t["fx_detections"].select("image_id", (F.col("category") - 1).cast("int").alias("category_id"), F.array(F.col("x") * WIDTH, F.col("y") * HEIGHT, F.col("w") * WIDTH, F.col("h") * HEIGHT).alias("bbox"), F.col("conf").alias("score"))
    failed = t["fx_images"].filter("failure is not null").select("image_id", F.lit(-1).alias("category_id"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(0.0).alias("score"))
    out = formats.from_flat_detections(d.union(failed), i)
    xs = F.aggregate("detections", F.lit(0.0), lambda s, x: s + x["bbox"][0])
    return out.select("file", "failure", F.coalesce(F.size("detections"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.round(xs, 6), F.lit(0.0)).alias("xs"), F.array_max(F.transform("detections", lambda x: x["conf"])).alias("top")).withColumn("n", F.greatest("n", F.lit(0).cast("long")))


@query("classes_attached_by_name", fx("fx_images", "fx_classes") + f" SELECT {FILE} AS file, d.det_ord, c.class_name AS class FROM fx_detections d JOIN fx_images i ON d.image_id = i.image_id LEFT JOIN fx_classes c ON c.image_id = d.image_id AND c.det_ord = d.det_ord AND c.class_conf >= 0.5")
def classes_attached_by_name(spark, sf):
    t = Tables(spark, sf)
    d = ordinary(t).select("file", "image_id", "det_ord")
    c = d.join(t["fx_classes"].filter("class_conf >= 0.5"), ["image_id", "det_ord"])
    rows = c.select(F.concat(F.lit("/mnt/"), F.regexp_replace("file", r"\.jpg$", ""), F.lit("-"), F.col("det_ord").cast("string"), F.lit(".jpg")).alias("filename"), F.col("class_name").alias("class"), F.col("class_conf").alias("conf"))
    out = formats.attached_classes(d.drop("image_id"), rows, "/mnt/")
    return out.select("file", "det_ord", F.col("classifications")[0]["id"].alias("class"))


PACKAGE = fx("fx_capture") + ", m AS (SELECT image_id, location, captured_at, date_trunc('hour', captured_at) AS hour, category FROM fx_capture), e AS (SELECT *, location || '-' || strftime(hour, '%Y%m%d%H') AS event FROM m)"


def package(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of a camera-trap package: an event is an hour of a location, observed by its captures' categories."""
    m = Tables(spark, sf)["fx_capture"].withColumn("event", F.concat_ws("-", "location", F.date_format("captured_at", "yyyyMMddHH")))
    deployments = m.select(F.col("location").cast("string").alias("deploymentID"), F.concat(F.lit("place "), F.col("location").cast("string")).alias("locationID")).distinct()
    media = m.select(F.col("image_id").alias("mediaID"), F.col("location").cast("string").alias("deploymentID"), F.lit("data").alias("filePath"), F.concat(F.col("image_id").cast("string"), F.lit(".jpg")).alias("fileName"), F.col("captured_at").alias("timestamp"))
    events = m.select(F.col("event").alias("eventID"), F.col("image_id").alias("mediaID"))
    observations = m.select(F.col("event").alias("eventID"), F.lit("event").alias("observationLevel"), F.when(F.col("category") == "click", "blank").otherwise("animal").alias("observationType"), F.when(F.col("category") != "click", F.initcap("category")).alias("scientificName"))
    return formats.from_events(deployments, media, events, observations)


@query("package_images", PACKAGE + " SELECT image_id AS id, 'data/' || image_id || '.jpg' AS file_name, 'place ' || location AS location, event AS seq_id, row_number() OVER (PARTITION BY event ORDER BY captured_at, image_id) - 1 AS frame_num, count(*) OVER (PARTITION BY event) AS seq_num_frames FROM e")
def package_images(spark, sf):
    return package(spark, sf)[0].drop("datetime").withColumn("frame_num", F.col("frame_num").cast("long"))


@query("package_annotations", PACKAGE + ", l AS (SELECT DISTINCT event, CASE WHEN category = 'click' THEN 'empty' ELSE lower(category) END AS name FROM e) SELECT image_id, name, true AS sequence_level_annotation FROM e JOIN l USING (event)")
def package_annotations(spark, sf):
    return package(spark, sf)[1]


EXPORT = fx("fx_images", "fx_classes") + ", r AS (SELECT image_id, split_part(class_name, ' ', 1) AS g, split_part(class_name, ' ', 2) AS s, class_conf FROM fx_classes)"


@query("project_export", EXPORT + ", n AS (SELECT DISTINCT image_id, CASE WHEN class_conf < 0.1 THEN 'blank' WHEN s = '' THEN lower(g) WHEN class_conf < 0.5 THEN 'made of ' || lower(s) ELSE lower(g || ' ' || s) END AS name FROM r) SELECT image_id, name FROM n WHERE name <> 'blank' OR image_id NOT IN (SELECT image_id FROM n WHERE name <> 'blank')")
def project_export(spark, sf):
    t = Tables(spark, sf)
    words = F.split("class_name", " ")
    rows = t["fx_classes"].join(t["fx_images"], "image_id").select("image_id", "location", F.col("location").alias("deployment_id"), F.lit("s").alias("sequence_id"), F.col("captured_at").alias("timestamp"), F.when(F.col("class_conf") < 0.5, F.concat(F.lit("Made of "), F.get(words, F.lit(1)))).otherwise(" ").alias("common_name"), F.get(words, F.lit(0)).alias("genus"), F.get(words, F.lit(1)).alias("species"), *[F.lit("").alias(c) for c in ("family", "order", "class", "wi_taxon_id")], F.when(F.col("class_conf") < 0.1, 1).otherwise(0).alias("is_blank"))
    return formats.from_export(rows)[1]


@query("csv_bundle", "SELECT CAST(o_custkey AS VARCHAR) AS customer, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS keys FROM orders GROUP BY 1")
def csv_bundle(spark, sf):
    folder = scratch(spark, "bundle")
    Tables(spark, sf)["orders"].select(F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderkey").cast("string").alias("key")).write.csv(folder, header=True)
    rows = documents.bundle(spark, folder, "part-", "customer", "customer string, key string")
    return rows.select("customer", F.size("records").cast("long").alias("n"), F.array_join(F.array_sort(F.transform("records", lambda r: r["key"])), ",").alias("keys"))


@query("csv_table", "SELECT o_orderkey, o_custkey, o_totalprice, nullif(o_orderstatus, '') AS o_orderstatus FROM orders")
def csv_table(spark, sf):
    path = scratch(spark, "table")
    Tables(spark, sf)["orders"].select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus").write.csv(path, header=True, escape='"')
    schema = Tables(spark, sf)["orders"].select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus").schema
    return documents.read_csv(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))


NAMED = "SELECT 'd' || o_custkey % 7 || '/f' || o_orderkey || CASE o_orderkey % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.mp4' WHEN 3 THEN '.AVI' ELSE '.txt' END AS file, o_orderkey AS length FROM orders"


def named(t: Tables) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, (".JPG", ".png", ".mp4", ".AVI", ".txt"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return t["orders"].select(F.concat(F.lit("d"), (F.col("o_custkey") % 7).cast("string"), F.lit("/f"), F.col("o_orderkey").cast("string"), ext).alias("file"), F.col("o_orderkey").alias("length"))


@query("file_list", f"SELECT file FROM ({NAMED})")
def file_list(spark, sf):
    rows = named(Tables(spark, sf))
    lines = rows.groupBy(paths.dirname(F.col("file"))).agg(F.to_json(F.collect_list("file")).alias("value")).repartition(7)
    return documents.read_list(spark, written(lines, "list"), per_line=True)


@query("folder_summary", f"SELECT lower(regexp_extract(file, '\\.[a-zA-Z0-9]+$')) AS ext, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM ({NAMED}) GROUP BY 1")
def folder_summary(spark, sf):
    return documents.folder_summary(named(Tables(spark, sf)))


@query("images_and_videos", f"SELECT file, CASE WHEN regexp_matches(lower(file), '(jpg|png)$') THEN 'image' ELSE 'video' END AS kind FROM ({NAMED}) WHERE NOT ends_with(file, '.txt')")
def images_and_videos(spark, sf):
    rows = named(Tables(spark, sf))
    return documents.only_images(rows).select("file", F.lit("image").alias("kind")).union(documents.only_videos(rows).select("file", F.lit("video").alias("kind")))


@query("folders_of_files", f"SELECT DISTINCT split_part(file, '/', 1) AS folder FROM ({NAMED})")
def folders_of_files(spark, sf):
    return documents.folders(named(Tables(spark, sf)))


@query("instances", f"SELECT replace(file, 'd1/', 'x/') AS filepath, 'KEN' AS country, CAST(1.5 AS DOUBLE) AS latitude, CAST(37 AS DOUBLE) AS longitude FROM ({NAMED}) WHERE regexp_matches(lower(file), '(jpg|png)$') AND NOT contains(file, '99')")
def instances(spark, sf):
    return formats.instances(named(Tables(spark, sf)), country="KEN", lat=1.5, lon=37.0, ignore=("99",), replacements=[("d1/", "x/")])


@query("upload_deployments", fx("fx_images") + " SELECT 'p1' AS project_id, location AS deployment_id, CAST(min(captured_at) AS VARCHAR) AS start_date, CAST(max(captured_at) AS VARCHAR) AS end_date FROM fx_images GROUP BY 2")
def upload_deployments(spark, sf):
    rows = Tables(spark, sf)["fx_images"].select(F.col("image_id").alias("file"), "location", "captured_at", F.lit("x").alias("name"))
    out = sinks.upload_tables(rows, "p1")["deployments"]
    return out.withColumns({c: F.col(c).cast("string") for c in ("start_date", "end_date")})


@query("update_messages", fx("fx_scored") + " SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN 'prediction form' ELSE '' END AS errors FROM fx_scored")
def update_messages(spark, sf):
    rows = Tables(spark, sf)["fx_scored"].select(F.col("doc_id").cast("string").alias("id"))
    text = rows.withColumn("json", sinks.payload("id", "p1", F.when(F.col("id").cast("long") % 3 == 0, "animal").otherwise("u;mammalia;carnivora;felidae;panthera;leo;lion")))
    return text.select("id", F.array_join(sinks.payload_errors(F.col("json")), ",").alias("errors"))


@query("label_specification", "SELECT r_name AS target, 'row' AS kind, lower(n_name) AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def label_specification(spark, sf):
    t = Tables(spark, sf)
    rows = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("target")).agg(F.lit("row").alias("type"), F.array_join(F.collect_list("n_name"), " , ").alias("content"))
    return formats.labels_from_spec(rows)


@query("sequence_labels", "SELECT CAST(conv_id AS VARCHAR) AS seq_id, 'c' AS dataset, turn AS file, CASE WHEN role = 'user' THEN role ELSE 'all' END AS class FROM conversations")
def sequence_labels(spark, sf):
    rows = Tables(spark, sf)["conversations"].groupBy(F.col("conv_id").cast("string").alias("seq_id")).agg(F.lit("c").alias("dataset"), F.lit("all").alias("class"), F.collect_list(F.struct(F.col("turn").alias("file"), F.when(F.col("role") == "user", F.col("role")).alias("class"))).alias("images"))
    return formats.sequence_labels(rows)


@query("training_crops", ALL + ", c AS (SELECT 'loc' || location AS location, conf AS confidence, CASE WHEN location % 2 = 0 THEN 'even' ELSE 'odd' END AS label, b.file FROM b JOIN fx_images i ON b.image_id = i.image_id WHERE conf >= 0.7 AND cat = '1' AND location NOT IN (1, 4)) SELECT label, location, count(*) AS n, max(confidence) AS top FROM c GROUP BY ALL")
def training_crops(spark, sf):
    t = Tables(spark, sf)
    i = images(t).select("file", F.lit("d").alias("dataset"), F.concat(F.lit("loc"), F.col("location").cast("string")).alias("location"), F.when(F.col("location") % 2 == 0, "even").otherwise("odd").alias("label"))
    d = ordinary(t).select("file", "det_ord", F.col("category").cast("string").alias("category"), "conf")
    out = spark.createDataFrame([("d", "loc1"), ("d", "loc4")], "dataset string, location string")
    return formats.crop_dataset(i, d, 0.7, excluded=out).groupBy("label", "location").agg(F.countDistinct("crop").alias("n"), F.max("confidence").alias("top"))


@query("named_taxa", fx("fx_images", "fx_detections") + " SELECT DISTINCT CAST(image_id AS VARCHAR) AS image_id, 'set:' || CASE category WHEN 1 THEN 'animal' WHEN 2 THEN 'person' ELSE 'vehicle' END AS query, category * 10 AS taxon FROM fx_detections")
def named_taxa(spark, sf):
    db = annotation_db(spark, sf)
    taxa = spark.createDataFrame([(f"set:{v}", int(k) * 10) for k, v in NAMES.items()], "query string, taxon long")
    return formats.denormalised(db.images, db.annotations, db.categories, taxa, "Set").select("image_id", "query", "taxon")


@query("images_from_exif", "SELECT 'img_' || event_id || '.jpg' AS id, 'img ' || event_id || '.jpg' AS file_name, 'unknown' AS location, CASE WHEN event_id % 4 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS taken FROM events")
def images_from_exif(spark, sf):
    e = Tables(spark, sf)["events"]
    taken = F.when(F.col("event_id") % 4 == 0, "0000:00:00 00:00:00").otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    rows = e.select(F.concat(F.lit("img "), F.col("event_id").cast("string"), F.lit(".jpg")).alias("file"), F.lit(1).alias("width"), F.lit(1).alias("height"), taken.alias("taken"))
    out = formats.images_from_exif(rows, F.lit("2100-01-01").cast("timestamp"))
    return out.select("id", "file_name", "location", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("taken"))


@query("capture_times", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def capture_times(spark, sf):
    e = Tables(spark, sf)["events"]
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    return e.select("event_id", F.date_format(times.parse_any(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("pages_of_rows", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS BIGINT) AS page FROM orders")
def pages_of_rows(spark, sf):
    return sinks.paged(Tables(spark, sf)["orders"].select("o_orderkey"), "o_orderkey", 100).withColumn("page", F.col("page").cast("long"))
