"""Writers: results documents, tables as CSV, annotation databases, label lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens import model
from fieldlens.functions.numbers import round_to
from fieldlens.functions import paths
from fieldlens.functions.geometry import corner_to_center, to_pixels, to_relative


def ready_images(images: DataFrame, base: str = "", include_max: bool = False) -> DataFrame:
    """Images as results documents have them: relative names, detections in falling confidence, null ones with a failure."""
    name = paths.forward(F.col("file"))
    name = F.replace(name, F.lit(base.rstrip("/") + "/"), F.lit("")) if base else name
    dets = F.when(F.col("failure").isNull(), model.by_conf(F.col("detections")))
    out = images.withColumn("file", name).withColumn("detections", dets)
    return out.withColumn("max_detection_conf", model.max_conf(F.col("detections"))) if include_max else out


def documents(images: DataFrame, info: dict[str, str], categories: dict[str, str], classes: dict[str, str] | None = None) -> DataFrame:
    """file, json: each image as a JSON text with the pairs that documents have for classifications.

    The images of a document are an unbounded list, so the data go out as one JSON
    line per image, in order of file; write_document() frames small ones.
    """
    dets = F.transform("detections", lambda d: d.withField("classifications", F.transform(d["classifications"], lambda c: F.array(c["id"], c["conf"].cast("string")))) if _has(images, "classifications") else d)
    cols = [c for c in images.columns if c != "detections"]
    return images.select("file", F.to_json(F.struct(*cols, dets.alias("detections"))).alias("json"))


def _has(images: DataFrame, field: str) -> bool:
    return field in images.schema["detections"].dataType.elementType.fieldNames()


def write_lines(images: DataFrame, path: str) -> None:
    """One JSON line per image, in files that are ordered by name."""
    ready_images(images).repartitionByRange("file").sortWithinPartitions("file").write.mode("overwrite").json(path, ignoreNullFields=True)


def document_lines(images: DataFrame, key: str, info: dict[str, str], categories: dict[str, str]) -> DataFrame:
    """key, value: a results document for each value of key (a folder, a camera, a batch of images), as one line. A set of any size goes out in parallel, but a task holds a document whole."""
    def texts(given: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for kv in given.items() for x in kv])

    body = ready_images(images).select(key, F.struct(*[c for c in images.columns if c != key]).alias("i"))
    # sorted by name; names are distinct
    by_name = body.groupBy(key).agg(F.array_agg(F.struct(F.col("i.file").alias("k"), "i")).alias("l"))
    ordered = F.transform(F.array_sort("l", lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)), lambda x: x["i"])
    return by_name.select(key, F.to_json(F.struct(texts(info).alias("info"), texts(categories).alias("detection_categories"), ordered.alias("images"))).alias("value"))


def write_document(images: DataFrame, path: str, info: dict[str, str], categories: dict[str, str], classes: dict[str, str] | None = None) -> None:
    """One results document. For sets that fit a single JSON file, as its readers need them to."""
    spark = images.sparkSession
    body = ready_images(images).orderBy("file")
    rows = documents(body, info, categories, classes).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "json"))), lambda x: x["json"]), ",").alias("i"))
    maps = spark.range(1).select(F.to_json(F.create_map(*[F.lit(x) for kv in info.items() for x in kv])).alias("info"), F.to_json(F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])).alias("cats"), (F.to_json(F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])) if classes else F.lit(None).cast("string")).alias("classes"))
    parts = [F.lit('{"info":'), F.col("info"), F.lit(',"detection_categories":'), F.col("cats"), F.coalesce(F.concat(F.lit(',"classification_categories":'), F.col("classes")), F.lit("")), F.lit(',"images":['), F.col("i"), F.lit("]}")]
    rows.join(F.broadcast(maps)).select(F.concat(*parts).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def csv_table(images: DataFrame, categories: dict[str, str], min_conf: float | None = None) -> DataFrame:
    """image_path, max_confidence, detections (JSON of [ymin, xmin, ymax, xmax, conf, class]) and a max_conf_ column per category."""
    box = F.transform("detections", lambda d: F.array(d["bbox"][1], d["bbox"][0], d["bbox"][1] + d["bbox"][3], d["bbox"][0] + d["bbox"][2], d["conf"], d["category"].cast("double")))
    text = F.coalesce(F.col("failure"), F.to_json(box))

    def top(c: str) -> Column:
        own = F.filter("detections", lambda d: (d["category"] == c) & ((d["conf"] >= min_conf) if min_conf is not None else F.lit(True)))
        return model.max_conf(own).alias(f"max_conf_{categories[c]}")

    return images.select(F.col("file").alias("image_path"), model.max_conf(F.col("detections")).alias("max_confidence"), text.alias("detections"), *[top(c) for c in categories])


def annotation_rows(images: DataFrame, conf: float, names: dict[str, str], unknown: str = "error") -> DataFrame:
    """image_id, category_id, bbox in pixels, score for detections at or above a confidence. images: file, width, height, detections."""
    d = images.select("file", "width", "height", F.explode("detections").alias("d")).filter(F.col("d.conf") >= conf)
    known = F.col("d.category").isin(list(names))
    if unknown == "ignore":
        d = d.filter(known)
    cat = F.col("d.category").cast("int") if unknown == "ignore" else F.when(known, F.col("d.category").cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown category "), F.col("d.category"))).cast("int"))
    return d.select(F.sha2("file", 256).alias("image_id"), cat.alias("category_id"), F.transform(to_pixels(F.col("d.bbox"), F.col("width"), F.col("height")), lambda v: round_to(v, 3)).alias("bbox"), F.col("d.conf").alias("score"))


def detections_from_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """file, detections (relative) of annotated images; the confidence is score, else conf, else 1."""
    j = annotations.filter("bbox is not null").join(images.select(F.col("id").alias("image_id"), "file_name", "width", "height"), "image_id")
    d = j.select("file_name", F.struct(F.col("id").alias("_o"), F.col("category_id").cast("string").alias("category"), F.coalesce("score", "conf", F.lit(1.0)).alias("conf"), to_relative(F.col("bbox"), F.col("width"), F.col("height")).alias("bbox")).alias("d"))
    g = d.groupBy("file_name").agg(F.array_sort(F.collect_list("d")).alias("l"))
    out = images.select("file_name").join(g, "file_name", "left")
    lists = F.transform("l", lambda x: F.struct(x["category"].alias("category"), x["conf"].alias("conf"), x["bbox"].alias("bbox")))
    return out.select(F.col("file_name").alias("file"), F.coalesce(lists, F.array().cast("array<struct<category:string,conf:double,bbox:array<double>>>")).alias("detections"))


def label_lines(images: DataFrame, classes: dict[str, int]) -> DataFrame:
    """file, text of label lines (class xc yc w h, clipped to the image)."""
    from fieldlens.operators.categories import lookup

    ids = lookup({k: str(v) for k, v in classes.items()})

    def line(d: Column) -> Column:
        b = d["bbox"]
        x0, y0 = F.greatest(b[0], F.lit(0.0)), F.greatest(b[1], F.lit(0.0))
        x1, y1 = F.least(b[0] + b[2], F.lit(1.0)), F.least(b[1] + b[3], F.lit(1.0))
        c = corner_to_center(F.array(x0, y0, x1 - x0, y1 - y0))
        return F.when((x1 > x0) & (y1 > y0), F.format_string("%s %.6f %.6f %.6f %.6f", ids[d["category"]], c[0], c[1], c[2], c[3]))

    return images.select("file", F.array_join(F.array_compact(F.transform("detections", line)), "\n").alias("text"))


def shapes(images: DataFrame, names: dict[str, str], conf: float = -1.0) -> DataFrame:
    """file, json of drawn rectangles in pixels for detections at or above a confidence; far corners start from rounded near ones."""
    from fieldlens.operators.categories import lookup

    def shape(d: Column) -> Column:
        b = d["bbox"]
        x0, y0 = F.round(b[0] * F.col("width")), F.round(b[1] * F.col("height"))
        return F.struct(lookup(names)[d["category"]].alias("label"), F.array(F.array(x0, y0), F.array(F.round(x0 + b[2] * F.col("width")), F.round(y0 + b[3] * F.col("height")))).alias("points"), F.lit("rectangle").alias("shape_type"))

    rows = F.transform(F.filter("detections", lambda d: d["conf"] >= conf), shape)
    return images.select("file", F.to_json(F.struct(rows.alias("shapes"), F.col("file").alias("imagePath"), F.col("width").alias("imageWidth"), F.col("height").alias("imageHeight"))).alias("json"))


def payload(row_id: str, project: str, prediction: Column, score: float = 0.9, version: str = "1", source: str = "manual_update") -> Column:
    """A platform's update message as JSON."""
    return F.to_json(F.struct(F.col(row_id).alias("data_file_id"), F.lit(project).alias("project_id"), prediction.alias("prediction"), F.lit(score).alias("prediction_score"), F.lit(version).alias("model_version"), F.lit(source).alias("prediction_source")))


def paged(rows: DataFrame, order: str, size: int) -> DataFrame:
    """rows with a page number, for listings."""
    from fieldlens.operators.sampling import chunks_of

    return chunks_of(rows, size, order).withColumnRenamed("chunk", "page")


def dataset_yaml(base: str, classes: list[str], train: str | None = None, val: str | None = None, test: str | None = None) -> str:
    """A training set's description as YAML."""
    lines = [f"path: {base}"] + [f"{k}: {v}" for k, v in (("train", train), ("val", val), ("test", test)) if v]
    return "\n".join([*lines, "names:", *[f"  {i}: {c}" for i, c in enumerate(classes)]]) + "\n"


def upload_tables(images: DataFrame, project: str) -> dict[str, DataFrame]:
    """The tables of a platform upload: projects, cameras, deployments, images. images: file, location, captured_at, name."""
    loc = images.groupBy("location").agg(F.min("captured_at").alias("start_date"), F.max("captured_at").alias("end_date"))
    return {
        "projects": images.sparkSession.range(1).select(F.lit(project).alias("project_id")),
        "cameras": loc.select(F.lit(project).alias("project_id"), F.col("location").alias("camera_id")),
        "deployments": loc.select(F.lit(project).alias("project_id"), F.col("location").alias("deployment_id"), "start_date", "end_date"),
        "images": images.select(F.lit(project).alias("project_id"), F.col("location").alias("deployment_id"), F.col("file").alias("image_id"), F.col("captured_at").alias("timestamp"), F.col("name").alias("common_name")),
    }


def payload_errors(payload_json: Column) -> Column:
    """What an update message lacks, as a list."""
    p = F.from_json(payload_json, "data_file_id string, project_id string, prediction string, prediction_score double, model_version string, prediction_source string")
    return F.array_compact(F.array(*[F.when(p[c].isNull(), c) for c in ("data_file_id", "project_id", "prediction", "prediction_source")], F.when(~p["prediction_score"].between(0, 1), "prediction_score range"), F.when(F.size(F.split(p["prediction"], ";")) != 7, "prediction form")))
