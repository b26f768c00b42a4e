"""Other formats to image and detection tables, each a composition of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions.geometry import center_to_corner, corners_to_size, to_relative
from fieldlens.functions.numbers import round_to
from fieldlens.operators.categories import first_seen


def grouped(rows: DataFrame, file: str, order: str, *cols: str) -> DataFrame:
    """file, detections: rows of a detection each, in their order."""
    lists = rows.groupBy(F.col(file).alias("file")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *cols))).alias("l"))
    return lists.select("file", F.transform("l", lambda x: F.struct(*[x[c].alias(c) for c in cols])).alias("detections"))


def from_rows(rows: DataFrame) -> DataFrame:
    """Detection rows (row_no, file, category, detection_conf, bbox1..4, class, classification_conf) to images; class ids as first seen."""
    ids = first_seen(rows.filter("class is not null"), "class", "row_no").withColumnRenamed("id", "class_id")
    j = rows.join(ids, "class", "left")
    cls = F.when(F.col("class_id").isNotNull(), F.array(F.struct(F.col("class_id").alias("id"), F.col("classification_conf").alias("conf"))))
    d = j.select("file", "row_no", F.col("category").cast("string").alias("category"), F.col("detection_conf").alias("conf"), F.array(*[F.col(f"bbox{i}") for i in range(1, 5)]).alias("bbox"), cls.alias("classifications"))
    return grouped(d, "file", "row_no", "category", "conf", "bbox", "classifications")


def from_wide_images(rows: DataFrame, classes: list[str], top: int, least: float) -> DataFrame:
    """Rows of a box in pixels (file, row_no, x1, y1, x2, y2, conf, width, height) and class probabilities to images with the best classes."""
    from fieldlens.operators.crops import class_lists

    box = to_relative(corners_to_size(F.array("x1", "y1", "x2", "y2")), F.col("width"), F.col("height"))
    d = class_lists(rows.withColumn("bbox", box).withColumn("category", F.lit("1")), classes, ["file", "row_no", "category", "conf", "bbox"], least, top)
    return grouped(d, "file", "row_no", "category", "conf", "bbox", "classifications")


def from_ranked_labels(rows: DataFrame, k: int) -> DataFrame:
    """Videos with columns top_1_label, top_1_probability, ... to full-frame detections."""
    pairs = F.array(*[F.struct(F.lit(i).alias("o"), F.col(f"top_{i}_label").alias("category"), F.col(f"top_{i}_probability").alias("conf")) for i in range(1, k + 1)])
    d = rows.select("file", F.explode(pairs).alias("p")).select("file", "p.*").withColumn("bbox", F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))))
    return grouped(d, "file", "o", "category", "conf", "bbox")


def from_flat_detections(dets: DataFrame, images: DataFrame, offset: int = 1) -> DataFrame:
    """Flat detections in pixels (image_id, category_id, bbox, score) to every image (image_id, file, width, height); a negative category marks a failed one."""
    failed = dets.filter("category_id < 0").select("image_id").distinct().withColumn("failure", F.lit("inference failed"))
    ok = dets.filter("category_id >= 0").join(images, "image_id")
    box = F.transform(to_relative(F.col("bbox"), F.col("width"), F.col("height")), lambda v: round_to(v, 4))
    rows = ok.select("file", (-F.col("score")).alias("_k"), (F.col("category_id") + offset).cast("string").alias("category"), round_to(F.col("score"), 3).alias("conf"), box.alias("bbox"))
    lists = grouped(rows, "file", "_k", "category", "conf", "bbox")
    out = images.join(failed, "image_id", "left").join(lists, "file", "left")
    empty = F.array().cast(lists.schema["detections"].dataType)
    return out.select("file", "failure", F.when(F.col("failure").isNull(), F.coalesce("detections", empty)).alias("detections"))


def from_label_lines(lines: DataFrame, offset: int = 1) -> DataFrame:
    """Text lines (file, line_no, line: class xc yc w h [conf], all relative) to images."""
    t = F.split(F.trim("line"), r"\s+")
    num = F.transform(F.slice(t, 2, 4), lambda x: x.cast("double"))
    d = lines.filter(~F.col("line").startswith("#") & (F.trim("line") != "")).select("file", "line_no", (t[0].cast("int") + offset).cast("string").alias("category"), F.coalesce(F.get(t, F.lit(5)).cast("double"), F.lit(1.0)).alias("conf"), center_to_corner(num).alias("bbox"))
    return grouped(d, "file", "line_no", "category", "conf", "bbox")


def label_classes(text: Column) -> Column:
    """A class list (lines, or names of a YAML mapping or list) as id to name."""
    names = F.regexp_extract(text, r"(?s)names:\s*\n(.*)", 1)
    body = F.when(names != "", names).otherwise(text)
    lines = F.filter(F.split(body, r"\r?\n"), lambda s: F.trim(s) != "")
    clean = F.transform(lines, lambda s: F.trim(F.regexp_replace(s, r"^\s*(-|\d+\s*:)\s*", "")))
    return F.map_from_arrays(F.transform(clean, lambda _, i: i), clean)


def from_shapes(rows: DataFrame) -> DataFrame:
    """Drawn shapes (file, width, height, shapes: array<struct<label, shape_type, points>>) to boxes in pixels; images without shapes are empty."""
    s = rows.select("file", "width", "height", F.posexplode_outer("shapes").alias("ord", "s"))
    xs, ys = F.transform("s.points", lambda p: p[0]), F.transform("s.points", lambda p: p[1])
    box = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    return s.select("file", "ord", F.coalesce("s.label", F.lit("empty")).alias("name"), F.when(F.col("s").isNotNull(), box).alias("bbox"))


def shape_states(images: DataFrame, shapes: DataFrame) -> DataFrame:
    """file, state: no_json, empty or shapes."""
    j = images.select("file").join(shapes.select("file", F.size("shapes").alias("k")), "file", "left")
    return j.select("file", F.when(F.col("k").isNull(), "no_json").when(F.col("k") <= 0, "empty").otherwise("shapes").alias("state"))


def from_events(deployments: DataFrame, media: DataFrame, events: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Camera-trap package tables to (images, annotations): event-level observations go to all media of their event."""
    m = media.join(deployments.select("deploymentID", "locationID"), "deploymentID", "left")
    pairs = m.join(events, "mediaID")
    by = Window.partitionBy("eventID").orderBy("timestamp", "mediaID")
    images = pairs.select(F.col("mediaID").alias("id"), F.concat_ws("/", "filePath", "fileName").alias("file_name"), F.col("locationID").alias("location"), F.col("timestamp").alias("datetime"), F.col("eventID").alias("seq_id"), (F.row_number().over(by) - 1).alias("frame_num"), F.count(F.lit(1)).over(Window.partitionBy("eventID")).alias("seq_num_frames"))
    name = F.when(F.col("observationType") == "blank", "empty").when(F.col("scientificName").isNotNull(), F.lower("scientificName")).otherwise(F.lower("observationType"))
    labels = observations.filter("observationLevel = 'event'").select("eventID", name.alias("name")).distinct()
    annotations = pairs.join(labels, "eventID").select(F.col("mediaID").alias("image_id"), "name", F.lit(True).alias("sequence_level_annotation"))
    return images, annotations


#: Name columns of an export, most specific first.
EXPORT_NAMES = ("common_name", "binomial", "genus", "family", "order", "class", "wi_taxon_id")


def from_export(rows: DataFrame, remap: list[tuple[str, str]] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of a project export (image_id, sequence_id, location, timestamp, names..., is_blank) to (images, annotations). remap: ordered patterns."""
    r = rows.withColumn("binomial", F.when(F.trim("species") != "", F.concat_ws(" ", "genus", "species")))
    name = F.lower(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in EXPORT_NAMES]))
    for pattern, to in remap:
        name = F.when(name.rlike(pattern), to).otherwise(name)
    named = r.withColumn("name", F.when(F.col("is_blank") == 1, "blank").otherwise(name))
    images = named.groupBy(F.col("image_id").alias("id")).agg(F.first("location").alias("file_name"), F.min("timestamp").alias("datetime"), F.first("deployment_id").alias("location"), F.first("sequence_id").alias("seq_id"))
    labels = named.select("image_id", "name").distinct()
    marked = labels.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("image_id"))).filter("name <> 'blank' or k = 1").drop("k")
    return images, marked


def attached_classes(detections: DataFrame, rows: DataFrame, mount: str = "") -> DataFrame:
    """detections (file, det_ord) with (class, conf) rows whose name is <mount><stem>-<det_ord>.<ext>."""
    name = F.regexp_replace("filename", f"^{mount}", "") if mount else F.col("filename")
    keyed = rows.select(F.regexp_extract(name, r"^(.*)-\d+(\.[^.]*)$", 1).alias("stem"), F.regexp_extract(name, r"-(\d+)\.[^.]*$", 1).try_cast("long").alias("det_ord"), "class", "conf")
    lists = keyed.filter("det_ord is not null").groupBy("stem", "det_ord").agg(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("k"), "class", "conf"))).alias("c"))
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    j = detections.withColumn("stem", stem).join(lists, ["stem", "det_ord"], "left")
    return j.withColumn("classifications", F.transform("c", lambda x: F.struct(x["class"].alias("id"), x["conf"].alias("conf")))).drop("stem", "c")


def denormalised(images: DataFrame, annotations: DataFrame, categories: DataFrame, taxa: DataFrame, dataset: str) -> DataFrame:
    """image_id, name and taxonomy columns of each distinct category of each image; taxa: query (dataset:label), ..."""
    key = F.lower(F.concat(F.lit(f"{dataset}:"), F.col("name")))
    j = images.select(F.col("id").alias("image_id"), "location").join(annotations, "image_id").join(F.broadcast(categories.withColumnRenamed("id", "category_id")), "category_id")
    return j.withColumn("query", key).join(taxa, "query").dropDuplicates(["image_id", "category_id"])


def from_wide(rows: DataFrame, classes: list[str] | None = None, top: int = 5, least: float = 0.0) -> DataFrame:
    """A classifier's table of either kind, by its columns: ranked labels of videos, or boxes with class probabilities."""
    ranked = [c for c in rows.columns if c.startswith("top_") and c.endswith("_label")]
    if ranked:
        return from_ranked_labels(rows, len(ranked))
    fixed = ["file", "row_no", "x1", "y1", "x2", "y2", "conf", "width", "height"]
    return from_wide_images(rows, classes or [c for c in rows.columns if c not in fixed], top, least)


def annotations_from_lines(lines: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Label lines and images (file, width, height; -1 where unreadable) to (images with error, annotations in pixels)."""
    from fieldlens.functions.geometry import to_pixels

    t = F.split(F.trim("line"), r"\s+")
    num = F.transform(F.slice(t, 2, 4), lambda x: x.cast("double"))
    ok = lines.filter(~F.col("line").startswith("#") & (F.trim("line") != "")).join(images.filter("width > 0"), "file")
    boxes = ok.select("file", "line_no", t[0].cast("int").alias("category_id"), to_pixels(center_to_corner(num), F.col("width"), F.col("height")).alias("bbox"))
    return images.withColumn("error", F.when(F.col("width") <= 0, "unreadable image")), boxes


def lines_from_shapes(rows: DataFrame, ids: dict[str, int]) -> DataFrame:
    """Rectangles (file, width, height, shapes) to label lines with three decimals: clipped to the last pixel, relative to size - 1; those outside are left out."""
    from fieldlens.operators.categories import lookup

    names = lookup({k: str(v) for k, v in ids.items()})
    w, h = F.col("width") - 1.0, F.col("height") - 1.0

    def line(s: Column) -> Column:
        xs, ys = F.transform(s["points"], lambda p: p[0]), F.transform(s["points"], lambda p: p[1])
        x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
        inside = (x1 >= 0) & (y1 >= 0) & (x0 <= w) & (y0 <= h) & (s["shape_type"] == "rectangle")
        a, b, c, d = F.greatest(x0, F.lit(0.0)) / w, F.least(x1, w) / w, F.greatest(y0, F.lit(0.0)) / h, F.least(y1, h) / h
        return F.when(inside, F.format_string("%s %.3f %.3f %.3f %.3f", names[s["label"]], (a + b) / 2, (c + d) / 2, b - a, d - c))

    return rows.select("file", F.array_join(F.array_compact(F.transform("shapes", line)), "\n").alias("text"))


def sequence_labels(sequences: DataFrame, where: Column | None = None) -> DataFrame:
    """One row per image of sequences (seq_id, dataset, class, images: array<struct<file, class>>): the image's class, else its sequence's."""
    rows = sequences.select("seq_id", "dataset", F.col("class").alias("seq_class"), F.explode("images").alias("i"))
    out = rows.select("seq_id", "dataset", "i.file", F.coalesce("i.class", "seq_class").alias("class"))
    return out if where is None else out.filter(where)


def crop_dataset(images: DataFrame, detections: DataFrame, conf: float, category: str = "1", least_locations: int | None = None, excluded: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """crop, dataset, location, label, confidence of training crops: confident detections of a category in labelled images (file, dataset, location, label)."""
    from fieldlens.functions.paths import crop_name
    from fieldlens.operators.filters import enough_locations

    rows = images.join(detections.filter((F.col("conf") >= conf) & (F.col("category") == category)), "file")
    rows = rows.select("dataset", "location", "label", F.col("conf").alias("confidence"), crop_name(F.col("file"), F.col("det_ord")).alias("crop"))
    if existing is not None:
        rows = rows.join(existing.select("crop").distinct(), "crop", "left_semi")
    if excluded is not None:
        rows = rows.join(excluded.select("dataset", "location").distinct(), ["dataset", "location"], "left_anti")
    return enough_locations(rows, least_locations) if least_locations else rows


def labels_from_spec(rows: DataFrame) -> DataFrame:
    """target, kind, value of a label specification as lines (target, type, content: values joined by commas)."""
    return rows.select("target", F.col("type").alias("kind"), F.explode(F.transform(F.split("content", ","), lambda v: F.lower(F.trim(v)))).alias("value")).filter("value <> ''")


def images_from_exif(rows: DataFrame, as_of: Column, first_year: int = 1990, location: Column | None = None) -> DataFrame:
    """Annotation-database images from camera tags (file, width, height, taken): no time if it is implausible, unknown location by default."""
    from fieldlens.functions.times import parse_exif, trusted

    return rows.select(F.translate("file", " ", "_").alias("id"), F.col("file").alias("file_name"), "width", "height", (F.lit("unknown") if location is None else location).alias("location"), trusted(parse_exif(F.col("taken")), as_of, first_year).alias("datetime"))


def instances(files: DataFrame, country: str | None = None, region: str | None = None, lat: float | None = None, lon: float | None = None, ignore: tuple[str, ...] = ("$RECYCLE.BIN",), replacements: list[tuple[str, str]] = ()) -> DataFrame:
    """filepath and where it is, for images of a listing (file)."""
    from fieldlens.functions.paths import is_image

    if (lat is None) != (lon is None):
        raise ValueError("latitude and longitude go together")
    name = F.col("file")
    for old, new in replacements:
        name = F.replace(name, F.lit(old), F.lit(new))
    out = files.filter(is_image(F.col("file")))
    for t in ignore:
        out = out.filter(~F.col("file").contains(t))
    given = {"country": country, "admin1_region": region, "latitude": lat, "longitude": lon}
    return out.select(name.alias("filepath"), *[F.lit(v).alias(k) for k, v in given.items() if v is not None])
