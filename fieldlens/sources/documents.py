"""Readers of results documents, annotation databases and listings.

Schemas are declared, never inferred: ids are strings that look like integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens import model
from fieldlens.functions.numbers import round_to
from fieldlens.functions import paths
from fieldlens.operators.taxonomy import parse_geofence

PREDICTIONS = (
    "predictions array<struct<filepath:string,failures:array<string>,detections:array<struct<category:string,label:string,conf:double,bbox:array<double>>>,"
    "classifications:struct<classes:array<string>,scores:array<double>>,prediction:string,prediction_score:double,prediction_source:string>>"
)
COCO = (
    "info map<string,string>, images array<struct<id:string,file_name:string,width:int,height:int,location:string,datetime:string,seq_id:string,frame_num:int,seq_num_frames:int>>, "
    "annotations array<struct<id:string,image_id:string,category_id:int,bbox:array<double>,score:double,conf:double,sequence_level_annotation:boolean>>, "
    "categories array<struct<id:int,name:string>>"
)
#: Detection categories of predictions.
DETECTION_NAMES = {"1": "animal", "2": "person", "3": "vehicle"}


def whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, source: one row per file."""
    return spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("source"))


def texts(spark: SparkSession, path: str | list[str], per_line: bool = False) -> DataFrame:
    """value, source: one row per file, or (per_line) one per line, which splits large files among tasks."""
    return spark.read.text(path).select("value", F.input_file_name().alias("source")) if per_line else whole_files(spark, path)


def read_results(spark: SparkSession, path: str | list[str], per_line: bool = False) -> DataFrame:
    """Documents of either kind (results, or predictions), one row per document, columns as model.RAW_DOCUMENT and source. per_line: files have a document in each line."""
    raw = texts(spark, path, per_line)
    is_predictions = F.get_json_object("value", "$.predictions").isNotNull()
    docs = raw.filter(~is_predictions).select("source", F.from_json("value", model.document_schema()).alias("d")).select("source", "d.*")
    has_images = F.when(F.col("images").isNull(), F.raise_error(F.concat(F.lit("no images in "), F.col("source"))).cast(docs.schema["images"].dataType)).otherwise(F.col("images"))
    docs = docs.withColumn("images", has_images)
    other = raw.filter(is_predictions).select("source", F.from_json("value", PREDICTIONS).alias("p")).select("source", "p.predictions")
    return docs.unionByName(documents_from_predictions(other))


def documents_from_predictions(rows: DataFrame) -> DataFrame:
    """Predictions (source, predictions) as documents: class ids by first place, the prediction as every detection's class, humans as persons."""
    cls = F.transform("predictions", lambda p: F.coalesce(p["prediction"], F.try_element_at(p["classifications"]["classes"], F.lit(1))))
    rows = rows.withColumn("names", F.array_distinct(F.array_compact(cls)))

    def image(p: Column) -> Column:
        name = F.coalesce(p["prediction"], F.try_element_at(p["classifications"]["classes"], F.lit(1)))
        score = F.coalesce(p["prediction_score"], F.try_element_at(p["classifications"]["scores"], F.lit(1)), F.lit(1.0))
        own = F.when(name.isNotNull(), F.array(F.array((F.array_position("names", name) - 1).cast("string"), score.cast("string"))))

        def det(d: Column) -> Column:
            return F.struct(d["category"].alias("category"), round_to(d["conf"], 5).alias("conf"), F.transform(d["bbox"], lambda x: round_to(x, 5)).alias("bbox"), F.lit(None).cast("int").alias("frame_number"), own.alias("classifications"))

        full = F.array(F.struct(F.lit("1").alias("category"), score.alias("conf"), F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))).alias("bbox"), F.lit(None).cast("int").alias("frame_number"), own.alias("classifications")))
        found = F.coalesce(F.transform(p["detections"], det), F.array().cast(f"array<{model.RAW_DETECTION}>"))
        failed = F.size(F.coalesce(p["failures"], F.array().cast("array<string>"))) > 0
        dets = F.when(failed, F.lit(None)).when((F.size(found) == 0) & name.isNotNull(), full.cast(f"array<{model.RAW_DETECTION}>")).otherwise(found)
        none = F.lit(None)
        return F.struct(
            p["filepath"].alias("file"), F.when(failed, F.concat(F.lit("Failure: "), F.array_join(p["failures"], ","))).alias("failure"), none.cast("int").alias("width"), none.cast("int").alias("height"),
            none.cast("string").alias("datetime"), none.cast("string").alias("location"), none.cast("double").alias("frame_rate"), none.cast("array<int>").alias("frames_processed"), dets.alias("detections"),
        )

    from fieldlens.operators.categories import lookup

    ids = F.map_from_arrays(F.transform("names", lambda _, i: i.cast("string")), "names")
    return rows.select(
        "source",
        F.struct(F.lit("1.5").alias("format_version"), *[F.lit(None).cast("string").alias(n) for n in ("detector", "classifier", "detection_completion_time", "classification_completion_time")], F.lit(None).cast("map<string,string>").alias("detector_metadata")).alias("info"),
        lookup(DETECTION_NAMES).alias("detection_categories"), ids.alias("classification_categories"), F.lit(None).cast("map<string,string>").alias("classification_category_descriptions"),
        F.transform(F.array_sort("predictions", lambda a, b: F.when(a["filepath"] < b["filepath"], -1).when(a["filepath"] > b["filepath"], 1).otherwise(0)), image).alias("images"),
    )


def predictions_from_images(images: DataFrame) -> DataFrame:
    """filepath, failures, detections: images (file, failure, detections) in the predictions form."""
    from fieldlens.operators.categories import lookup

    dets = F.transform(model.by_conf(F.col("detections")), lambda d: F.struct(d["category"].alias("category"), lookup(DETECTION_NAMES)[d["category"]].alias("label"), d["conf"].alias("conf"), d["bbox"].alias("bbox")))
    return images.select(F.col("file").alias("filepath"), F.when(F.col("failure").isNotNull(), F.array(F.lit("DETECTOR"))).alias("failures"), dets.alias("detections"))


def image_table(documents: DataFrame, replacements: list[tuple[str, str]] = ()) -> DataFrame:
    """One row per image, slashes made one way, names replaced in order, with max_detection_conf."""
    rows = model.open_images(documents)
    name = paths.forward(F.col("file"))
    for old, new in replacements:
        name = F.replace(name, F.lit(old), F.lit(new))
    return rows.withColumn("file", name).withColumn("max_detection_conf", model.max_conf(F.col("detections")))


def read_results_csv(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """file, max_confidence, detections from the CSV form, whose boxes are [ymin, xmin, ymax, xmax, conf, class]."""
    df = spark.read.csv(path, header=True, schema="image_path string, max_confidence double, detections string", enforceSchema=True, escape='"')
    parsed = F.transform(F.from_json("detections", "array<array<double>>"), lambda d: F.struct(d[5].cast("int").cast("string").alias("category"), d[4].alias("conf"), F.array(d[1], d[0], d[3] - d[1], d[2] - d[0]).alias("bbox")))
    out = df.select(F.col("image_path").alias("file"), "max_confidence", parsed.alias("detections"))
    return out if rows is None else out.limit(rows)


def read_checkpoint(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Images of a checkpoint document; an error if it has no checkpoint."""
    rows = texts(spark, path, per_line).select(F.from_json("value", f"checkpoint array<{model.IMAGE.replace(model.DETECTION, model.RAW_DETECTION)}>").alias("c"))
    images = F.coalesce("c.checkpoint", F.raise_error(F.lit("not a checkpoint")).cast(rows.schema["c"].dataType["checkpoint"].dataType))
    return rows.select(F.explode(images).alias("i")).select("i.*").withColumn("detections", model.typed_detections(F.col("detections")))


def remaining(images: DataFrame, done: DataFrame) -> DataFrame:
    """Images that a checkpoint hasn't."""
    return images.join(done.select("file"), "file", "left_anti")


class AnnotationDb:
    """The tables of an annotation database: images, annotations, categories."""

    def __init__(self, spark: SparkSession, path: str | list[str], lower: bool = True, per_line: bool = False):
        docs = texts(spark, path, per_line).select(F.from_json("value", COCO).alias("d")).select("d.*")
        self.images = docs.select(F.explode("images").alias("i")).select("i.*")
        self.annotations = docs.select(F.explode("annotations").alias("a")).select("a.*")
        self.categories = docs.select(F.explode("categories").alias("c")).select("c.id", (F.lower("c.name") if lower else F.col("c.name")).alias("name")).distinct()

    def annotations_of_images(self) -> DataFrame:
        """id, annotations of every image, [] where there are none."""
        a = self.annotations.groupBy(F.col("image_id").alias("id")).agg(F.collect_list(F.struct("category_id", "bbox")).alias("annotations"))
        return self.images.select("id").join(a, "id", "left").select("id", F.coalesce("annotations", F.array().cast(a.schema["annotations"].dataType)).alias("annotations"))

    def classes_of_images(self) -> DataFrame:
        """id, classes: distinct names, in the order of their ids."""
        j = self.annotations.join(self.categories.withColumnRenamed("id", "category_id"), "category_id")
        c = j.groupBy(F.col("image_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("category_id", "name"))).alias("c"))
        return self.images.select("id").join(c, "id", "left").select("id", F.coalesce(F.transform("c", lambda x: x["name"]), F.array().cast("array<string>")).alias("classes"))

    def for_locations(self, locations: list[str]) -> tuple[DataFrame, DataFrame]:
        """Images of some locations, and their annotations."""
        images = self.images.filter(F.col("location").isin(locations))
        return images, self.annotations.join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi")

    def subset(self, query: str, ignore_case: bool = False) -> tuple[DataFrame, DataFrame]:
        """Images whose name has a text, and their annotations."""
        name = F.lower("file_name") if ignore_case else F.col("file_name")
        images = self.images.filter(name.contains(query.lower() if ignore_case else query))
        return images, self.annotations.join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi")


def listing(spark: SparkSession, folder: str, recursive: bool = True, relative: bool = True) -> DataFrame:
    """file, length of a folder's files; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length")
    base = folder.rstrip("/").replace("file://", "").replace("file:", "")
    p = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    return df.select((F.replace(p, F.lit(base + "/"), F.lit("")) if relative else p).alias("file"), "length")


def folders(files: DataFrame) -> DataFrame:
    return files.select(paths.dirname(F.col("file")).alias("folder")).filter("folder <> ''").distinct()


def folder_summary(files: DataFrame) -> DataFrame:
    """ext, files, bytes."""
    return files.groupBy(F.lower(paths.extension(F.col("file"))).alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def only_images(files: DataFrame) -> DataFrame:
    return files.filter(paths.is_image(F.col("file")))


def only_videos(files: DataFrame) -> DataFrame:
    return files.filter(paths.is_video(F.col("file")))


def file_hashes(spark: SparkSession, folder: str, algorithm: str = "sha256") -> DataFrame:
    """path, hash of each file's bytes."""
    h = {"sha256": F.sha2("content", 256), "sha1": F.sha1("content"), "md5": F.md5("content")}[algorithm]
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", h.alias("hash"))


def image_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """path, width, height from the headers of PNG, GIF and JPEG files; -1 where there are none."""

    def sizes(batches):
        import pandas as pd

        for b in batches:
            wh = [header_size(c) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "width": [w for w, _ in wh], "height": [h for _, h in wh]})

    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return df.mapInPandas(sizes, "path string, width int, height int")


def header_size(data: bytes) -> tuple[int, int]:
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + n
    return -1, -1


def read_list(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """file: the strings of a JSON list, or the lines of a text. per_line: of lines that are such lists, or names."""
    rows = texts(spark, path, per_line)
    as_json = F.from_json("value", "array<string>")
    return rows.select(F.explode(F.coalesce(as_json, F.split(F.trim("value"), r"\r?\n"))).alias("file"))


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A CSV with a header and a declared schema; blanks are null."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, escape='"', multiLine=True, emptyValue=None)


def read_geofence(spark: SparkSession, path: str) -> DataFrame:
    """taxon, allow, block of a rules file."""
    rows = whole_files(spark, path).select(F.explode(parse_geofence(F.col("value"))).alias("taxon", "r"))
    return rows.select("taxon", F.try_element_at("r", F.lit("allow")).alias("allow"), F.try_element_at("r", F.lit("block")).alias("block"))


def merge_caches(spark: SparkSession, files: str | list[str], per_line: bool = False) -> DataFrame:
    """Images of several documents; their detection categories must agree. per_line: files have a document in each line."""
    docs = read_results(spark, files, per_line)
    kinds = docs.select(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("detection_categories")))).alias("c")).distinct().count()
    if kinds > 1:
        raise ValueError("documents have different detection categories")
    return image_table(docs)


#: Camera tags that are read.
EXIF_TAGS = {0x010F: "make", 0x0110: "model", 0x0132: "modified", 0x9003: "taken"}
GPS_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}


def exif_tags(data: bytes) -> dict[str, str]:
    """The tags of a JPEG file's EXIF block; {} if it has none."""
    at = data.find(b"Exif\0\0", 0, 1 << 16)
    if data[:2] != b"\xff\xd8" or at < 0:
        return {}
    t = data[at + 6 :]
    order = "little" if t[:2] == b"II" else "big"

    def number(k: int, n: int) -> int:
        return int.from_bytes(t[k : k + n], order)

    def fraction(k: int) -> float:
        return number(k, 4) / max(1, number(k + 4, 4))

    out: dict[str, str] = {}

    def directory(k: int, names: dict[int, str]) -> None:
        for i in range(number(k, 2) if 0 < k < len(t) else 0):
            e = k + 2 + 12 * i
            tag, kind, count = number(e, 2), number(e + 2, 2), number(e + 4, 4)
            if tag == 0x8769 and names is EXIF_TAGS:
                directory(number(e + 8, 4), EXIF_TAGS)
            elif tag == 0x8825 and names is EXIF_TAGS:
                directory(number(e + 8, 4), GPS_TAGS)
            elif tag in names and kind == 2:
                p = e + 8 if count <= 4 else number(e + 8, 4)
                out[names[tag]] = t[p : p + count].split(b"\0")[0].decode("latin-1").strip()
            elif tag in names and kind == 5:
                p = number(e + 8, 4)
                out[names[tag]] = ",".join(f"{fraction(p + 8 * j):.9g}" for j in range(min(count, 3)))

    directory(number(4, 4), EXIF_TAGS)
    return out


def read_exif(spark: SparkSession, folder: str) -> DataFrame:
    """path, tags of the files of a folder."""

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"path": b["path"], "tags": [exif_tags(c) for c in b["content"]]})

    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return df.mapInPandas(run, "path string, tags map<string,string>")


def selected_tags(tags: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Tags by name, without regard to case."""
    low = [x.lower() for x in (include or exclude or [])]
    return F.map_filter(tags, lambda k, _: F.lower(k).isin(low) if include else ~F.lower(k).isin(low)) if low else tags


def position(tags: Column) -> Column:
    """(lat, lon) in degrees from camera tags; null where they are missing or out of range."""
    from fieldlens.functions.geometry import degrees

    def one(v: str, ref: str) -> Column:
        p = F.transform(F.split(F.try_element_at(tags, F.lit(v)), ","), lambda x: x.try_cast("double"))
        return degrees(F.get(p, F.lit(0)), F.coalesce(F.get(p, F.lit(1)), F.lit(0.0)), F.coalesce(F.get(p, F.lit(2)), F.lit(0.0)), F.try_element_at(tags, F.lit(ref)))

    lat, lon = one("lat", "lat_ref"), one("lon", "lon_ref")
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def bundle(spark: SparkSession, folder: str, prefix: str, key: str, schema: str) -> DataFrame:
    """key, records: the rows of all <prefix>*.csv of a folder by a key; missing texts are empty."""
    rows = spark.read.csv(f"{folder}/{prefix}*.csv", header=True, schema=schema, enforceSchema=False).na.fill("")
    return rows.groupBy(key).agg(F.collect_list(F.struct(*rows.columns)).alias("records"))


#: Words in a model's file name, its version, and the usual threshold of that version.
MODEL_VERSIONS = (("v5a", "v5a", 0.2), ("v5b", "v5b", 0.2), ("v1000-redwood", "v1000-redwood", 0.2), ("v1000-cedar", "v1000-cedar", 0.2), ("v1000-larch", "v1000-larch", 0.2), ("v1000-sorrel", "v1000-sorrel", 0.2), ("v1000-spruce", "v1000-spruce", 0.2), ("v4", "v4", 0.8), ("v3", "v3", 0.8), ("v2", "v2", 0.8))


def model_version(name: Column, first_only: bool = True) -> Column:
    """Version of a detector by its file name: unknown if none fits; if asked for, multiple if several do."""
    low = F.lower(paths.basename(paths.forward(name)))
    hits = F.array_compact(F.array(*[F.when(low.contains(w), v) for w, v, _ in MODEL_VERSIONS]))
    one = F.coalesce(F.get(hits, F.lit(0)), F.lit("unknown"))
    return one if first_only else F.when(F.size(hits) > 1, "multiple").otherwise(one)


def usual_threshold(stated: Column, detector: Column) -> Column:
    """A document's stated threshold, else its model's, else 0.2."""
    own = F.create_map(*[F.lit(x) for _, v, t in MODEL_VERSIONS for x in (v, t)])
    return F.coalesce(stated.try_cast("double"), F.try_element_at(own, model_version(detector)), F.lit(0.2))
