"""The data model: a results document, and the three tables it opens to.

Semantics that operators rely on: detections [] means nothing was found;
detections null comes with a failure; ids are strings that look like integers;
confidences may be negative after a detection was suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = "array<double>"
CLASSIFICATION = "struct<id:string,conf:double>"
DETECTION = f"struct<category:string,conf:double,bbox:{BOX},frame_number:int,classifications:array<{CLASSIFICATION}>>"
IMAGE = f"struct<file:string,failure:string,width:int,height:int,datetime:string,location:string,frame_rate:double,frames_processed:array<int>,detections:array<{DETECTION}>>"
RAW_DETECTION = f"struct<category:string,conf:double,bbox:{BOX},frame_number:int,classifications:array<array<string>>>"
INFO = "struct<format_version:string,detector:string,classifier:string,detection_completion_time:string,classification_completion_time:string,detector_metadata:map<string,string>>"
RAW_DOCUMENT = (
    f"info {INFO}, detection_categories map<string,string>, classification_categories map<string,string>, classification_category_descriptions map<string,string>, "
    f"images array<struct<file:string,failure:string,width:int,height:int,datetime:string,location:string,frame_rate:double,frames_processed:array<int>,detections:array<{RAW_DETECTION}>>>"
)


def typed_detections(raw: Column) -> Column:
    """Detections whose classifications are [id, conf] pairs of strings, with these as structs."""
    return F.transform(
        raw,
        lambda d: d.withField("classifications", F.transform(d["classifications"], lambda c: F.struct(c[0].alias("id"), c[1].cast("double").alias("conf")))),
    )


def open_images(documents: DataFrame) -> DataFrame:
    """One row per image of documents (columns as RAW_DOCUMENT); the category maps come along."""
    rows = documents.select("info", "detection_categories", "classification_categories", F.explode_outer("images").alias("i"))
    return rows.select("info", "detection_categories", "classification_categories", "i.*").withColumn("detections", typed_detections(F.col("detections")))


def open_detections(images: DataFrame, key: str = "file") -> DataFrame:
    """One row per detection with its place det_ord; images without any have one row whose det_ord is null."""
    rows = images.select(key, "failure", F.col("detections").isNull().alias("no_result"), F.posexplode_outer("detections").alias("det_ord", "d"))
    box = F.col("d.bbox")
    return rows.select(
        key, "failure", "no_result", F.col("det_ord").cast("long").alias("det_ord"), F.col("d.category").alias("category"), F.col("d.conf").alias("conf"),
        box[0].alias("x"), box[1].alias("y"), box[2].alias("w"), box[3].alias("h"), F.col("d.frame_number").alias("frame_number"), F.col("d.classifications").alias("classifications"),
    )


def close_detections(rows: DataFrame, key: str = "file") -> DataFrame:
    """Inverse of open_detections: null and [] are told apart by no_result."""
    det = F.struct(
        "det_ord",
        F.struct("category", "conf", F.array("x", "y", "w", "h").alias("bbox"), "frame_number", "classifications").alias("d"),
    )
    grouped = rows.groupBy(key).agg(F.first("failure").alias("failure"), F.first("no_result").alias("no_result"), F.array_sort(F.collect_list(F.when(F.col("det_ord").isNotNull(), det))).alias("l"))
    return grouped.select(key, "failure", F.when(~F.col("no_result"), F.transform("l", lambda x: x["d"])).alias("detections"))


def nest(images: DataFrame, detections: DataFrame, key: str = "image_id") -> DataFrame:
    """images with an array column of their detections, in order of det_ord; null where the image failed."""
    cols = [c for c in detections.columns if c not in (key, "det_ord")]
    lists = detections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("det_ord", *cols))).alias("detections"))
    empty = F.array().cast(lists.schema["detections"].dataType)
    return images.join(lists, key, "left").withColumn("detections", F.when(F.col("failure").isNull(), F.coalesce("detections", empty)))


def max_conf(detections: Column) -> Column:
    """Greatest confidence; 0 for null or no detections."""
    return F.coalesce(F.array_max(F.transform(detections, lambda d: d["conf"])), F.lit(0.0))


def by_conf(detections: Column) -> Column:
    """Detections in falling confidence; equal ones stay in order."""
    tagged = F.transform(detections, lambda d, i: F.struct((-d["conf"]).alias("k"), i.alias("i"), d.alias("d")))
    return F.transform(F.array_sort(tagged), lambda t: t["d"])


def document_schema() -> T.StructType:
    return T.StructType.fromDDL(RAW_DOCUMENT)
