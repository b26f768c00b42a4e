"""Sequences of captures: gap-bounded sessions per location, and ranks inside them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sequences(images: DataFrame, gap_s: float = 60.0, location: str = "location", time: str = "captured_at", ident: str = "image_id") -> DataFrame:
    """images with seq_index, seq_id, frame_num, seq_num_frames.

    A sequence starts at a location's first image, after a gap of more than
    gap_s seconds, at an image without a time and after one.
    """
    by = Window.partitionBy(location).orderBy(F.col(time).asc_nulls_last(), ident)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    before = F.lag(us).over(by)
    new = before.isNull() | us.isNull() | (us - before > gap_s * 1e6)
    marked = images.withColumn("_new", new.cast("long"))
    run = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.withColumn("seq_index", F.sum("_new").over(run) - 1)
    each = Window.partitionBy(location, "seq_index")
    return (
        numbered.withColumn("frame_num", (F.row_number().over(each.orderBy(F.col(time).asc_nulls_last(), ident)) - 1).cast("long"))
        .withColumn("seq_num_frames", F.count(F.lit(1)).over(each))
        .withColumn("seq_id", F.concat(F.lit("location_"), F.col(location).cast("string"), F.lit("_sequence_index_"), F.lpad(F.col("seq_index").cast("string"), 5, "0")))
        .drop("_new")
    )


def frames(images: DataFrame, sequence: str, time: str, ident: str) -> DataFrame:
    """Rank by time inside given sequences, and their sizes."""
    each = Window.partitionBy(sequence)
    return images.withColumn("frame_num", (F.row_number().over(each.orderBy(F.col(time).asc_nulls_last(), ident)) - 1).cast("long")).withColumn("seq_num_frames", F.count(F.lit(1)).over(each))


def at_most(images: DataFrame, sequence: str, n: int, order: str) -> DataFrame:
    """The first n images of each sequence."""
    return images.withColumn("_r", F.row_number().over(Window.partitionBy(sequence).orderBy(order))).filter(F.col("_r") <= n).drop("_r")


def previous(rows: DataFrame, camera: str, order: str, value: str) -> DataFrame:
    """Pairs of neighbours of a camera: value with the one before, for motion metrics."""
    return rows.withColumn("previous", F.lag(value).over(Window.partitionBy(camera).orderBy(order)))


def annotations_by(annotations: DataFrame, images: DataFrame, field: str = "seq_id") -> DataFrame:
    """Distinct sorted class names of annotations by a field of their image, as text too."""
    rows = annotations.join(images.select("image_id", field), "image_id").groupBy(field).agg(F.array_sort(F.collect_set("name")).alias("names"))
    return rows.withColumn("text", F.array_join("names", ","))


def video_detections(frames: DataFrame, nth: int | None = 1) -> DataFrame:
    """Per video and category the nth greatest confidence's detection, or (None) all. Equal ones go by frame."""
    by = Window.partitionBy("video_id", "category").orderBy(F.col("conf").desc(), "frame_number")
    ranked = frames.withColumn("_r", F.row_number().over(by))
    return (ranked if nth is None else ranked.filter(F.col("_r") == nth)).drop("_r")


def _folded(frames: DataFrame, keys: list[str], order: str, value: str, out: str, kind: T.DataType, step: Callable) -> DataFrame:
    """frames with out: step(state, value) gives each row's (state, out), in order within the keys; the state before a first row is None.

    Rows come sorted by keys, so a task holds one batch and one state, however many rows a key has.
    """
    schema = T.StructType([*frames.schema.fields, T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            got = []
            for key, v in zip(zip(*[batch.column(k).to_pylist() for k in keys], strict=True), batch.column(value).to_pylist(), strict=True):
                if key != last:
                    last, state = key, None
                state, x = step(state, v)
                got.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64() if kind == T.DoubleType() else pa.int32())], [*batch.schema.names, out])

    return frames.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def motion_history(frames: DataFrame, decay: float, camera: str = "camera", order: str = "frame_number", motion: str = "motion") -> DataFrame:
    """frames with history: a decayed fold of motion over all of a camera's frames, h = decay * h + motion. A null motion counts as 0."""

    def step(h: float | None, m: float | None) -> tuple[float, float]:
        h = decay * (h or 0.0) + float(m or 0)
        return h, h

    return _folded(frames, [camera], order, motion, "history", T.DoubleType(), step)


def motion_image(frames: DataFrame, threshold: float, duration: float, interval: float = 1.0, keys: tuple[str, ...] = ("camera", "pixel"), order: str = "frame_number", value: str = "value") -> DataFrame:
    """frames (one row per frame and pixel) with mhi, 0 to 255: 255 where value differs from the frame before by more than threshold, else what was there less 255 * interval / duration, 0 at least.

    The first frame has none. States are 32-bit floats, shown without their fractions.
    """
    fall = np.float32(interval / duration * 255)

    def step(state: tuple | None, v: float) -> tuple[tuple, int]:
        if state is None:
            return (v, np.float32(0)), 0
        h = np.float32(255) if abs(v - state[0]) > threshold else max(np.float32(0), state[1] - fall)
        return (v, h), int(h)

    return _folded(frames, list(keys), order, value, "mhi", T.IntegerType(), step)
