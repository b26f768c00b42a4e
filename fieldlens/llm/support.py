"""What the training-data operators share: work folders, cut lineage, Arrow text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a numpy kernel takes at once; a longer single text is taken alone.
CHUNK_BYTES = 1 << 19


def work_root(spark: SparkSession) -> str:
    """The folder that the cluster shares; on a single machine one of our own where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='fieldlens-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{work_root(spark)}/fieldlens/{name}-{uuid.uuid4().hex}"


#: Tables that the operators under way have written, for each of them.
_TABLES: list[list[str]] = []


@contextlib.contextmanager
def temporary(spark: SparkSession, kept: list[DataFrame]) -> Iterator[None]:
    """Deletes the tables that were written in this block, but for those that DataFrames in kept read. None of the others may be read later."""
    _TABLES.append([])
    try:
        yield
    finally:
        needed = {f.rsplit("/", 1)[0] for df in kept for f in df.inputFiles()}
        for path in _TABLES.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            if where.toUri().getPath() not in {spark._jvm.org.apache.hadoop.fs.Path(n).toUri().getPath() for n in needed}:
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again, which cuts its lineage there."""
    spark = df.sparkSession
    path = work_path(spark, name)
    if _TABLES:
        _TABLES[-1].append(path)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What worker processes keep from task to task, by its owner: functions that let go of it.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, clear: Callable[[], None]) -> None:
    """Register what a module keeps in a worker process between tasks."""
    _KEPT[owner] = clear


def task_of(owner: str) -> None:
    """Called as a task starts: workers are used again, so what other operators kept there goes, and free memory goes back to the system."""
    for name, clear in _KEPT.items():
        if name != owner:
            clear()
    release()


def release() -> None:
    """Give free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with nulls as empty strings, 64-bit offsets, in one piece."""
    col = pc.fill_null(batch.column(name).cast(pa.large_string()), "")
    return pa.concat_arrays([col]) if col.offset else col


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the n + 1 offsets between them."""
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64, count=col.offset + len(col) + 1)[col.offset :]
    data = col.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most limit bytes, or a single row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer over 64-bit words (shifts, xors and odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def small(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """df with a broadcast hint if it was counted to have few rows; else as it is, for a shuffled join. df: materialised, rows of some dozen bytes."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= most_rows else df


def groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Runs of equal keys of sorted batches, each as one table; only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node that it is connected with) for edges a, b; isolated nodes aren't there.

    Each round links every node's larger neighbours, then its smaller ones, to
    the least of them; the edges end as stars. Every round is written, so that a
    lost executor costs no more than that round. Hubs are aggregated by minimum
    and joined, never gathered in a list.
    """
    from pyspark.sql import functions as F

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select("b", "a")).toDF("a", "b")
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        # written first: a join of two plain exchanges can be split where a hub has very many edges
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        linked = both.join(least, "a")
        moved = linked.filter(F.col("b") > F.col("a")) if large else linked
        return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(linked.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(edges)
    while True:
        edges = materialize(star(materialize(star(edges, True), "large-star"), False), "small-star")
        if (now := state(edges)) == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select("root", "root").distinct()).toDF("node", "root")
