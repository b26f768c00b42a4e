"""Registry of the training-data queries."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import fieldlens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_SHIPPED: set[str] = set()
PARALLEL = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: they may have no copy of it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(fieldlens.__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="fieldlens-"), "fieldlens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
    # small results in few partitions: as many small files and tasks as cores cost more than they save
    if spark.conf.get(PARALLEL) == "true":
        spark.conf.set(PARALLEL, "false")
    # rows of text are long: smaller batches than the default keep workers small
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "2000")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register an opN_ query, with oracle SQL where SQL can express it."""

    def register(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
