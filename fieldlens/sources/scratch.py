"""Folders for what is written on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir; on a single machine in one of our own where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='fieldlens-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/fieldlens/{name}-{uuid.uuid4().hex}"
