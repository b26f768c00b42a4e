"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

The index is a Parquet table with a row for each distinct normalised text:
digest, keep_id, keep_chars. It is bucketed and sorted by digest, so that new
data meets it in a sort-merge anti-join without the index being shuffled. New
digests are appended; rows whose digest is already there are duplicates of the
indexed row.

Defined cases: a null text counts as empty; texts that are equal after their
ASCII white space is deleted are equal; of equal new texts the one with most
code points, then the smallest doc_id (null last) stays; repeated rows of one
doc_id are all returned, and are kept where theirs is the kept id; an empty
table gives an empty result. Further columns of the input are not touched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.registry import query, table
from fieldlens.llm.support import materialize, work_path

#: The ASCII white space that normalisation deletes.
WHITE = " \t\n\x0b\x0c\r"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_code (code points of the text) and digest (binary SHA-256 of the normalised text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(text).cast("long").alias("n_code"),
        F.unhex(F.sha2(F.translate(text, WHITE, "").cast("binary"), 256)).alias("digest"),
    )


#: Rows of a bucket of an index that is made for one input.
BUCKET_ROWS = 2_000_000


class DigestIndex:
    """The index at a path of the shared store; opened again by the same path later."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, keep_chars BIGINT, group_size BIGINT) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Add the best row of each digest that the index lacks. rows: as from digests()."""
        best = rows.groupBy("digest").agg(
            F.min(F.struct((-F.col("n_code")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))).alias("w"),
            F.count(F.lit(1)).alias("group_size"),
        )
        new = best.select("digest", F.col("w.c").alias("keep_id"), (-F.col("w.a")).alias("keep_chars"), "group_size")
        known = self.rows().select("digest").hint("merge")
        (
            new.join(known, "digest", "left_anti")
            .repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).saveAsTable(self.name)
        )


def exact_dedup(docs: DataFrame, index_path: str | None = None, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The documents go through the index at index_path, or through a new one.
    buckets is fixed for an index: give it with a path (else 64); for a new one
    it follows from the rows, BUCKET_ROWS of them each. The
    last join meets rows and index entries by digest; both sides are plain
    exchanges, so that Spark can split the rows of a digest with very many copies.
    """
    spark = docs.sparkSession
    rows = materialize(digests(docs, id_col, text_col), "digests")
    buckets = buckets or (64 if index_path else max(64, rows.count() // BUCKET_ROWS))
    index = DigestIndex(spark, index_path or work_path(spark, "digest-index"), buckets)
    index.append(rows)
    entries = spark.read.schema(index.rows().schema).parquet(index.path)
    return rows.join(entries.hint("merge"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
"""


@query("op1_exact_dedup", SQL)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))
