"""The corpus pipeline: five training-data operators in a row.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
kept, and returns the columns of documents; the last returns the packing. run()
writes each result as Parquet in the shared folder and reads it for the next.
Rows without a doc_id are judged by their text like others, and come after them
where one of a group stays.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.decontamination import contamination
from fieldlens.llm.exact_dedup import exact_dedup
from fieldlens.llm.language_id import accepted, fit_on
from fieldlens.llm.ngram_join import ngram_join
from fieldlens.llm.packing import pack_documents
from fieldlens.llm.registry import ship, table
from fieldlens.llm.support import materialize, small


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the dropped doc_ids; texts are only shuffled if these are very many."""
    return docs.join(small(materialize(dropped.select("doc_id").filter("doc_id is not null").distinct(), "dropped"), 2_000_000), "doc_id", "left_anti").select(*docs.columns)


def judged(docs: DataFrame, drop: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs without what drop(docs) names by doc_id; for this, rows without a doc_id get one above all others."""
    none = docs.filter("doc_id is null")
    if none.isEmpty():
        return without(docs, drop(docs))
    first = (docs.agg(F.max("doc_id").cast("long")).first()[0] or 0) + 1
    # written, as these ids may differ when they are made again
    none = materialize(none.withColumns({"doc_id": F.lit(first) + F.monotonically_increasing_id(), "_none": F.lit(True)}), "without-id")
    keyed = docs.filter("doc_id is not null").withColumns({"doc_id": F.col("doc_id").cast("long"), "_none": F.lit(False)}).unionByName(none)
    kept = without(keyed, drop(keyed.drop("_none")))
    return kept.withColumn("doc_id", F.when(~F.col("_none"), F.col("doc_id")).cast(docs.schema["doc_id"].dataType)).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID accepts; it learns from a bounded sample of those with a language."""
    ship(spark)
    return accepted(docs, fit_on(docs.selectExpr("doc_id as id", "text", "lang")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return judged(docs, lambda d: exact_dedup(d).filter("not kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    ship(spark)
    return judged(docs, lambda d: ngram_join(d).filter("doc_id <> class_id"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    return judged(docs, lambda d: contamination(d, table(spark, sf_dir, "benchmark")).filter("contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    ship(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: SQL expresses neither the language model nor the tokenizer; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
