"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of ASCII letters and digits and of all non-ASCII characters,
with A-Z lower-cased. A 4-gram of words has a hash, and of each 7 consecutive
4-grams (10 words) the least hash is the fingerprint of the window. Equal
windows of 10 words have equal fingerprints, so a document that shares such a
span with a benchmark item also shares a fingerprint. Documents without one are
done after a single scan; in the others, the windows whose fingerprints hit
are compared word for word, and what they cover is marked.

Items of fewer than 10 words are one window of all their words; for each of
their lengths (9 at most) the documents' grams of that length are looked up.

The scan's fingerprints are of the same words that are compared afterwards, so
that it can't miss an equal window. (Unicode lower case would not do: that of a
capital sigma depends on what follows it, across gaps.)

Defined cases: a null or empty text has no words and is clean; null items and
items without words have no windows; items with equal windows are all counted;
a null item_id covers words but isn't counted; rows that repeat a doc_id are
all returned and share the hits of that doc_id; rows without a doc_id are
returned as clean, as in the SQL, so callers that have such rows give them ids; without
benchmark rows all are clean; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.registry import query, table
from fieldlens.llm.support import materialize, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words, after and before A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The words themselves, for the SQL.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 10


def split_words(text: Column, gap: str) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def exact_words(text: Column) -> Column:
    return split_words(F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text)), GAP)


def with_fingerprints(df: DataFrame, words: str) -> DataFrame:
    """df with fp, an array with the fingerprint of the window at each place of the words' array.

    It is exploded by the outer forms: for the others Spark infers a filter on
    the array's size and pushes it below these steps, each of which names the
    one before three times; the last would be evaluated some hundred times.
    """

    def tail(c: str, by: int) -> Column:
        return F.slice(c, by + 1, F.greatest(F.size(c), F.lit(1)))

    def pairs(out: str, c: str, by: int, f) -> None:
        nonlocal df
        df = df.withColumn(out, F.zip_with(c, tail(c, by), f))

    df = df.withColumn("h", F.transform(words, lambda w: F.xxhash64(w)))
    pairs("h2", "h", 1, lambda a, b: F.xxhash64(a, b))
    pairs("h4", "h2", 2, lambda a, b: F.xxhash64(a, b))
    pairs("m2", "h4", 1, lambda a, b: F.least(a, b))
    pairs("m4", "m2", 2, lambda a, b: F.least(a, b))
    pairs("m7", "m4", 3, lambda a, b: F.least(a, b))
    df = df.withColumn("fp", F.slice("m7", 1, F.greatest(F.size("m7") - (SPAN - 1), F.lit(0))))
    return df.drop("h", "h2", "h4", "m2", "m4", "m7")


def gram_texts(words: str, n: int) -> Column:
    """All runs of n words as texts, by place."""
    places = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i + 1, n), " "))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = materialize(benchmark.select(F.col(item_id).cast("string").alias("item_id"), exact_words(F.col(item_text)).alias("words")).filter(F.size("words") > 0), "items")
    long_items = with_fingerprints(items.filter(F.size("words") >= SPAN), "words")
    windows = long_items.withColumn("win", gram_texts("words", SPAN)).select("item_id", F.lit(SPAN).alias("n"), F.explode_outer("win").alias("win")).filter("win is not null")
    windows = windows.unionByName(items.filter(F.size("words") < SPAN).select("item_id", F.size("words").alias("n"), F.array_join("words", " ").alias("win")))
    windows = small(materialize(windows.groupBy("n", "win").agg(F.collect_set("item_id").alias("items")), "windows"))
    prints = small(materialize(with_fingerprints(items.select("words"), "words").select(F.explode_outer("fp").alias("fp")).distinct(), "fingerprints"))
    short = sorted(r["n"] for r in items.filter(F.size("words") < SPAN).select(F.size("words").alias("n")).distinct().collect())  # 9 numbers at most

    words = docs.select("doc_id", exact_words(F.col("text")).alias("words"))
    hits = with_fingerprints(words, "words").select("doc_id", F.explode_outer(F.array_distinct("fp")).alias("fp")).join(prints, "fp", "left_semi").select("doc_id")
    for n in short:
        grams = items.filter(F.size("words") == n).select(F.array_join("words", " ").alias("win")).distinct()
        hits = hits.unionByName(words.select("doc_id", F.explode_outer(F.array_distinct(gram_texts("words", n))).alias("win")).join(small(materialize(grams, "grams")), "win", "left_semi").select("doc_id"))
    hit_docs = small(materialize(hits.distinct(), "hit-docs"), 2_000_000)

    found = docs.filter("text is not null").join(hit_docs, "doc_id", "left_semi")
    # only ids go through the explodes: a row with all words for each of its places would grow with the square of a text
    exact = found.select("doc_id", exact_words(F.col("text")).alias("words"))
    at = with_fingerprints(exact, "words").select("doc_id", F.posexplode_outer("fp").alias("i", "fp")).join(prints, "fp", "left_semi")
    places = at.groupBy("doc_id").agg(F.collect_set("i").alias("places"))
    window = F.transform("places", lambda i: F.struct(i.alias("i"), F.array_join(F.slice("words", i + 1, SPAN), " ").alias("win")))
    spans = exact.join(places, "doc_id").select("doc_id", F.explode_outer(window).alias("w")).select("doc_id", "w.i", F.lit(SPAN).alias("n"), "w.win")
    for n in short:
        spans = spans.unionByName(exact.select("doc_id", F.posexplode_outer(gram_texts("words", n)).alias("i", "win")).select("doc_id", "i", F.lit(n).alias("n"), "win"))
    covered = spans.join(windows, ["n", "win"]).groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct(F.col("i").cast("long").alias("a"), (F.col("i") + F.col("n")).cast("long").alias("b")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    merged = F.aggregate("spans", zero, lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(s["end"], x["a"]))).alias("n")))
    marks = covered.select(F.col("doc_id").alias("hit_id"), merged["n"].alias("hit"), F.size("items").cast("long").alias("items_n"), F.array_join("items", ",").alias("names"))
    marks = small(materialize(marks, "contaminated"), 200_000)
    counted = docs.select("doc_id", F.size(split_words(F.col("text"), RAW_GAP)).cast("long").alias("n_words"))
    return counted.join(marks, F.col("doc_id") == F.col("hit_id"), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items_n", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
    )


SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
), m AS (
  SELECT DISTINCT doc_id, i, k.n, array_to_string(w[i + 1 : i + k.n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, (SELECT DISTINCT n FROM bw)) AS k
), hit AS (SELECT m.doc_id, m.i, m.n, bw.item_id FROM m JOIN bw ON m.n = bw.n AND m.win = bw.win
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op6_benchmark_decontamination", SQL)
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
