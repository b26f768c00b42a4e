"""Language ID: averaged hashed subword embeddings with a linear softmax.

Features are the 2-, 3- and 4-byte grams of the lower-cased text in UTF-8; each
size has 65,536 buckets (2-grams one each, the others by a multiplicative
hash). A document is the mean of its grams' embeddings; a linear softmax reads
it. Both are trained by stochastic gradient descent in numpy, on TRAIN_ROWS
labelled rows at most, which are chosen by a hash of their id. A fifth of
these sets the temperature, and the rejection limit: the least score above
which at most MOST_ERROR of the accepted ones are wrong.

Mean and softmax input are both linear, so the fitted model is one table of a
score for each bucket and language; a text's scores are sums of its grams'.

Defined cases: a null text, or one without a letter, is `und`, of score 0 and
rejected; texts shorter than a gram have the bias alone; equal scores go to the
first language in sorted order; without labelled rows all are `und`; whole
texts are read, however long; an empty table gives an empty result; repeated
rows are judged each.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.registry import query, table
from fieldlens.llm.support import buffers, chunks, release, task_of, text_column

#: The bound on the labelled rows that are fitted, the embeddings' size and the passes.
TRAIN_ROWS, DIM, EPOCHS, MOST_ERROR = 4000, 12, 6, 0.01
BUCKETS, SIZES = 1 << 16, (2, 3, 4)
UND = "und"


def grams(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram size: bucket by place, and whether the place has a whole gram. ends: of each place's document."""
    n = len(data)
    x = np.zeros(n, np.uint32)
    wide = np.append(data, np.zeros(max(SIZES), np.uint8)).astype(np.uint32)
    place = np.arange(n)
    for k in range(max(SIZES)):
        x = (x << np.uint32(8)) | wide[k : k + n]
        size = k + 1
        if size in SIZES:
            b = x if size == 2 else (x * np.uint32(2654435769)) >> np.uint32(16)
            yield b.astype(np.int32) + BUCKETS * SIZES.index(size), place + size <= ends


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text with their shares."""
    data = np.frombuffer(pc.utf8_lower(text).as_py().encode(), np.uint8)  # lowered as in predictions
    b = np.concatenate([x[ok] for x, ok in grams(data, np.full(len(data), len(data)))] or [np.zeros(0, np.int32)])
    u, c = np.unique(b, return_counts=True)
    return u, c / max(1, len(b))


@dataclasses.dataclass
class LanguageModel:
    """labels in sorted order; scores: by bucket and label; bias; temperature; the rejection limit."""

    labels: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.0

    def probabilities(self, sums: np.ndarray, grams: np.ndarray) -> np.ndarray:
        z = (sums / np.maximum(grams, 1)[:, None] + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 7) -> LanguageModel:
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in labels])
    docs = [counted(t) for t in texts]
    e = rng.normal(0, 0.3, (BUCKETS * len(SIZES), DIM))
    w, bias = np.zeros((DIM, len(names))), np.zeros(len(names))
    order = rng.permutation(len(docs))
    held = order[: len(docs) // 5] if len(docs) >= 50 else order
    train = order[len(docs) // 5 :] if len(docs) >= 50 else order
    for epoch in range(EPOCHS):
        rate = 4.0 * (1 - epoch / EPOCHS)
        for i in rng.permutation(train):
            u, c = docs[i]
            x = c @ e[u]
            z = x @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            e[u] -= rate * 10 * c[:, None] * (w @ p)
            w -= rate * np.outer(x, p)
            bias -= 0.05 * rate * p
    model = LanguageModel(names, e @ w, bias)
    sums = np.array([c @ model.scores[u] for u, c in (docs[i] for i in held)]).reshape(len(held), len(names))
    truth, one = y[held], np.ones(len(held))
    losses = []
    grid = np.geomspace(0.2, 20, 40)
    for t in grid:
        model.temperature = float(t)
        losses.append(-np.log(np.maximum(model.probabilities(sums, one)[np.arange(len(held)), truth], 1e-12)).mean())
    model.temperature = float(grid[int(np.argmin(losses))])
    p = model.probabilities(sums, one)
    score, right = p.max(axis=1), p.argmax(axis=1) == truth
    by = np.argsort(-score, kind="stable")
    wrong = np.cumsum(~right[by]) / np.arange(1, len(by) + 1)
    fine = np.flatnonzero(wrong <= MOST_ERROR)
    last = len(by) - 1
    model.limit = 0.0 if not len(fine) or fine[-1] == last else float(score[by[fine[-1]]])
    return model


def fit_on(labelled: DataFrame, most_rows: int = TRAIN_ROWS) -> LanguageModel | None:
    """labelled: id, text, lang. Fits on the rows whose ids have the least hashes, most_rows at most."""
    rows = labelled.filter("lang is not null and text is not null")
    n = rows.count()
    if not n:
        return None
    hashed = rows.withColumn("k", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 40)))
    near = hashed.filter(F.col("k") < int(min(1.0, 1.2 * most_rows / n) * (1 << 40)))
    got = near.orderBy("k", "id").limit(most_rows).select("text", "lang").toArrow()
    if not got.num_rows:
        return None
    model = fit(got.column("text").to_pylist(), got.column("lang").to_pylist())
    del got
    release()
    return model


def judge(model: LanguageModel | None, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, rejected) of each text."""
    letter = pc.match_substring_regex(col, r"\p{L}").to_numpy(zero_copy_only=False)
    data, offsets = buffers(pc.utf8_lower(col))
    n = len(col)
    names, scores, limit = np.full(n, UND, dtype=object), np.zeros(n), 1.0
    if model is not None:
        limit = model.limit
        for i, j in chunks(offsets, 1 << 18):
            at = offsets[i : j + 1] - offsets[i]
            lengths = np.diff(at)
            full = np.flatnonzero(lengths)
            total = np.zeros((j - i, len(model.labels)))
            for b, ok in grams(data[offsets[i] : offsets[j]], np.repeat(at[1:], lengths)):
                s = model.scores[b]
                s[~ok] = 0
                if len(full):
                    total[full] += np.add.reduceat(s, at[:-1][full], axis=0)
            p = model.probabilities(total, sum(np.maximum(lengths - k + 1, 0) for k in SIZES))
            names[i:j] = np.array(model.labels, dtype=object)[p.argmax(axis=1)]
            scores[i:j] = p.max(axis=1)
    names[~letter] = UND
    scores[~letter] = 0.0
    return names, scores, (names == UND) | (scores < limit)


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("language_id")
        for batch in batches:
            names, scores, rejected = judge(model, text_column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected.astype(bool))], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text isn't rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("language_id")
        for batch in batches:
            yield batch.filter(pa.array(~judge(model, text_column(batch, text_col))[2].astype(bool)))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; one without an id is not said to be, though it isn't learned from either."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train_on_documents(docs: DataFrame) -> LanguageModel | None:
    """Fit on text and lang of the documents that are not held out."""
    return fit_on(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang"))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train_on_documents(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
