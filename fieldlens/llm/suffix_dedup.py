"""Suffix-array dedup on a run-length index.

A byte goes if a 400-byte string that covers it also starts anywhere else.
repeats.py cuts the texts to contexts and spans that may recur and deals these to
shards. Each shard gets a run-length index: the Burrows-Wheeler transform of its
texts in runs, with the suffix positions at the runs' first and last rows as
samples. Matching statistics (the longest match of the text at each place with
any other place of the shard) are then streamed in text order: at the sampled
places they are found by comparing bytes, and between samples each is one less
than the one before, because within a run the neighbouring suffix moves along.
Places whose statistic reaches 400 start a marked string. Nothing is marked that
an index has not found; further copies of a context follow its first two.

Defined cases: a null text is empty; texts of fewer than 400 bytes lose
nothing; overlapping matches count, also of a text with itself; repeated rows
of a doc_id are each returned but count as one text (a doc_id is a key); rows
without a doc_id lose nothing and do not make others repeat; an
empty table gives an empty result. kept_sha256 is of the bytes that stay, which
may split a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.registry import query, table
from fieldlens.llm.repeats import KIND, LEFT, MARKS, Windows, by_document, covered, longs, recurring, unlike
from fieldlens.llm.support import groups, task_of, text_column

LENGTH = 400


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def windows(length: int = LENGTH, **limits: int) -> Windows:
    return Windows(byte_units, length, max(1, length // 8), **{"cores": 3, **limits})


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all texts with an end mark after each, first places). Marks differ and use bytes that UTF-8 never has."""
    digits = max(1, -(-len(texts).bit_length() // 2))
    parts, at, place = [], [], 0
    for i, t in enumerate(texts):
        at.append(place)
        mark = bytes([0xFF, *(0xF8 + (i >> 2 * d & 3) for d in range(digits))])
        parts += [t, mark]
        place += len(t) + len(mark)
    return np.frombuffer(b"".join(parts), np.uint8), np.array(at, np.int64)


class RunLengthIndex:
    """Run-length Burrows-Wheeler transform with sampled run ends.

    heads, lengths: the transform's runs. first, last: suffix positions at the
    first and last row of each run; before, after: those of the rows around it.
    The first suffix has no byte before it, so its row is a run of its own.
    """

    def __init__(self, text: np.ndarray):
        self.text, n = text, len(text)
        wide = np.append(text, np.zeros(8, np.uint8)).astype(np.uint64)
        self.words = np.zeros(n + 1, np.uint64)  # the 8 bytes from each place on
        for b in range(8):
            self.words[:n] = (self.words[:n] << np.uint64(8)) | wide[b : b + n]
        # a rank is the place of the first suffix with the same prefix; only suffixes that tie are sorted on
        size, order, rank, place = 8, np.argsort(self.words[:n]), np.empty(n, np.int32), np.arange(n)
        rank[order] = self._firsts(self.words[order])
        alone = rank[order] == place
        tied = np.flatnonzero(~(alone & np.append(alone[1:], True)))
        while len(tied):
            sub = order[tied]  # by twice as many bytes
            after = np.zeros(len(sub), np.int64)
            inside = sub + size < n
            after[inside] = rank[sub[inside] + size].astype(np.int64) + 1
            key = rank[sub].astype(np.int64) * (n + 2) + after
            by = np.argsort(key)
            order[tied] = sub = sub[by]
            first = tied[self._firsts(key[by])]
            rank[sub] = first
            alone = first == tied
            # the row after a group of ties is alone or starts another group
            tied = tied[~(alone & np.append(alone[1:], True))]
            size *= 2
        bwt = np.where(order > 0, text[order - 1].astype(np.int16), np.int16(-1))
        edge = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        end = np.append(edge[1:], n) - 1
        self.heads, self.lengths = bwt[edge], np.diff(np.append(edge, n))
        self.first, self.last = order[edge], order[end]
        self.before, self.after = np.append(-1, order[edge[1:] - 1]), np.append(order[end[:-1] + 1], -1)

    @staticmethod
    def _firsts(keys: np.ndarray) -> np.ndarray:
        """For each of sorted keys the place of the first equal one."""
        new = np.append(True, keys[1:] != keys[:-1])
        return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of different suffixes; 0 where one is missing (-1)."""
        n, out = len(self.text), np.zeros(len(a), np.int64)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        x, y = a[at], b[at]
        while len(at):
            differ = self.words[x] ^ self.words[y]
            same = differ == 0
            rest = differ[~same]
            bytes_same = np.zeros(len(rest), np.int64)
            for k in range(1, 8):
                bytes_same += (rest >> np.uint64(64 - 8 * k)) == 0
            out[at[~same]] += bytes_same
            out[at[same]] += 8
            at, x, y = at[same], x[same] + 8, y[same] + 8
            inside = (x < n) & (y < n)
            at, x, y = at[inside], x[inside], y[inside]
        longest = n - np.maximum(a, b)  # the bytes after the text's end are no match
        return np.where((a >= 0) & (b >= 0), np.minimum(out, longest), 0)

    def matching_statistics(self) -> np.ndarray:
        """For each place the longest match with another place."""
        n = len(self.text)
        best = np.zeros(n, np.int64)
        for at, other in ((self.first, self.before), (self.last, self.after)):
            by = np.argsort(at)
            places, value = at[by], self.common(at[by], other[by])
            reach = np.repeat(places + value, np.diff(np.append(places, n)))  # place 0 is a sample
            best = np.maximum(best, reach - np.arange(n))
        return best


def marked_runs(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the runs of True."""
    d = np.diff(np.concatenate([[0], ok.astype(np.int8), [0]]))
    a, b = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    return a, b - a


def shard_marks(shards: DataFrame, how: Windows) -> DataFrame:
    """What recurs in a shard by its run-length index: windows of single kinds, and spans of which all windows do."""
    length = how.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("suffix_dedup")
        for t in groups(batches):
            t = unlike(t)
            role, mark, doc, first, n, d1, shift, island = longs(t, "role", "mark", "doc_id", "first", "n", "d1", "shift", "island")
            text, at = join_texts(t.column("content").to_pylist())
            best = RunLengthIndex(text).matching_statistics() >= length
            out: list[tuple] = []
            for i in np.flatnonzero(mark == 1):
                a, m = marked_runs(best[at[i] : at[i] + n[i]])
                out += [(KIND, doc[i], first[i] + x, y, None, None, None) for x, y in zip(a.tolist(), m.tolist(), strict=True)]
            out += [(LEFT, doc[i], first[i], n[i], int(d1[i]), int(shift[i]), int(island[i])) for i in np.flatnonzero(role == LEFT) if best[at[i] : at[i] + n[i]].all()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], names=MARKS)

    return shards.mapInArrow(run, ", ".join(f"{c} long" for c in MARKS))


def suffix_dedup(docs: DataFrame, how: Windows | None = None, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay)."""
    how = how or windows()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    once = docs.filter("doc_id is not null and text is not null")
    single, equal = recurring(once, how, lambda text: lambda first, n: text[first : first + n], shard_marks)
    marks = single.union(equal.select("doc_id", "first", "n"))
    length = how.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("suffix_dedup")
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), text_column(batch, "text"), batch.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if found else memoryview(text.as_buffer() or b"")
                gone, spans, kept = 0, 0, raw
                if found:
                    out = covered(len(raw), found, length)
                    gone, spans = int(out.sum()), len(marked_runs(out)[0])
                    kept = np.frombuffer(raw, np.uint8)[~out].tobytes()
                rows.append((doc_id, len(raw), gone, spans, hashlib.sha256(kept).hexdigest(), bytes(kept) if keep_text else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 4, pa.string(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = by_document(docs, marks, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_text else out.drop("kept")


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
