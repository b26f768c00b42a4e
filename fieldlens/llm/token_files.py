"""Token-id files: 64-bit words that pack a varying count of ids under a selector.

A file holds ids in blocks of BLOCK ids. Words of a block are little-endian:
the top 4 bits are a selector, which says how many ids of how many bits the
other 60 bits hold, lowest first. Selector 1 is a run of 120 zeros. Selector 0
is an escape: the next word is one raw value, for values of more than 60 bits.
A block's last word may hold fewer ids than its selector says; the footer has
the count. The footer has the first word of each block, so that blocks decode
apart, and the documents' ids and counts; then its length and a magic number.

Defined cases: a null or empty text has only the end id; rows go in ascending
doc_id (null first), repeated ones in any order; an empty table gives files
without documents and an empty result.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.registry import query, table
from fieldlens.llm.support import materialize, task_of, text_column, work_path

#: Ids in a word, and bits of each, by selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
WIDTHS = BITS[1:].tolist()
SMALL_GRADES = np.searchsorted(np.array([1 << b for b in WIDTHS]), np.arange(1 << 16), side="right").astype(np.int8)
BLOCK, MAGIC, END_ID = 512, b"FLS8", 1
#: Ids that are coded at once.
CODE_IDS = BLOCK * 256


def grades(values: np.ndarray) -> np.ndarray:
    """Of each value the place of the least width in WIDTHS that holds it, or 15 beyond 60 bits."""
    if len(values) and values.max() < 1 << 16:
        return SMALL_GRADES[values]
    out = np.zeros(len(values), np.int8)
    for b in WIDTHS:
        out += (values >> np.uint64(b)) > 0
    return out


def encode_words(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, number of words of each block) for unsigned 64-bit values.

    A word takes the largest count whose values all fit, by the greatest grade
    of a sliding window; then all blocks step from word to word together. What
    a block's last word holds past the block's end is ignored when decoded.
    """
    values = values.astype(np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    ends = np.minimum((np.arange(blocks) + 1) * BLOCK, n)
    tops = {1: np.append(grades(values), np.zeros(128, np.int8))}
    for p in (2, 4, 8, 16, 32, 64):
        half = tops[p // 2]
        tops[p] = half.copy()
        np.maximum(half[: -(p // 2)], half[p // 2 :], out=tops[p][: -(p // 2)])
    # what fits a selector fits all with fewer and wider values, so a count of those that fit says which is the best
    best = np.full(n, 16, np.int8)
    for s in range(15, 0, -1):
        c = int(COUNTS[s])
        p = 1 << (c.bit_length() - 1)
        fits = np.maximum(tops[p][:n], tops[p][c - p : c - p + n]) <= s - 1
        if not fits.any():
            break
        best -= fits
    best[best == 16] = 0
    take = COUNTS[best]
    cur, live, begins = np.arange(blocks) * BLOCK, np.arange(blocks), np.zeros(n, bool)
    while len(live):
        begins[cur[live]] = True
        cur[live] += take[cur[live]]
        live = live[cur[live] < ends[live]]
    at = np.flatnonzero(begins)
    sel = best[at]
    words = sel.astype(np.uint64) << np.uint64(60)
    padded = np.append(values, np.zeros(128, np.uint64))
    for s in range(2, 16):
        if len(w := np.flatnonzero(sel == s)):
            k = np.arange(int(COUNTS[s]))
            words[w] |= np.bitwise_or.reduce(padded[at[w][:, None] + k] << (k * int(BITS[s])).astype(np.uint64), axis=1)
    escape = np.flatnonzero(sel == 0)
    sizes = np.bincount(at // BLOCK, minlength=blocks) + np.bincount(at[escape] // BLOCK, minlength=blocks)
    return np.insert(words, escape + 1, values[at[escape]]) if len(escape) else words, sizes


def decode_words(words: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """The n values of blocks of so many words."""
    if not n:
        return np.zeros(0, np.uint64)
    first = np.append(0, np.cumsum(sizes))[:-1]
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (sel == 0).any():  # the word after an escape is raw; escapes can follow each other
        k = 0
        zero = np.flatnonzero(sel == 0)
        while k < len(zero):
            raw[zero[k] + 1] = True
            k += 1 + int(k + 1 < len(zero) and zero[k + 1] == zero[k] + 1)
    count = np.where(raw, 0, COUNTS[sel])
    total = np.cumsum(count) - count
    block = np.repeat(np.arange(len(sizes)), sizes)
    place = block * BLOCK + total - total[first][block]
    stop = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n + 128, np.uint64)
    for s in range(2, 16):
        if len(w := np.flatnonzero((sel == s) & ~raw)):
            k = np.arange(int(COUNTS[s]))
            p = place[w][:, None] + k
            v = (words[w][:, None] >> (k * int(BITS[s])).astype(np.uint64)) & np.uint64((1 << int(BITS[s])) - 1)
            over = p >= stop[w][:, None]
            if over.any():
                p[over] = n  # a place that is cut off below
            out[p] = v
    e = np.flatnonzero((sel == 0) & ~raw)
    out[place[e]] = words[e + 1] if len(e) else out[place[e]]
    return out[:n]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_file(path: str, documents: Iterator[tuple[int | None, bytes]]) -> tuple[int, int]:
    """Write (doc_id, ids as 32-bit words) in the given order; returns documents and ids. The file appears whole or not at all."""
    store, name = _store(path)
    temporary = f"{name}.{uuid.uuid4().hex}.tmp"
    doc_ids: list[int | None] = []
    counts: list[int] = []
    sizes: list[np.ndarray] = []
    held: list[bytes] = []
    held_ids = n_ids = 0
    store.create_dir(name.rpartition("/")[0], recursive=True)
    with store.open_output_stream(temporary) as out:

        def flush(last: bool) -> None:
            nonlocal held, held_ids
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            ready = len(ids) if last else len(ids) // BLOCK * BLOCK
            for a in range(0, ready, CODE_IDS):
                words, size = encode_words(ids[a : min(ready, a + CODE_IDS)])
                out.write(words.astype("<u8").tobytes())
                sizes.append(size)
            held, held_ids = [ids[ready:].tobytes()], len(ids) - ready

        for doc_id, ids in documents:
            doc_ids.append(doc_id)
            counts.append(len(ids) // 4)
            held.append(ids)
            held_ids += len(ids) // 4
            n_ids += len(ids) // 4
            if held_ids >= CODE_IDS:
                flush(False)
        flush(True)
        footer = zlib.compress(json.dumps({"n": n_ids, "doc_ids": doc_ids, "counts": counts, "sizes": np.concatenate([np.zeros(0, np.int64), *sizes]).tolist()}).encode(), 1)
        out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
    store.move(temporary, name)
    return len(doc_ids), n_ids


def read_file(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every document of a file, decoded some blocks at a time."""
    store, name = _store(path)
    with store.open_input_file(name) as f:
        end = f.size()
        f.seek(end - 12)
        tail = f.read(12)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        length = int.from_bytes(tail[:8], "little")
        f.seek(end - 12 - length)
        about = json.loads(zlib.decompress(f.read(length)))
        sizes, left = np.array(about["sizes"], np.int64), about["n"]
        f.seek(0)
        step, at, held = CODE_IDS // BLOCK, 0, np.zeros(0, np.uint64)
        for doc_id, count in zip(about["doc_ids"], about["counts"], strict=True):
            parts = [held]
            have = len(held)
            while have < count:
                size = sizes[at : at + step]
                n = min(left, step * BLOCK)
                parts.append(decode_words(np.frombuffer(f.read(int(size.sum()) * 8), "<u8"), size, n))
                have, left, at = have + n, left - n, at + step
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, held[:count]
            held = held[count:]


#: Documents in a file at most, about.
FILE_DOCS = 100_000


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, append the end id, and write one file per range of doc_id. Returns the manifest: shard, path, documents, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fieldlens.llm.tokenize import text_encoder

        task_of("tokenize")
        encoder, end = text_encoder(vocabulary), end_id.to_bytes(4, "little")
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}.ids"

        def encoded() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), text_column(batch, "text"), strict=True):
                    yield doc_id, encoder.encode(text.as_py()) + end

        n_docs, n_ids = write_file(path, encoded())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([path]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["shard", "path", "documents", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // FILE_DOCS))
    return materialize(rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "shard long, path string, documents long, ids long"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    files = manifest.filter("documents > 0").orderBy("shard").select("shard", "path", "ids").collect()  # a row for each file
    before, rows = 0, []
    for f in files:
        rows.append((f["path"], before))
        before += f["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("token_files")
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                for doc_id, ids in read_file(path):
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    return spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), work_path(spark, "token-files"))
    return read_token_files(manifest)
