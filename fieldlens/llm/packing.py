"""Best-fit packing planned on the length histogram.

1. Every document becomes pieces of at most `size` tokens (only longer ones are
   cut; the first piece takes what is over).
2. Pieces are counted by length: at most `size` counts, whatever the input.
3. Best-fit decreasing runs over those counts. Bins of equal fill form one
   group; a run of equal pieces goes to a whole group at once, so the plan has
   a few rows for each length.
4. A piece takes the slot of its rank within its length. Ranks come in two
   steps (rank in a hash share of the length, plus the count of the shares
   before); a length has as many shares as its count needs, so that no task
   holds all pieces of one length, however common it is.

Defined cases: a null or empty text is one piece that holds only the end id;
equal lengths are ranked by (share, doc_id, piece); an empty table gives an
empty result; repeated rows of a doc_id are each packed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.llm.registry import query, table
from fieldlens.llm.support import materialize, task_of, text_column

SIZE, END_ID = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    if n <= size:
        return [(0, n)]
    first = n % size
    starts = [0] * bool(first) + list(range(first, n, size))
    return [(s, first if first and not s else size) for s in starts]


def tokenized_pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fieldlens.llm.tokenize import text_encoder

        task_of("tokenize")
        encoder, end = text_encoder(vocabulary), end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_column(batch, "text"), strict=True):
                ids = encoder.encode(text.as_py()) + end
                rows += [(doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, size))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, first bin, offset).

    The piece of that length with a rank from the first one on, up to the next
    row's, goes to bin first bin + (rank - first rank), at that offset.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # by free tokens: (first bin, bins)
    rows, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = min((r for r in free if r >= length), default=None)
            if room is None:
                per = size // length
                need = -(-left // per)
                free.setdefault(size, []).append((bins, need))
                bins += need
                continue
            first, n = free[room].pop()
            if not free[room]:
                del free[room]
            if n > left:
                free.setdefault(room, []).append((first + left, n - left))
                n = left
            rows.append((length, rank, first, size - room))
            if room > length:
                free.setdefault(room - length, []).append((first, n))
            rank, left = rank + n, left - n
    return rows


def best_fit_pack(pieces: DataFrame, size: int = SIZE, share_rows: int = 20_000) -> DataFrame:
    """pieces (as from tokenized_pieces) with sequence_id and offset. share_rows: pieces in a share of a length, on average."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most size rows
    shares = pieces.sparkSession.createDataFrame([(k, -(-n // share_rows)) for k, n in counts.items()], "length long, shares long")
    share = F.pmod(F.xxhash64("doc_id", "piece"), F.col("shares"))
    pieces = pieces.join(F.broadcast(shares), "length").withColumn("share", share).select(*pieces.columns, "share")
    by_share = pieces.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    before = by_share.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("share")) - F.col("n"))
    slots = np.array(plan(counts, size), dtype=np.int64).reshape(-1, 4)
    order = np.lexsort((slots[:, 1], slots[:, 0]))
    slots = slots[order]
    starts = {int(n): (int(a), int(b)) for n, a, b in zip(*_ranges(slots[:, 0]), strict=True)}

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for one in np.unique(n):
            a, b = starts[int(one)]
            at = np.flatnonzero(n == one)
            k = a + np.searchsorted(slots[a:b, 1], r[at], side="right") - 1
            seq[at], off[at] = slots[k, 2] + r[at] - slots[k, 1], slots[k, 3]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    within = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("r", F.row_number().over(within).cast("long") - 1).join(before.select("length", "share", "before"), ["length", "share"])
    return ranked.withColumn("slot", slot("length", F.col("before") + F.col("r"))).select(*[c for c in pieces.columns if c != "share"], "slot.sequence_id", "slot.offset")


def _ranges(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, with their first and last + 1 places."""
    values, first = np.unique(keys, return_index=True)
    return values, first, np.append(first, len(keys))[1:]


def pack_documents(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Tokenize, cut and pack whole documents."""
    return best_fit_pack(materialize(tokenized_pieces(docs, vocabulary, size, end_id), "pieces"), size)


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
