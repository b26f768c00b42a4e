"""Where windows of a fixed number of units (bytes, words) recur: shared by two dedup operators.

A window chooses an anchor: of the grams in it the one with the least hash.
Equal windows choose the same anchor at the same place, so it is enough to
compare windows with equal anchors. The windows in a row that have one anchor,
with all units they cover, are a context; its key is the hash of the units that
all windows at these offsets from the anchor share (the core).

Hashes only select and route candidates; what recurs is confirmed by the
operator's own method, on the bytes, in shards of bounded size:

* Keys that occur once have no recurring window; after a count by key they are
  gone, which is most of them.
* Of the contexts of a key one of each kind goes to the key's shard.
* Contexts that are equal whole (key, hash and length) are one kind. The first
  and the last of them are a pair; pairs that follow each other in the same two
  documents are joined to a span, and both sides of it go to a shard. If they are
  confirmed there, all members of these kinds recur.
* A key with more kinds than most_contexts isn't sharded as such: its windows
  are keyed by the hash of all their units, counted with partial aggregates,
  and the first and last place of each that recurs is a pair as above.

A context has fewer than two windows' units, so its polynomial hash is far from
the lengths (some 2,000 units) at which such hashes modulo 2 ** 64 are known to
collide, and two of them, of the core and of the context, have to agree.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.kernels import INVERSE, minimizers, powers, sums
from fieldlens.llm.support import buffers, chunks, materialize, mix64, small, task_of, text_column

#: (data, offsets) -> (values of all units, borders of the texts in units)
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclasses.dataclass(frozen=True)
class Windows:
    """units per window and per gram, and how texts become units."""

    units: Units
    window: int
    gram: int
    #: Parts that an anchor's windows are dealt to by their offset; with more, cores are longer and fewer contexts meet in vain.
    cores: int = 1
    #: Bytes (units of content) of a shard, on average, and kinds of a key that go to its shard at most.
    shard_units: int = 1_500_000
    most_contexts: int = 5000
    #: Windows of a span, about, and units that are hashed at once.
    span_windows: int = 1 << 15
    segment: int = 1 << 22


def range_hashes(s: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the units first .. end - 1, from their sums."""
    return mix64((s[end] - s[first]) * powers(INVERSE, len(s))[first] + (end - first).astype(np.uint64))


def keyed_contexts(u: np.ndarray, valid: np.ndarray, how: Windows) -> tuple[np.ndarray, ...]:
    """(first, n, key, ctx) of the contexts of a row of units; valid: for each window whether it lies within a text."""
    k, w = how.gram, how.window
    s = sums(u)
    h = mix64((s[k:] - s[:-k]) * powers(INVERSE, len(u) - k + 1))
    place, first, count = minimizers(h, w - k + 1, valid)
    last, out = first + count - 1, []
    steps = np.round(np.linspace(0, w - k + 1, how.cores + 1)).astype(np.int64)
    for j, (a, b) in enumerate(zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True)):
        low, high = np.maximum(first, place - b + 1), np.minimum(last, place - a)
        some = np.flatnonzero(low <= high)
        low, high, p = low[some], high[some], place[some]
        out.append((low, high - low + 1, mix64(range_hashes(s, p - a, p - b + 1 + w) + np.uint64(j)), range_hashes(s, low, high + w)))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def contexts(docs: DataFrame, how: Windows) -> DataFrame:
    """doc_id, first, n (windows), anchor (key), ctx (hash of the context) for each context of each text."""
    w = how.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("kernels")
        for batch in batches:
            data, offsets = buffers(text_column(batch, "text"))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in chunks(offsets):
                u, border = how.units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                valid = np.zeros(max(0, len(u) - w + 1), bool)
                for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
                    valid[a : max(a, b - w + 1)] = True
                for at in range(0, len(valid), how.segment):  # each window is in one segment
                    first, n, key, ctx = keyed_contexts(u[at : at + how.segment + w - 1].astype(np.uint64), valid[at : at + how.segment], how)
                    first += at
                    doc = np.searchsorted(border, first, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[i + doc], pa.int64()), pa.array((first - border[doc]).astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64))],
                        names=["doc_id", "first", "n", "anchor", "ctx"],
                    )

    return docs.mapInArrow(run, "doc_id long, first long, n long, anchor long, ctx long")


def pairs_of(rows: DataFrame, *by: str) -> DataFrame:
    """by, d0, f0, d1, f1: the first and the last place (doc_id, first) of each group, where they differ."""
    place = F.struct("doc_id", "first")
    ends = rows.groupBy(*by).agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b")
    return ends.select(*by, F.col("a.doc_id").alias("d0"), F.col("a.first").alias("f0"), F.col("b.doc_id").alias("d1"), F.col("b.first").alias("f1"))


def with_content(docs: DataFrame, wanted: DataFrame, how: Windows, content: Callable[[bytes], Callable[[int, int], bytes]]) -> DataFrame:
    """wanted (doc_id, first, n and others, all long) with the bytes of each context. content(text)(first unit, units) -> bytes."""
    cols, w = [c for c in wanted.columns if c != "doc_id"], how.window
    per_doc = materialize(wanted.groupBy("doc_id").agg(F.collect_list(F.struct(*cols)).alias("list")), "wanted-by-document")
    ids = small(per_doc.select("doc_id"), 2_000_000)
    # of repeated rows of a doc_id each is cut; unlike() drops these again
    texts = docs.join(ids, "doc_id", "left_semi").join(per_doc, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("kernels")
        for batch in batches:
            lists, ids = batch.column(2), batch.column(0)
            for r, text in enumerate(text_column(batch, "text")):
                found = lists.slice(r, 1).flatten().flatten()
                cut = content(text.as_buffer().to_pybytes())
                parts = [cut(a, n - 1 + w) for a, n in zip(found[cols.index("first")].to_pylist(), found[cols.index("n")].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([ids[r].as_py()] * len(parts), pa.int64()), *found, pa.array(parts, pa.binary())], names=["doc_id", *cols, "content"])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in cols), "content binary"])
    return texts.select("doc_id", "text", "list").mapInArrow(run, schema)


def window_hashes(content: DataFrame, how: Windows) -> DataFrame:
    """win, doc_id, first: each window of the contexts."""
    w = how.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("kernels")
        for batch in batches:
            for doc_id, first, n, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "n", "content")), strict=True):
                data = np.frombuffer(text, np.uint8)
                u, _ = how.units(data, np.array([0, len(data)]))
                n = max(0, min(n, len(u) - w + 1))
                at = np.arange(n)
                win = range_hashes(sums(u.astype(np.uint64)), at, at + w)
                yield pa.RecordBatch.from_arrays([pa.array(win.view(np.int64)), pa.array(np.full(n, doc_id)), pa.array(first + at)], names=["win", "doc_id", "first"])

    return content.select("doc_id", "first", "n", "content").mapInArrow(run, "win long, doc_id long, first long")


def spans(pairs: DataFrame, how: Windows) -> DataFrame:
    """pairs (d0, f0, d1, f1, n and others) with shift, island: pairs of one island follow each other without a gap."""
    pairs = pairs.withColumn("shift", F.col("f1") - F.col("f0"))
    row = Window.partitionBy("d0", "d1", "shift").orderBy("f0", "n")  # rows of two documents only
    part = F.expr(f"f0 div {how.span_windows}")
    end, was = F.lag(F.col("f0") + F.col("n")).over(row), F.lag(part).over(row)
    fresh = pairs.withColumn("fresh", (end.isNull() | (end != F.col("f0")) | (was != part)).cast("long"))
    return fresh.withColumn("island", F.sum("fresh").over(row)).drop("fresh")


#: What a row of a shard is: a kind of its key, or the first or second side of a span. Shards have either kinds or spans.
KIND, LEFT, RIGHT = 0, 1, 2
#: What is confirmed: marks of single kinds (KIND), and spans (LEFT).
MARKS = ["role", "doc_id", "first", "n", "d1", "shift", "island"]


def longs(t: pa.Table, *cols: str) -> list[np.ndarray]:
    """Columns as integers, null as 0."""
    return [pc.fill_null(t.column(c), 0).to_numpy() for c in cols]


def unlike(t: pa.Table) -> pa.Table:
    """A shard without the rows that repeat another, as repeated rows of a doc_id make them."""
    _, at = np.unique(np.stack(longs(t, *MARKS), axis=1), axis=0, return_index=True)
    return t if len(at) == t.num_rows else t.take(pa.array(np.sort(at)))


def recurring(docs: DataFrame, how: Windows, content: Callable[[bytes], Callable[[int, int], bytes]], confirm: Callable[[DataFrame, Windows], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(marks of single kinds, places of equal contexts with their first place), both confirmed by the method.

    confirm(shards, how): shards has shard, role, mark, doc_id, first, n, d1,
    shift, island, content, sorted by shard. It returns role, doc_id, first, n,
    d1, shift, island: marks of KIND rows, and the LEFT rows of spans whose
    windows all recur. Of the results, the first has doc_id, first, n, the
    second doc_id, first, n, d0, f0.
    """
    rows = materialize(contexts(docs, how), "contexts")
    # written first: a join of two plain exchanges can be split where an anchor has very many rows
    often = materialize(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("anchor"), "often")
    rows = materialize(rows.join(often, "anchor"), "recurring")
    place = F.struct("doc_id", "first")
    kinds = rows.groupBy("anchor", "ctx", "n").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    kinds = materialize(kinds.select("anchor", "ctx", "n", F.col("a.doc_id").alias("d0"), F.col("a.first").alias("f0"), F.col("b.doc_id").alias("d1"), F.col("b.first").alias("f1")), "kinds")
    several = materialize(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "several")
    nothing = F.lit(None).cast("long")
    single = (F.col("d0") == F.col("d1")) & (F.col("f0") == F.col("f1"))

    def side(df: DataFrame, role: int, key, first: str, doc: str = "d0", mark=None) -> DataFrame:
        span = ["d1", "shift", "island"] if role else [nothing.alias(c) for c in ("d1", "shift", "island")]
        mark = (F.lit(0) if mark is None else mark).cast("long").alias("mark")
        return df.select(F.col(doc).alias("doc_id"), F.col(first).alias("first"), "n", F.xxhash64(*key).alias("key"), F.lit(role).cast("long").alias("role"), mark, *span)

    members = kinds.join(several.filter(F.col("kinds") <= how.most_contexts), "anchor")
    wanted = [side(members, KIND, ["anchor"], "f0", mark=single)]
    copied = kinds.filter(~single).select("anchor", "ctx", "n", "d0", "f0", "d1", "f1")
    hot = materialize(kinds.join(several.filter(F.col("kinds") > how.most_contexts), "anchor").select(F.col("d0").alias("doc_id"), F.col("f0").alias("first"), "n"), "hot")
    hot_rows = None
    if not hot.isEmpty():
        hot_rows = materialize(window_hashes(with_content(docs, hot, how, content), how).distinct(), "window-hashes")
        apart = pairs_of(hot_rows, "win").select(F.col("win").alias("anchor"), F.col("win").alias("ctx"), F.lit(0).cast("long").alias("n"), "d0", "f0", "d1", "f1")
        copied = copied.union(apart)
    # n is 0 for a single window of a hot key, which as a context has one
    paired = materialize(spans(copied.withColumn("of", F.col("n")).withColumn("n", F.greatest("n", F.lit(1))), how), "paired")
    span = paired.groupBy("d0", "d1", "shift", "island").agg(F.min("f0").alias("f0"), F.sum("n").alias("n"))
    span = materialize(span.withColumn("f1", F.col("f0") + F.col("shift")), "spans")
    which = ["d0", "d1", "shift", "island"]
    wanted += [side(span, LEFT, which, "f0"), side(span, RIGHT, which, "f1", doc="d1")]
    cut = materialize(with_content(docs, wanted[0].union(wanted[1]).union(wanted[2]), how, content), "content")
    size = cut.agg(F.sum(F.length("content"))).first()[0] or 0  # a number
    shards = max(1, -(-size // how.shard_units))
    cut = cut.withColumn("shard", 2 * F.pmod("key", F.lit(shards)) + F.least("role", F.lit(1))).select("shard", "role", "mark", "doc_id", "first", "n", "d1", "shift", "island", "content")
    found = materialize(confirm(cut.repartition("shard").sortWithinPartitions("shard"), how), "confirmed")
    sure = found.filter(F.col("role") == LEFT).select(F.col("doc_id").alias("d0"), "d1", "shift", "island").distinct()
    sure = materialize(paired.join(sure, which).select("anchor", "ctx", "of", "d0", "f0"), "sure")
    equal = rows.join(sure.withColumnRenamed("of", "n"), ["anchor", "ctx", "n"]).select("doc_id", "first", "n", "d0", "f0")
    if hot_rows is not None:
        one = sure.filter("of = 0").select(F.col("anchor").alias("win"), "d0", "f0")
        equal = equal.union(hot_rows.join(one, "win").select("doc_id", "first", F.lit(1).cast("long"), "d0", "f0"))
    return found.filter(F.col("role") == KIND).select("doc_id", "first", "n"), equal


def by_document(docs: DataFrame, marks: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow(run) over doc_id, text, marks (list of first, n, or null). marks: doc_id, first, n.

    Texts without marks aren't shuffled as long as the marked ids are few enough to be sent around.
    """
    per_doc = materialize(marks.groupBy("doc_id").agg(F.collect_set(F.struct("first", "n")).alias("marks")), "marks")
    ids = small(per_doc.select(F.col("doc_id").alias("marked")), 2_000_000)
    flagged = docs.join(ids, F.col("doc_id") == F.col("marked"), "left")
    clean = flagged.filter("marked is null").select("doc_id", "text", F.lit(None).cast(per_doc.schema["marks"].dataType).alias("marks"))
    dirty = docs.join(ids.withColumnRenamed("marked", "doc_id"), "doc_id", "left_semi").join(per_doc, "doc_id").select("doc_id", "text", "marks")
    return clean.union(dirty).mapInArrow(run, schema)


def covered(n_units: int, marks: list[dict] | None, window: int) -> np.ndarray:
    """Which of n units lie in a marked window."""
    out = np.zeros(n_units + 1, np.int64)
    if marks:  # a row that repeats a doc_id with a shorter text is cut off
        a = np.array([m["first"] for m in marks])
        b = np.minimum(np.array([m["n"] for m in marks]) - 1 + window + a, n_units)
        a = np.minimum(a, n_units)
        np.add.at(out, a, 1)
        np.add.at(out, b, -1)
    return np.cumsum(out)[:-1] > 0
