"""Substring dedup by repeated-phrase automata.

A word goes if a window of 20 words that covers it also starts earlier: in a
smaller doc_id, or earlier in the same document. repeats.py cuts the texts to what
may recur and deals it to shards by what has to match, so that every document is
streamed, but only to the shards that hold phrases with its own anchors:

* A shard of contexts: windows whose hash recurs there are its phrases; an
  Aho-Corasick automaton of them locates every occurrence in all contexts of the
  shard, and all but the first of a phrase are marked.
* A shard of spans: the passages (runs of windows that recur in the same two
  documents) are compiled to an automaton, and the other documents' texts are
  streamed through it. Where it finds the passage, the equal contexts but the
  first are marked.

Defined cases: a null text has no words; texts of fewer than 20 words lose
nothing; words are runs of other characters than ASCII white space, compared
unchanged; repeated rows of a doc_id are each returned but count as one text;
rows without a doc_id lose nothing and, as in the SQL, do not make others repeat;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm import kernels
from fieldlens.llm.registry import query, table
from fieldlens.llm.repeats import KIND, LEFT, MARKS, RIGHT, Windows, by_document, covered, longs, range_hashes, recurring, unlike
from fieldlens.llm.suffix_dedup import marked_runs
from fieldlens.llm.support import groups, task_of, text_column

WORDS = 20
WHITE = b" \t\n\x0b\x0c\r"


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, end, border = kernels.words(data, offsets)
    return kernels.word_hashes(data, first, end), border


def windows(words: int = WORDS, **limits: int) -> Windows:
    return Windows(word_units, words, max(1, words * 2 // 5), **{"shard_units": 600_000, **limits})


def cutter(text: bytes):
    """(first word, words) -> those words, one space apart."""
    parts = text.split()  # ASCII white space, for bytes
    return lambda first, n: b" ".join(parts[first : first + n])


def recurring_phrases(texts: list[bytes], words: int) -> list[bytes]:
    """The runs of so many words that occur more than once in the texts, by their hashes (others may be among them)."""
    offsets = np.append(0, np.cumsum([len(x) for x in texts]))
    data = np.frombuffer(b"".join(texts), np.uint8)
    first, end, border = kernels.words(data, offsets)
    if len(first) < words:
        return []
    at = np.arange(len(first) - words + 1)
    inside = np.searchsorted(border, at, "right") == np.searchsorted(border, at + words - 1, "right")
    at = at[inside]
    hashes = range_hashes(kernels.sums(kernels.word_hashes(data, first, end)), at, at + words)
    _, lead, times = np.unique(hashes, return_index=True, return_counts=True)
    raw = data.tobytes()
    return [raw[first[i] : end[i + words - 1]] for i in at[lead[times > 1]]]


def shard_marks(shards: DataFrame, how: Windows) -> DataFrame:
    """What the automata find: windows of kinds that start earlier in another kind of the shard, and spans whose passage is in both their texts."""
    words = how.window

    def located(phrases: list[bytes], texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """(text, last character, phrase) of every occurrence of every phrase, as whole words."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, x in enumerate(phrases):
            automaton.add_word(f" {x.decode()} ", k)
        if not len(automaton):
            return
        automaton.make_automaton()
        for c, x in enumerate(texts):
            for end, k in automaton.iter(f" {x} "):
                yield c, end, k

    def kinds(t: pa.Table) -> list[tuple]:
        doc, first = longs(t, "doc_id", "first")
        raw = t.column("content").to_pylist()
        texts = [x.decode() for x in raw]
        ends = [{e: i for i, e in enumerate(np.cumsum([len(q) + 1 for q in x.split(" ")]).tolist())} for x in texts]
        hits = [(k, c, ends[c][end] - words + 1) for c, end, k in located(recurring_phrases(raw, words), texts)]
        if not hits:
            return []
        k, c, i = np.array(hits, np.int64).T
        place = first[c] + i
        order = np.lexsort((place, doc[c], k))
        k, c, place = k[order], c[order], place[order]
        lead = np.append(True, k[1:] != k[:-1])
        head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        later = (doc[c] != doc[c[head]]) | (place != place[head])
        return [(KIND, d, p, 1, None, None, None) for d, p in zip(doc[c][later].tolist(), place[later].tolist(), strict=True)]

    def spans(t: pa.Table) -> list[tuple]:
        role, doc, first, n, d1, shift, island = longs(t, "role", "doc_id", "first", "n", "d1", "shift", "island")
        raw = t.column("content").to_pylist()
        passages = {x: k for k, x in enumerate(dict.fromkeys(raw[i] for i in np.flatnonzero(role == LEFT)))}
        rights = np.flatnonzero(role == RIGHT)
        found = {(k, int(rights[c])) for c, _, k in located(list(passages), [raw[i].decode() for i in rights])}
        other = {(int(d1[i]), int(first[i]), int(n[i])): int(i) for i in rights}
        out = []
        for i in np.flatnonzero(role == LEFT):
            if (passages[raw[i]], other.get((int(d1[i]), int(first[i] + shift[i]), int(n[i])))) in found:
                out.append((LEFT, *(int(x[i]) for x in (doc, first, n, d1, shift, island))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("kernels")
        for t in groups(batches):
            t = unlike(t)
            out = kinds(t) if t.column("role")[0].as_py() == KIND else spans(t)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], names=MARKS)

    return shards.mapInArrow(run, ", ".join(f"{c} long" for c in MARKS))


def phrase_dedup(docs: DataFrame, how: Windows | None = None, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the words that stay, one space apart)."""
    how = how or windows()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    once = docs.filter("doc_id is not null and text is not null")
    single, equal = recurring(once, how, cutter, shard_marks)
    marks = single.union(equal.filter("doc_id <> d0 or first <> f0").select("doc_id", "first", "n"))
    words = how.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("phrase_dedup")
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), text_column(batch, "text"), batch.column(2).to_pylist(), strict=True):
                parts = (text.as_buffer() or pa.py_buffer(b"")).to_pybytes().split()
                n, gone = len(parts), 0
                if found:
                    out = covered(n, found, words)
                    gone = int(out.sum())
                    a, m = marked_runs(~out)
                    parts = [p for x, y in zip(a.tolist(), m.tolist(), strict=True) for p in parts[x : x + y]]
                kept = b" ".join(parts)
                rows.append((doc_id, n, gone, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 3, pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = by_document(docs, marks, run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if keep_text else out.drop("kept")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 20], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 19, 0))) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later
), word AS (SELECT doc_id, w[p + 1] AS x, p FROM (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d)
), kept AS (
  SELECT doc_id, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS t
  FROM word LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op9_phrase_dedup", SQL)
def op9_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup(table(spark, sf_dir, "documents"))
