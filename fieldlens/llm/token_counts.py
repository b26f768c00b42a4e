"""Token counts under a unigram model, with forward scores shared along a trie.

A pre-token is a word (a run of other characters than ASCII white space) with a
mark before it. Its best segmentation has the greatest sum of the pieces'
log-probabilities, and of equal sums the fewest pieces; its length is the
token count. The forward score of a place depends only on the characters up to
it. Distinct pre-tokens go into a trie, a node of which is such a place, so the
forward step is done once for every shared prefix; the count at the end of a
pre-token is stored. A document's count is the sum over its pre-tokens.

The pieces are those of a public vocabulary file, in its order of rank; their
log-probabilities follow Zipf's law, -ln(rank + OFFSET). A character that no
piece has costs one token for each of its UTF-8 bytes, each at the score of
UNKNOWN.

Defined cases: a null text, or one of white space alone, has 0 pre-tokens and 0
tokens; a long run without white space is one pre-token; repeated rows are
counted each; an empty table gives an empty result. Tries and memos are emptied
when they reach MOST_NODES, which changes no count.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.registry import query, table
from fieldlens.llm.support import keeps, task_of, text_column

MARK, OFFSET, UNKNOWN, MOST_NODES, MOST_WORDS = "▁", 2.7, -30.0, 700_000, 500_000


@functools.lru_cache(2)
def pieces(path: str) -> dict[str, float]:
    """Log-probability of each ordinary piece of a sentencepiece vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    usual.sort(key=lambda i: (-sp.get_score(i), i))
    return {sp.id_to_piece(i): -math.log(rank + OFFSET) for rank, i in enumerate(usual)}


class Trie:
    """Counts of pre-tokens; forward states are kept by node."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=0)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best: list[float] = [0.0]
        self.tokens: list[int] = [0]
        self.terminal: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Tokens of a word's best segmentation, which is then stored."""
        if len(self.best) > MOST_NODES or len(self.terminal) > MOST_WORDS:
            self.clear()
        text = MARK + word.decode()
        # a text that has more characters than the trie may hold is walked with nodes of its own
        child, best, tokens, path = self.child, self.best, self.tokens, [0]
        for i, c in enumerate(text):
            key = path[-1] << 21 | ord(c)
            node = child.get(key)
            if node is None:
                top, fewest = -math.inf, 0
                for k in range(max(0, i + 1 - self.longest), i + 1):
                    s = self.scores.get(text[k : i + 1])
                    if s is not None:
                        s += best[path[k]]
                        n = tokens[path[k]] + 1
                        if s > top or s == top and n < fewest:
                            top, fewest = s, n
                if c not in self.scores:
                    n = len(c.encode())
                    s = best[path[i]] + n * UNKNOWN
                    if s > top or s == top and tokens[path[i]] + n < fewest:
                        top, fewest = s, tokens[path[i]] + n
                node = child[key] = len(best)
                best.append(top)
                tokens.append(fewest)
            path.append(node)
        out = self.terminal[word] = tokens[path[-1]]
        return out


@functools.lru_cache(2)
def trie(path: str) -> Trie:
    """The trie of a worker process, which its later tasks use again."""
    return Trie(pieces(path))


keeps("token_counts", trie.cache_clear)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("token_counts")
        t = trie(vocabulary)
        for batch in batches:
            words, counts = [], []
            for text in text_column(batch, "text"):
                parts = (text.as_buffer() or pa.py_buffer(b"")).to_pybytes().split()
                words.append(len(parts))
                known = t.terminal
                try:
                    counts.append(sum(map(known.__getitem__, parts)))
                except KeyError:
                    total = 0
                    for p in parts:
                        n = t.terminal.get(p)
                        total += t.count(p) if n is None else n
                    counts.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
