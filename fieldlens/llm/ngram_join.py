"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

1. Texts with the same words are one class; its id is the least doc_id.
2. A class has the set of its 5-word shingles and, in each of TREES trees, a
   label of DEPTH MinHash values. A tree is the prefix trie of its labels; a node
   is known by the hash of its prefix, so a class has a path of nodes in each
   tree, and the classes below a node are those with its id on their path.
3. The forest is searched from the leaves up. At first, pairs with equal whole
   labels in some tree are candidates and are verified on their two whole
   shingle sets. Then the matched prefixes are shortened by one value at a time
   and the pairs that this adds are verified, until a pair as unlike as the least
   similar link found so far is found with the target recall. No prefix is
   shortened beyond the depth (4) at which this holds for pairs at the
   similarity limit itself.
4. The members below a node are compared block against block, in rows of bounded
   size, and a pair only at its longest match, in the first tree that has it, so
   that no pair is made twice. Nodes without a pair of their own are left out
   from aggregates alone: those below which all go on to one child, or share a
   node of an earlier tree.

Defined cases: a null text, or one without words, has no shingles, is a class
for itself and has no links; a text of fewer than 5 words is one shingle; words
are runs of other characters than ASCII white space, unchanged; repeated rows of
a doc_id are each returned, in one class if their texts agree; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm import kernels
from fieldlens.llm.registry import query, table
from fieldlens.llm.support import buffers, chunks, components, groups, materialize, mix64, small, task_of, temporary, text_column

SHINGLE, LIMIT, TREES, DEPTH, RECALL = 5, 0.8, 16, 5, 0.999
#: Members, and words of these, of a block of the classes below a node.
BLOCK, BLOCK_WORDS = 1024, 1_500_000


def found_with(similarity: float, trees: int, depth: int) -> float:
    """The chance that two texts share a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(limit: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix with which a pair at the limit is found with that recall."""
    for d in range(depth, 0, -1):
        if found_with(limit, trees, d) >= recall:
            return d
    return 1


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, words' borders, shingle hashes, shingles' borders) of texts; a text of fewer than k words has one shingle."""
    first, end, border = kernels.words(data, offsets)
    h = kernels.word_hashes(data, first, end)
    n = np.diff(border)
    g = kernels.gram_hashes(np.append(h, np.zeros(k, np.uint64)), k)
    keep = np.zeros(len(h) + 1, bool)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    starts = np.repeat(border[:-1], counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    keep[starts] = True
    out = g[starts]
    for i in np.flatnonzero((n > 0) & (n < k)):  # short texts
        short = h[border[i] : border[i + 1]]
        out[int(np.cumsum(counts)[i]) - 1] = mix64(kernels.gram_hashes(short, len(short)) + np.uint64(len(short)))[0]
    return h, border, out, np.append(0, np.cumsum(counts))


def labels(docs: DataFrame, floor: int, depth: int = DEPTH, trees: int = TREES, seed: int = 11) -> DataFrame:
    """doc_id, k1, k2 (128 bits of the words' sequence), n_words, paths: the nodes of the trees at depth floor, then those at each depth below."""
    values = depth * trees
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, values, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("kernels")
        for batch in batches:
            data, offsets = buffers(text_column(batch, "text"))
            for i, j in chunks(offsets):
                h, border, g, at = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n, full = np.diff(border), np.flatnonzero(np.diff(at))
                place = (np.arange(len(h)) - np.repeat(border[:-1], n)).astype(np.uint64)
                ids = []
                for salt in (1, 2):
                    s = np.append(np.uint64(0), np.cumsum(mix64(h + mix64(place + np.uint64(salt << 40)))))
                    ids.append((s[border[1:]] - s[border[:-1]]).view(np.int64))
                paths = np.zeros((j - i, depth - floor + 1, trees), np.uint64)
                if len(full):
                    cuts = at[:-1][full]
                    for tree in range(trees):
                        node = np.zeros(len(full), np.uint64)
                        for d in range(1, depth + 1):
                            v = tree * depth + d - 1
                            node = mix64(node + np.minimum.reduceat((g * a[v] + b[v]) >> np.uint64(32), cuts) + np.uint64(v + 1))
                            if d >= floor:
                                paths[full, d - floor, tree] = node
                width = trees * (depth - floor + 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * width), pa.array(paths.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(ids[0]), pa.array(ids[1]), pa.array(n.astype(np.int64)), lists], names=["doc_id", "k1", "k2", "n_words", "paths"])

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, n_words long, paths array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """rep, shingles: the sorted distinct shingle hashes of each text, as 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("kernels")
        for batch in batches:
            data, offsets = buffers(text_column(batch, "text"))
            for i, j in chunks(offsets):
                _, _, g, at = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sets = [np.unique(g[at[q] : at[q + 1]]).tobytes() for q in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return docs.mapInArrow(run, "rep long, shingles binary")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a block with all of another."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left])
    parts = left + right
    _, codes = np.unique(np.concatenate(parts), return_inverse=True)
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    out = np.zeros((len(left), len(right)))
    width = max(256, (1 << 22) // len(parts))
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    for c in range(0, int(codes[-1]) + 1 if len(codes) else 0, width):
        a, b = np.searchsorted(codes, [c, c + width])
        bits = np.zeros((len(parts), width), np.float32)
        bits[owner[a:b], codes[a:b] - c] = 1
        out += bits[: len(left)] @ bits[len(left) :].T
    return out.round().astype(np.int64)


def verified(members: DataFrame, limit: float) -> DataFrame:
    """members: task, tree, side (0, 1: of a pair of blocks; 2: of a block with itself), rep, keys (nodes at this depth in all trees), deeper (those one deeper, or null), shingles.

    Returns rep, links, root, least: the links that the task found for rep, the
    least class of those it is connected with there, and the least similarity of
    its links. A pair counts if it matches no deeper in any tree, and in the first
    tree in which it matches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("kernels")
        for t in groups(batches):
            tree = t.column("tree")[0].as_py()
            side, rep = t.column("side").to_numpy(), t.column("rep").to_numpy()
            keys, deeper = (np.array(t.column(c).to_pylist(), dtype=np.int64) if t.column(c).null_count == 0 else None for c in ("keys", "deeper"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles").combine_chunks()]
            lefts, rights = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            if not len(lefts) or not len(rights):
                continue
            link = (keys[lefts, tree][:, None] == keys[rights, tree]) & (rep[lefts][:, None] != rep[rights])
            for e in range(tree):  # pairs that an earlier tree has
                link &= keys[lefts, e][:, None] != keys[rights, e]
            for e in range(keys.shape[1] if deeper is not None else 0):  # pairs that were found before
                link &= deeper[lefts, e][:, None] != deeper[rights, e]
            some, others = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
            if not len(some):
                continue
            lefts, rights, link = lefts[some], rights[others], link[np.ix_(some, others)]
            both = intersections([sets[q] for q in lefts], [sets[q] for q in rights])
            sizes = np.array([len(x) for x in sets])
            union = sizes[lefts][:, None] + sizes[rights] - both
            link &= both >= limit * union - 1e-9
            root = rep.copy()
            x, y = np.nonzero(link)
            alike = both[x, y] / union[x, y]
            x, y = lefts[x], rights[y]
            while True:  # least label along links
                low = root.copy()
                np.minimum.at(low, x, root[y])
                np.minimum.at(low, y, root[x])
                if (low == root).all():
                    break
                root = low
            links, least = np.zeros(len(rep), np.int64), np.ones(len(rep))
            np.add.at(links, x, 1)
            np.minimum.at(least, x, alike)
            if (side != 2).any():
                np.add.at(links, y, 1)
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(links[hit]), pa.array(root[hit]), pa.array(least[hit])], names=["rep", "links", "root", "least"])

    ordered = members.select("task", "tree", "side", "rep", "keys", "deeper", "shingles").repartition("task").sortWithinPartitions("task")
    return ordered.mapInArrow(run, "rep long, links long, root long, least double")


def linked_at(near: DataFrame, sets: DataFrame, depth: int, trees: int, limit: float) -> DataFrame:
    """Links of the pairs whose longest match has that depth. near: rep, n_words, keys, deeper (as in verified())."""
    leaves = near.select("rep", "n_words", "deeper", F.posexplode("keys").alias("tree", "node"))
    leaves = leaves.select("rep", "n_words", "tree", "node", F.element_at("deeper", F.col("tree") + 1).alias("child"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_words") / BLOCK_WORDS)).cast("int").alias("blocks")
    nodes = leaves.groupBy("tree", "node").agg(blocks, F.count(F.lit(1)).alias("n"), (F.min("child") == F.max("child")).alias("one_child"))
    nodes = materialize(nodes.filter((F.col("n") > 1) & ~F.coalesce("one_child", F.lit(False))).select("tree", "node", "blocks"), "nodes")
    members = leaves.select("rep", "tree", "node").join(nodes, ["tree", "node"])
    members = materialize(members.join(near.select("rep", "keys", "deeper"), "rep"), "members")
    spread = [(F.min(F.col("keys")[e]) == F.max(F.col("keys")[e])).alias(f"e{e}") for e in range(trees)]
    own = F.lit(True)
    for e in range(trees - 1):  # else all its pairs are below an earlier tree's node
        own = own & ~(F.col(f"e{e}") & (F.col("tree") > e))
    own = materialize(members.groupBy("tree", "node").agg(*spread).filter(own).select("tree", "node"), "own-nodes")
    rows = members.join(own, ["tree", "node"]).withColumn("block", F.pmod(F.xxhash64("rep", "node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("tree", "node", F.least("block", "other"), F.greatest("block", "other"))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    rows = rows.select(task.alias("task"), "tree", side.alias("side"), "rep", "keys", "deeper")
    return materialize(verified(rows.join(sets, "rep"), limit), "links")


def ngram_join(docs: DataFrame, limit: float = LIMIT, recall: float = RECALL, trees: int = TREES, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its near-duplicate group), text_class (of its words), n_links (other text classes that are linked to it)."""
    kept: list[DataFrame] = []
    with temporary(docs.sparkSession, kept):
        rows, by_class = _classes(docs, limit, recall, trees, id_col, text_col, depth, kept)
    out = rows.join(by_class, ["k1", "k2"], "left")
    alone = (F.col("n_words") == 0) | F.col("rep").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("root", "rep")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("rep")).alias("text_class"),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
    )


def _classes(docs: DataFrame, limit: float, recall: float, trees: int, id_col: str, text_col: str, depth: int, kept: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, n_words of all documents; k1, k2, rep, n_links, root of all classes); kept gets the tables that these read."""
    floor = prefix_depth(limit, trees, depth, recall)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(labels(docs, floor, depth, trees), "labels")
    classes = rows.filter("n_words > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_words").alias("n_words"), F.first("paths").alias("paths"))
    classes = materialize(classes, "classes")
    # whoever matches at any depth also does at the least one, where most classes have no other below their nodes
    roots = classes.filter("rep is not null").select("rep", F.posexplode(F.slice("paths", 1, trees)).alias("tree", "node"))
    shared = materialize(roots.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("tree", "node"), "shared")
    wanted = materialize(roots.join(shared, ["tree", "node"]).select("rep").distinct(), "wanted")
    near = materialize(classes.join(small(wanted, 2_000_000), "rep").select("rep", "n_words", "paths"), "near")
    one = docs.join(small(wanted.select(F.col("rep").alias("doc_id")), 2_000_000), "doc_id", "left_semi")  # a rep's text; of repeated rows of a doc_id any of that class
    sets = materialize(shingle_sets(one), "shingle-sets").dropDuplicates(["rep"])
    found = None
    for d in range(depth, floor - 1, -1):
        keys = F.slice("paths", (d - floor) * trees + 1, trees).alias("keys")
        deeper = F.slice("paths", (d + 1 - floor) * trees + 1, trees) if d < depth else F.lit(None).cast("array<long>")
        links = linked_at(near.select("rep", "n_words", keys, deeper.alias("deeper")), sets, d, trees, limit)
        found = links if found is None else found.union(links)
        least = found.agg(F.min("least")).first()[0]
        if least is not None and found_with(least, trees, d) >= recall:
            break
    links = found.groupBy("rep").agg(F.sum("links").alias("n_links"))
    groups_of = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    marks = materialize(links.join(groups_of, F.col("rep") == F.col("node"), "left").select("rep", "n_links", F.coalesce("root", "rep").alias("root")), "marks")
    kept += [rows, classes, marks]
    return rows.select("doc_id", "k1", "k2", "n_words"), classes.join(small(marks), "rep", "left").select("k1", "k2", "rep", "n_links", "root")


@query("op8_ngram_join")
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
