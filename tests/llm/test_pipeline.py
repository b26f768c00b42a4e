"""The pipeline against plain Python, stage by stage and as a whole."""

import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_operators import library

SF = "/root/testdata/sf0.001"


def equal_groups(rows):
    best = {}
    for r in rows:
        key = re.sub("[\x20\x09-\x0d]", "", r["text"] or "")
        rank = (-len(r["text"] or ""), r["doc_id"])
        best[key] = min(best.get(key, rank), rank)
    return {i for _, i in best.values()}


def near_groups(rows):
    words = {r["doc_id"]: tuple(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for r in rows}
    sets = {i: {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in inverted[s]:
                shared[j] += 1
            inverted[s].append(i)
        for j, n in shared.items():
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in words if find(i) == i}


def leaks(rows, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = set()
    for t in items:
        w = words(t)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if w else 0)}
    sizes = {len(w) for w in windows}
    return {r["doc_id"] for r in rows if any(tuple(w[k : k + n]) in windows for w in [words(r["text"])] for n in sizes for k in range(len(w) - n + 1))}


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        docs = cp.materialize(stage(spark, docs, SF), f"test-{k}")
        out.append(docs)
    return out


def test_stages(spark, stages):
    docs, lang, exact, near, clean, packed = stages
    assert all(s.columns == docs.columns for s in stages[:5])
    rows = [d.collect() for d in stages[:5]]
    ids = [{r["doc_id"] for r in x} for x in rows]
    assert len(ids[1]) >= 0.98 * len(ids[0])
    assert ids[2] == equal_groups(rows[1])
    assert ids[3] == near_groups(rows[2])
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids[4] == ids[3] - leaks(rows[3], items)
    whole = library(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(dict)
    for r in packed.collect():
        pieces[r["doc_id"]][r["piece"]] = r
    assert set(pieces) == ids[4]
    for r in rows[4]:
        own = whole(r["text"] or "") + b"\0\0\0\0"
        for p in pieces[r["doc_id"]].values():
            assert p["ids_crc32"] == zlib.crc32(own[4 * p["start"] : 4 * (p["start"] + p["length"])])


def test_run(spark, stages):
    assert sorted(map(tuple, cp.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, stages[-1].select("doc_id", "piece", "ids_crc32").collect()))


def test_edges(spark):
    from fieldlens.llm.registry import ship

    ship(spark)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "the and of it", "en", "s", 13), (4, "the  and of it", "en", "s", 14), (5, "12 34", None, None, None)], schema)
    for rows in (docs, spark.createDataFrame([], schema)):
        for _, stage in cp.STAGES:
            rows = cp.materialize(stage(spark, rows, SF), "edge")
        assert set(rows.columns) >= {"doc_id", "piece", "sequence_id", "offset"}
    assert cp.exact_stage(spark, docs, SF).agg(F.sort_array(F.collect_list("doc_id"))).first()[0] == [1, 4, 5]


def test_rows_without_an_id_are_judged(spark):
    item = max((r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=lambda t: len((t or "").split()))
    words = [f"word{k}" for k in range(120)]
    near = " ".join([*words[:60], "other", *words[61:]])
    rows = [(1, " ".join(words)), (None, " ".join(words)), (None, near), (2, "some text of its own"), (None, "twice the same"), (None, "twice the same"), (None, "x " + item), (None, "alone"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def left(stage):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        return sorted(map(tuple, out.collect()), key=repr)

    def less(*gone):
        out = list(rows)
        for g in gone:
            out.remove(g)
        return sorted(out, key=repr)

    copy, twice = (None, " ".join(words)), (None, "twice the same")
    assert left(cp.exact_stage) == less(copy, twice)
    assert left(cp.near_stage) == less(copy, (None, near), twice)
    assert left(cp.benchmark_stage) == less((None, "x " + item))
