"""Operators against brute force, round trips and held-out accuracy, with the edge cases that they define."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldlens.llm import decontamination, exact_dedup, language_id, ngram_join, packing, phrase_dedup, suffix_dedup, token_counts, token_files, tokenize, url_reputation
from fieldlens.llm.registry import ship
from fieldlens.llm.support import components, work_path

WHITE = "[^\x20\x09-\x0d]+"
ODD = ["", " ", "  a  b ", "a\n b", "\n\n x", "Ünï  cødé ’s it's\tTab\u3000wide\u00a0nb", "x ", " x", "日本語 テスト", "é\u0301 a", "ÀB'S 12 345 <|endoftext|>b", "ǅ Σας ΣΑΣ", "foo \x1c bar\x85baz", "\u200b zero", "😀 😀👍🏽 x", "I'LL we'll 'ts", "..."]


ADDED = ["<|endoftext|>", "<|startoftext|>", "a <|endoftext|> b", "<|endoftext|>x", "é<|startoftext|>", "<|endoftext|><|startoftext|>  y", "A<|ENDOFTEXT|>z <|startoftext |>", " <|endoftext|>\n"]


def library(path: str):
    """text -> ids as bytes, by the library alone."""
    plain = Tokenizer.from_file(path)
    return lambda text: np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def prose(seed: int, words: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(["an", "the", "or", "ing", "es", "ti", "on"]) for _ in range(rnd.randint(1, 4))) for _ in range(words))


def corpus() -> list[tuple]:
    """(doc_id, text): repeats, near copies, shared passages, odd and null texts, a long one."""
    p = prose(0, 120)
    texts = [None, *ODD, prose(1, 300), prose(1, 300), prose(1, 300).replace("ing", "xx", 2), p, "start " + p + " end", p + " more " + p, prose(2, 60) + " " + p, "z " * 900, prose(3, 9000), prose(4, 19), prose(4, 20), prose(4, 21), prose(4, 3), prose(4, 3), *ADDED]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame([(i, t, "other", 1) for i, t in corpus()], "doc_id long, text string, keep_id string, rep int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    ship(spark)
    return spark.createDataFrame([], "doc_id long, text string")


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    byte, word, piece = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert url_reputation.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert language_id.predict(empty, language_id.fit_on(empty.selectExpr("doc_id as id", "text", "text as lang"))).count() == 0
    assert token_counts.token_counts(empty, piece).count() == 0
    assert packing.pack_documents(empty, byte).count() == 0
    assert decontamination.contamination(empty, bench).count() == 0
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert ngram_join.ngram_join(empty).count() == 0
    assert phrase_dedup.phrase_dedup(empty).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(empty, word, work_path(spark, "t"))).count() == 0


def test_exact_dedup(spark, docs):
    want = {}
    groups = defaultdict(list)
    for i, t in corpus():
        t = t or ""
        groups[re.sub("[\x20\x09-\x0d]", "", t)].append((-len(t), i))
    for key, rows in groups.items():
        for _, i in rows:
            want[i] = (min(rows)[1], len(rows), min(rows)[1] == i, hashlib.sha256(key.encode()).hexdigest())
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == want


def test_index_persists(spark, docs):
    path = work_path(spark, "index")
    first = exact_dedup.exact_dedup(docs, path)
    n = first.select("text_sha256").distinct().count()
    more = docs.filter("doc_id > 3").withColumn("doc_id", F.col("doc_id") + 1000).union(spark.createDataFrame([(5000, "quite new", "", 0)], docs.schema))
    again = exact_dedup.exact_dedup(more, path)
    assert [r["doc_id"] for r in again.filter("kept").collect()] == [5000]
    assert exact_dedup.DigestIndex(spark, path).rows().count() == n + 1


def test_urls(spark):
    rows = [(1, "http://A.Example.ORG/es/x?q"), (2, "x://example.org/en/12"), (3, "x://org"), (4, None), (5, "no scheme/org/"), (6, "x://b.com/fr/1#a"), (7, "x://b.com/de/"), (8, "x://badexample.org/es/"), (9, "x://c.net/p"), (9, "x://c.net/p")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2][2:] == ("example.org/en/1", "block") and got[3][:3] == ("org", "", None)
    assert got[4][:3] == ("", "", None) and got[5][:3] == ("", "", None)
    assert got[6][2:] == ("com/fr/", "allow") and got[7][2:] == ("com/de/", "block") and got[8][2:] == ("org/", "allow")


def test_urls_by_labelled_outcomes(spark):
    """A host is blocked by its evidence alone, and a new host by that of its domain; columns that clash don't matter."""
    rows = [(i, f"https://u:p@Shop.Bad.co.uk:8443/p/{i}", 1, "x", 0) for i in range(60)] + [(100 + i, f"https://w{i}.bad.co.uk./", 1, "x", 0) for i in range(40)]
    rows += [(200 + i, f"https://shop.fine.co.uk/p/{i}", 0, "x", 0) for i in range(60)] + [(300 + i, f"https://s{i}.fine.co.uk/p/{i}", 0, "x", 0) for i in range(40)]
    rows += [(400, "https://new.bad.co.uk/", None, "x", 0), (401, "https://new.fine.co.uk/", None, "x", 0), (402, "https://bad.co.uk/", None, "x", 0), (403, "https://10.0.0.1/", 0, "x", 0), (404, "https://shop.bad.co.uk/de", None, "x", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, label int, host string, key int")
    got = {r["page_id"]: (r["host"], r["verdict"]) for r in url_reputation.judge_urls(pages, outcome=F.col("label")).collect()}
    assert got[0] == ("u:p@shop.bad.co.uk:8443", "block") and got[404] == ("shop.bad.co.uk", "block") and got[200][1] == "allow"
    assert got[400][1] == "block" and got[402][1] == "block" and got[401][1] == "allow" and got[403][1] == "allow"
    parts = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "b.co.uk", "co.uk", "x.y.com", "com", "", "10.0.0.1")], "h string").select("h", *url_reputation.suffix_and_domain(F.col("h")))
    assert [tuple(r) for r in parts.collect()] == [("a.b.co.uk", "co.uk", "b.co.uk"), ("b.co.uk", "co.uk", "b.co.uk"), ("co.uk", "co.uk", "co.uk"), ("x.y.com", "com", "y.com"), ("com", "com", "com"), ("", "", ""), ("10.0.0.1", "10.0.0.1", "10.0.0.1")]


def test_rules_of_equal_length_and_repeated_pages(spark):
    pages = spark.createDataFrame([(1, "x://a.com/b/"), (1, "x://a.com/b/"), (2, "x://b.com/b/")], "page_id long, url string")
    got = sorted(map(tuple, url_reputation.judge_urls(pages, [("block", "a.com/b/"), ("allow", "com/b/"), ("allow", "b.com/b/")]).select("page_id", "rule", "verdict").collect()))
    assert got == [(1, "a.com/b/", "block")] * 2 + [(2, "b.com/b/", "allow")]


def test_reputation_shrinks(spark):
    rows = [("bad.x.net", 200, 190), ("good.x.net", 200, 2), ("new.x.net", 0, 0), ("few.y.net", 1, 1)]
    got = {r["host"]: (r["mean"], r["bound"]) for r in url_reputation.host_reputation(spark.createDataFrame(rows, "host string, n int, y int")).collect()}
    assert got["bad.x.net"][1] > 0.5 > got["good.x.net"][0] and got["few.y.net"][0] < 1 and got["new.x.net"][1] < got["new.x.net"][0]


def test_language_held_out(spark):
    ship(spark)
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.predict(d, language_id.train_on_documents(d)).join(d.select("doc_id", "lang"), "doc_id").filter(language_id.held_out(F.col("doc_id")))
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    assert found.agg(F.avg(F.col("rejected").cast("double"))).first()[0] < 0.02


def test_language_edges(spark, docs):
    model = language_id.fit(["the and of"] * 3 + ["der die das"] * 3, ["en"] * 3 + ["de"] * 3)
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    for i, t in corpus():
        r = got[i]
        if not any(map(str.isalpha, t or "")):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0, True)
        else:
            assert r["lang_pred"] in ("de", "en") and 0 <= r["score"] <= 1
    none = language_id.predict(docs, None)
    assert none.filter("lang_pred <> 'und'").count() == 0


def test_language_by_hand(spark, docs):
    """Predictions are the softmax of the mean of the scores of a text's grams, taken one by one; equal scores go to the first label."""
    model = language_id.fit(["the and of", "of the THE", "über die"] * 3 + ["der die das", "Die ÄRZTE"] * 3, ["en", "en", "de"] * 3 + ["de", "de"] * 3)
    got = {r["doc_id"]: r for r in language_id.predict(docs.union(docs), model).collect()}
    for i, t in corpus():
        if not any(map(str.isalpha, t or "")):
            continue
        u, c = language_id.counted(t)
        z = (c @ model.scores[u] + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i]["score"] == pytest.approx(p.max()) and got[i]["lang_pred"] == model.labels[int(p.argmax())], t
    even = language_id.LanguageModel(["a", "b"], np.zeros_like(model.scores), np.zeros(2))
    assert {r["lang_pred"] for r in language_id.predict(docs, even).collect()} == {"a", "und"}


def test_token_counts(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.pieces(path)

    def brute(word: str) -> int:
        t, best = token_counts.MARK + word, [(0.0, 0)]
        for i in range(1, len(t) + 1):
            c = [(best[k][0] + scores[t[k:i]], best[k][1] - 1) for k in range(max(0, i - 40), i) if t[k:i] in scores]
            if t[i - 1] not in scores:
                n = len(t[i - 1].encode())
                c.append((best[i - 1][0] + n * token_counts.UNKNOWN, best[i - 1][1] - n))
            best.append(max(c))
        return -best[-1][1]

    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in token_counts.token_counts(docs, path).collect()}
    for i, t in corpus():
        words = re.findall(WHITE, t or "")
        assert got[i] == (len(words), sum(brute(w) for w in words)), t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    e = tokenize.TextEncoder(public_tokenizers.path(name))
    rnd = random.Random(5)
    signs = ["a", "The", "é", " ", "  ", "\n", "'s", "12", ".", "!!", "日", "\t", "\u00a0", "ß", "İ", "<|endoftext|>", "<|startoftext|>", "<|", "|>"]
    whole = library(public_tokenizers.path(name))
    for t in [t for _, t in corpus() if t is not None] + ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 30))) for _ in range(2000)]:
        assert e.encode(t) == whole(t), t


def test_added_tokens_as_ordinary_text():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    for t in ADDED:
        assert tokenize.TextEncoder(path, added=False).encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_slots_do_not_depend_on_shares(spark, docs):
    """Many shares of a length give as full sequences as one."""
    pieces = packing.tokenized_pieces(docs.union(docs), public_tokenizers.path("byte_bpe_50k.json"), 64).cache()
    for share_rows in (1, 3, 10**6):
        rows = packing.best_fit_pack(pieces, 64, share_rows).collect()
        fill = defaultdict(list)
        for r in rows:
            fill[r["sequence_id"]].append((r["offset"], r["length"]))
        for s in fill.values():
            s.sort()
            assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 64
        assert len(rows) == pieces.count() and (share_rows == 1 or len(fill) == was)
        was = len(fill)


def test_packing(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(docs, path, size=256).collect()
    whole = library(path)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in corpus():
        ids = whole(t or "") + b"\0\0\0\0"
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts)))
        assert sum(p["length"] for p in parts) == len(ids) // 4 and all(p["length"] == 256 for p in parts[1:])
        for p in parts:
            assert p["ids_crc32"] == zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])])
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256
    total = sum(r["length"] for r in rows)
    assert len(by_seq) <= -(-total // 256) + 2


def test_plan_fills_best(spark):
    rnd = random.Random(3)
    for _ in range(30):
        counts = {rnd.randint(1, 64): rnd.randint(1, 40) for _ in range(rnd.randint(1, 20))}
        rows = packing.plan(counts, 64)
        fill = Counter()
        for n, c in sorted(counts.items(), reverse=True):
            own = sorted(r for r in rows if r[0] == n)
            for k in range(c):
                _, lo, first, off = max(r for r in own if r[1] <= k)
                assert fill[first + k - lo] == off
                fill[first + k - lo] += n
        assert max(fill.values()) <= 64


@pytest.mark.parametrize("short", [False, True])
def test_contamination(spark, docs, short):
    p = prose(0, 120).split()
    items = [(1, " ".join(p[5:40])), (2, " ".join(p[30:40]).upper()), (3, None), (4, "..."), (10, "not there at all in any of these texts, surely not"), (2, " ".join(p[90:105]))]
    items += [(7, " ".join(p[50:53])), (8, "Ünï")] if short else []
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    got = {r["doc_id"]: tuple(r)[1:] for r in decontamination.contamination(docs, bench).collect()}
    for i, t in corpus():
        w, hit, names = words(t), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    names |= ids
        assert got[i] == (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)), i


def test_contamination_of_greek_capitals(spark):
    w = ["ΟΔΟΣ", "ΝΟΜΟΣ", "ΤΟΠΟΣ", "ΛΟΓΟΣ", "ΧΡΟΝΟΣ", "ΚΟΣΜΟΣ", "ΔΡΟΜΟΣ", "ΦΙΛΟΣ", "ΗΛΙΟΣ", "ΑΝΕΜΟΣ", "ΒΙΟΣ", "ΤΡΟΠΟΣ"]
    for item, doc in ((".".join(w), " ".join(w)), (" ".join(w), ".".join(w)), (" ".join(w[:3]), "x " + ".".join(w[:3]) + ".Α")):
        bench = spark.createDataFrame([(1, item)], "item_id long, text string")
        docs = spark.createDataFrame([(1, doc), (2, doc.replace("ΟΔΟΣ", "ΟΔΟΙ").replace("ΤΟΠΟΣ", "ΤΟΠΟΙ"))], "doc_id long, text string")
        got = {r["doc_id"]: (r["n_hit"], r["contaminated"]) for r in decontamination.contamination(docs, bench).collect()}
        assert got[1] == (len(item.replace(".", " ").split()), True) and got[2] == (0, False)


@pytest.mark.parametrize("limits", [{}, {"most_contexts": 2, "shard_units": 3000}])
def test_suffix_dedup(spark, docs, limits):
    n, seen, want = 400, Counter(), {}
    raw = {i: (t or "").encode() for i, t in corpus()}
    for b in raw.values():
        seen.update(b[k : k + n] for k in range(len(b) - n + 1))
    for i, b in raw.items():
        out = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                out[k : k + n] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~out])
        want[i] = (len(b), int(out.sum()), int((np.diff(np.append(0, out.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(docs, suffix_dedup.windows(n, **limits)).collect()}
    assert got == want


def test_suffix_dedup_of_planted_passages(spark):
    """Passages of over 50 words in several documents go whole from 400 bytes on; shorter ones stay, as no 400-byte string recurs."""
    rows, want = [], {}
    for k, n in enumerate((330, 399, 400, 401, 900)):
        p = prose(900 + k, 400)[:n]
        assert len(p.split()) > 50
        for j in range(3):
            i = 3 * k + j
            rows.append((i, f"{prose(1000 + i, 80)} {j}{p}{j} {prose(1100 + i, 80)}"))
            want[i] = (len(rows[-1][1]), n if n >= 400 else 0, int(n >= 400))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.suffix_dedup(docs).collect()} == want


def test_run_length_index():
    rnd = random.Random(8)
    for _ in range(30):
        texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 60))).encode() * rnd.randint(1, 2) for _ in range(rnd.randint(1, 6))]
        text, at = suffix_dedup.join_texts(texts)
        index = suffix_dedup.RunLengthIndex(text)
        assert index.lengths.sum() == len(text) and len(index.heads) == len(index.first)
        best = index.matching_statistics()
        b = text.tobytes()
        for p in range(len(b)):
            top = 0
            for q in range(len(b)):
                if q != p:
                    k = 0
                    while max(p, q) + k < len(b) and b[p + k] == b[q + k]:
                        k += 1
                    top = max(top, k)
            assert best[p] == top


def test_run_length_index_first_text():
    """The first text's first suffix has no byte before it, and its match ends a run."""
    rnd = random.Random(8)
    shared = "".join(rnd.choice("abc") for _ in range(500)).encode()
    for n in (2, 10, 300):
        texts = [prose(i, 12).encode() for i in range(n)]
        texts[0], texts[-1] = shared + texts[0], shared + b"x" + texts[-1]
        text, at = suffix_dedup.join_texts(texts)
        best = suffix_dedup.RunLengthIndex(text).matching_statistics()
        assert best[at[0]] == best[at[-1]] == 500 + (texts[0][500:501] == b"x")
        seen = Counter(text[k : k + 30].tobytes() for k in range(len(text) - 29))
        assert ((best >= 30)[: len(text) - 29] == [seen[text[k : k + 30].tobytes()] > 1 for k in range(len(text) - 29)]).all()


@pytest.mark.parametrize("limits", [{"segment": 700}, {"segment": 450, "most_contexts": 1, "span_windows": 64, "shard_units": 1}, {"cores": 1}, {"cores": 2, "most_contexts": 1}])
def test_dedup_in_segments(spark, docs, limits):
    """Texts that are hashed in several segments, spans that are cut, shards of one key: the same results."""
    cores = limits.get("cores", 3)
    assert sorted(suffix_dedup.suffix_dedup(docs, suffix_dedup.windows(400, **limits)).collect()) == sorted(suffix_dedup.suffix_dedup(docs).collect())
    assert sorted(phrase_dedup.phrase_dedup(docs, phrase_dedup.windows(20, **{**limits, "segment": limits.get("segment", 50) // 10, "cores": cores})).collect()) == sorted(phrase_dedup.phrase_dedup(docs).collect())


def test_ngram_join(spark, docs):
    sets, classes = {}, {}
    for i, t in corpus():
        w = tuple(re.findall(WHITE, t or ""))
        sets[i] = (w, {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set())
        classes.setdefault(w, i)
    reps = sorted(i for w, i in classes.items() if w)
    root, links = {i: i for i in reps}, Counter()
    for x in reps:
        for y in reps:
            if x < y and len(sets[x][1] & sets[y][1]) >= 0.8 * len(sets[x][1] | sets[y][1]):
                links[x] += 1
                links[y] += 1
                a, b = sorted((root[x], root[y]))
                root = {k: a if v == b else v for k, v in root.items()}
    got = {r["doc_id"]: (r["class_id"], r["text_class"], r["n_links"]) for r in ngram_join.ngram_join(docs).collect()}
    for i, _ in corpus():
        w = sets[i][0]
        rep = classes[w] if w else i
        assert got[i] == ((root[rep], rep, links[rep]) if w else (i, i, 0)), i
    assert sum(links.values()) >= 2


def test_prefix_is_shortened_to_recall():
    d = ngram_join.prefix_depth(0.8, 16, 8, 0.999)
    assert 1 - (1 - 0.8**d) ** 16 >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** 16


@pytest.mark.parametrize("low, levels", [(0.97, 1), (0.81, ngram_join.DEPTH - 3)])
def test_prefixes_are_shortened_only_as_far_as_needed(spark, low, levels, monkeypatch):
    """Very alike pairs are found by whole labels; one pair near the limit makes the search go up to the least depth."""
    ship(spark)
    depths, linked_at = [], ngram_join.linked_at
    monkeypatch.setattr(ngram_join, "linked_at", lambda near, sets, depth, *rest: depths.append(depth) or linked_at(near, sets, depth, *rest))
    rows = []
    for i in range(30):
        w = [f"w{i}x{k}" for k in range(1000)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:500], "edit", *w[501:]]))]
    w = [f"low{k}" for k in range(1000)]
    cut = round(1000 * (1 - low) / (1 + low))
    rows += [(100, " ".join(w)), (101, " ".join([*w[cut:], *(f"new{k}" for k in range(cut))]))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (i // 2 * 2, 1) for i in range(60)) and got[100] == got[101] == (100, 1)
    assert len(depths) == levels and depths[0] == ngram_join.DEPTH


@pytest.mark.parametrize("block, words", [(4, 10**6), (192, 10**6), (1024, 1500)])
def test_near_family(spark, block, words, monkeypatch):
    ship(spark)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_WORDS", words)
    base = prose(11, 400).split()
    rows = [(i, " ".join(base[:i] + [f"edit{i}"] + base[i + 1 :])) for i in range(40)] + [(100 + i, prose(50 + i, 200)) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(d).collect()}
    assert all(got[i] == (0, 39) for i in range(40)) and all(got[100 + i] == (100 + i, 0) for i in range(20))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (105, 101), (7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 105: 100}


@pytest.mark.parametrize("limits", [{}, {"most_contexts": 2, "shard_units": 3000}])
def test_phrase_dedup(spark, docs, limits):
    n, first, want = 20, {}, {}
    words = {i: re.findall(WHITE, t or "") for i, t in corpus()}
    for i in sorted(words):
        w, out = words[i], set()
        for k in range(len(w) - n + 1):
            if first.setdefault(tuple(w[k : k + n]), (i, k)) != (i, k):
                out |= set(range(k, k + n))
        want[i] = (len(w), len(out), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in out).encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in phrase_dedup.phrase_dedup(docs, phrase_dedup.windows(n, **limits)).collect()}
    assert got == want


def test_word_codes():
    rng = np.random.default_rng(1)
    for k in range(150):
        v = (rng.integers(0, 2**63, size=k * 11, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) >> rng.integers(0, 64, size=1, dtype=np.uint64)
        v = np.where(rng.random(len(v)) < 0.3, 0, v >> rng.integers(0, 63, size=len(v), dtype=np.uint64)).astype(np.uint64)
        words, sizes = token_files.encode_words(v)
        assert (token_files.decode_words(words, sizes, len(v)) == v).all()
    zeros = np.zeros(5000, np.uint64)
    assert len(token_files.encode_words(zeros)[0]) <= 60


def test_token_files(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = library(path)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(token_files.write_token_files(docs, path, work_path(spark, "files"))).collect()}
    at = 0
    for i, t in corpus():
        ids = whole(t or "") + (1).to_bytes(4, "little")
        assert got[i] == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def test_repeated_rows(spark, docs):
    """Rows that repeat a doc_id come back as often as they went in."""
    twice = docs.union(docs)
    n = 2 * docs.count()
    assert exact_dedup.exact_dedup(twice).count() == n
    assert ngram_join.ngram_join(twice).count() == n
    assert decontamination.contamination(twice, spark.createDataFrame([(1, prose(0, 120))], "item_id long, text string")).count() == n
    for dedup in (suffix_dedup.suffix_dedup, phrase_dedup.phrase_dedup):  # they count as one text
        assert sorted(dedup(twice).collect()) == sorted(2 * dedup(docs).collect())
    other = docs.withColumn("text", F.substring("text", 1, 700))  # and so do others of that doc_id, of whatever length
    assert suffix_dedup.suffix_dedup(docs.union(other)).count() == phrase_dedup.phrase_dedup(docs.union(other)).count() == n
    assert token_files.read_token_files(token_files.write_token_files(twice, public_tokenizers.path("word_bpe_49k.json"), work_path(spark, "twice"))).count() == n
