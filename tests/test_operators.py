import itertools
import json
import math

import pytest
from pyspark.sql import functions as F

from fieldlens import model
from fieldlens.functions import geometry, numbers, paths, strings, taxa, times
from fieldlens.operators import categories, combine, crops, evaluate, filters, overlap, sampling, smoothing, taxonomy, validate
from fieldlens.operators import sequences as seqs
from fieldlens.plans import format_queries
from fieldlens.sources import documents, formats, sinks
from fieldlens.streaming import sequences as streams


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def iou(a, b):
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def test_geometry(spark):
    def box(*v):
        return F.array(*[F.lit(float(x)) for x in v])

    assert one(spark, geometry.box_iou(box(0, 0, 1, 1), box(0, 0, 1, 1))) == 1
    assert one(spark, geometry.box_iou(box(0, 0, 1, 1), box(1, 0, 1, 1))) == 0
    assert one(spark, geometry.box_iou(box(0, 0, 0, 1), box(0, 0, 1, 1))) is None
    assert one(spark, geometry.gap(box(0, 0, 1, 1), box(4, 5, 6, 6))) == 5
    assert one(spark, geometry.center_to_corner(box(0.5, 0.5, 1, 1))) == [0, 0, 1, 1]
    assert geometry.tile_starts(1000, 400, 300) == [0, 300, 600]
    assert geometry.tile_starts(1001, 400, 300) == [0, 300, 600, 601]
    assert geometry.tile_starts(300, 400, 200) == [0]


def test_round(spark):
    import random

    rnd = random.Random(2)
    xs = [2.675, 0.0005, 2.5, 3.5, -1.234, -2.5, 0.0, 1.005] + [rnd.randrange(10**6) / 10 ** rnd.randrange(7) * rnd.choice([1, -1]) for _ in range(3000)]
    for p in (0, 1, 2, 3, 5):
        got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(numbers.round_to(F.col("x"), p)).collect()]
        assert got == [round(x, p) for x in xs]


def test_numbers(spark):
    assert one(spark, numbers.floor_to(F.lit(-1.2341), 3)) == -1.235
    assert one(spark, numbers.least_known(F.lit(None).cast("double"), F.lit(2.0))) == 2
    assert one(spark, numbers.same(F.lit(float("nan")), F.lit(float("nan"))))
    assert one(spark, numbers.is_sorted(F.array(F.lit(3), F.lit(2)), falling=True))


def test_paths(spark):
    assert one(spark, paths.before_extension(F.lit("a/b.c.jpg"), F.lit("x"))) == "a/b.c.x.jpg"
    assert one(spark, paths.tokens(F.lit("/a\\b/c"))) == ["/", "a", "b", "c"]
    assert one(spark, paths.last_folder_first(F.lit("a/b/c/d.jpg"))) == "b/c/a/d.jpg"
    assert one(spark, paths.camera_folder(F.lit("a\\b\\100RECNX\\x.jpg"))) == "a/b"
    assert one(spark, paths.flatten(F.lit("a:b/ç*d"))) == "a~b~cd"
    assert one(spark, paths.frame_name(F.lit(7))) == "frame000007.jpg"
    assert one(spark, paths.extension(F.lit(".hidden"))) == ""
    assert one(spark, paths.dated_name(F.lit("a/b.jpg"), F.lit("2020:01:02 03:04:05"))) == "a_b.2020-01-02-03-04-05.jpg"


def test_strings(spark):
    for s, n in (("2G", 2 * 1024**3), ("10KB", 10240), ("1.5M", 1.5 * 1024**2), ("", 0), ("B", 0), ("x", 0), ("12", 12)):
        assert one(spark, strings.to_bytes(F.lit(s))) == n, s
    assert one(spark, strings.without_ansi(F.lit("\x1b[31mred\x1b[0m"))) == "red"
    assert one(spark, strings.slug(F.lit("  Héllo, Wörld -- x "))) == "hello-world-x"
    assert one(spark, strings.key_value(F.lit("a = b=c")))["value"] == "b=c"
    assert one(spark, strings.parse_bool(F.lit(" YES "))) is True
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, strings.parse_bool(F.lit("maybe")))
    url = "https://x.blob.core.windows.net/c?sig=1"
    assert one(spark, strings.inside_signed_url(F.lit(url), F.lit("a b#c"))) == "https://x.blob.core.windows.net/c/a%20b%23c?sig=1"
    assert one(spark, strings.inside_signed_url(F.lit("http://x/c"), F.lit("a"))) is None
    assert one(spark, strings.bucket_path(F.lit("gs://b/a/d/f_thumb.jpg"))) == "d/f.jpg"


def test_taxa(spark):
    for s, name in (("g;mammalia;carnivora;felidae;panthera;uncia;snow leopard", "snow leopard"), ("g;mammalia;carnivora;phocidae;;;", "phocidae family"), ("g;mammalia;primates;hominidae;homo;;", "homo species"), ("g;;;;;;animal", "animal"), ("g;aves;anseriformes;;;;", "anseriformes order"), (";;;;;;", "empty_prediction_string")):
        assert one(spark, taxa.display_name(F.lit(s))) == name
    assert one(spark, taxa.five_tokens(F.lit("g;a;b;c;d;e;x|h;;;;;;"))) == "a;b;c;d;e"
    assert one(spark, taxa.level_of_name(F.lit("genus"))) == 6


@pytest.mark.parametrize(("text", "want"), [("x 2021-03 -04 05:06:07 y", "2021-03-04 05:06:07"), ("03/04/2021 5:06:07 PM", "2021-03-04 17:06:07"), ("no date", None), ("2021/03/04  12:00 am", "2021-03-04 00:00:00")])
def test_dates_in_text(spark, text, want):
    got = one(spark, F.date_format(times.find_in_text(F.lit(text)), "yyyy-MM-dd HH:mm:ss"))
    assert got == want


DOC = {
    "info": {"format_version": "1.5", "detector": "m"},
    "detection_categories": {"1": "animal", "2": "person"},
    "classification_categories": {"0": "deer"},
    "images": [
        {"file": "b.jpg", "detections": [{"category": "1", "conf": 0.5, "bbox": [0.1, 0.1, 0.2, 0.2], "classifications": [["0", 0.9]]}, {"category": "2", "conf": 0.9, "bbox": [0, 0, 1, 1]}]},
        {"file": "a\\x.jpg", "detections": []},
        {"file": "c.jpg", "failure": "unreadable", "detections": None},
    ],
}


def test_document_round_trip(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(DOC))
    docs = documents.read_results(spark, str(tmp_path / "d.json"))
    images = documents.image_table(docs)
    got = {r["file"]: r for r in images.collect()}
    assert got["a/x.jpg"]["detections"] == [] and got["c.jpg"]["detections"] is None and got["b.jpg"]["max_detection_conf"] == 0.9
    assert got["b.jpg"]["detections"][0]["classifications"][0]["conf"] == 0.9
    rows = model.open_detections(images)
    assert rows.count() == 4
    back = {r["file"]: r["detections"] for r in model.close_detections(rows).collect()}
    assert back["a/x.jpg"] == [] and back["c.jpg"] is None and [d["conf"] for d in back["b.jpg"]] == [0.5, 0.9]
    sinks.write_document(images.select("file", "failure", "detections"), str(tmp_path / "out"), DOC["info"], DOC["detection_categories"], DOC["classification_categories"])
    again = documents.image_table(documents.read_results(spark, str(tmp_path / "out")))
    r = {x["file"]: x["detections"] for x in again.collect()}
    assert [d["conf"] for d in r["b.jpg"]] == [0.9, 0.5] and r["c.jpg"] is None and r["a/x.jpg"] == []
    table = {x["image_path"]: x for x in sinks.csv_table(images, DOC["detection_categories"]).collect()}
    assert table["b.jpg"]["max_conf_person"] == 0.9 and table["c.jpg"]["detections"] == "unreadable"


def test_predictions(spark, tmp_path):
    p = {"predictions": [{"filepath": "a.jpg", "classifications": {"classes": ["g;m;;;;;x"], "scores": [0.7]}, "detections": []}, {"filepath": "b.jpg", "failures": ["DETECTOR"]}]}
    (tmp_path / "p.json").write_text(json.dumps(p))
    r = {x["file"]: x for x in documents.image_table(documents.read_results(spark, str(tmp_path / "p.json"))).collect()}
    assert r["b.jpg"]["detections"] is None and r["b.jpg"]["failure"]
    assert r["a.jpg"]["detections"][0]["bbox"] == [0, 0, 1, 1] and r["a.jpg"]["detections"][0]["classifications"][0]["id"] == "0"


def test_merged_caches_of_many_documents(spark, tmp_path, monkeypatch):
    def doc(*files, names=DOC["detection_categories"]):
        return json.dumps({"info": DOC["info"], "detection_categories": names, "images": [{"file": f, "detections": []} for f in files]}) + "\n"

    for name, text in (("a", doc("1.jpg", "2.jpg") + doc("3.jpg")), ("b", doc("4.jpg"))):
        (tmp_path / name).write_text(text)
    both = [str(tmp_path / n) for n in "ab"]
    assert sorted(r["file"] for r in documents.merge_caches(spark, both, per_line=True).collect()) == ["1.jpg", "2.jpg", "3.jpg", "4.jpg"]
    (tmp_path / "b").write_text(doc("4.jpg") + doc("5.jpg", names={"1": "other"}))
    with pytest.raises(ValueError, match="categories"):
        documents.merge_caches(spark, both, per_line=True)

    # the documents of the query have a bounded size, however large its tables are
    merge, seen = documents.merge_caches, []
    monkeypatch.setattr(documents, "merge_caches", lambda s, path, **how: seen.append(path) or merge(s, path, **how))
    format_queries.merged_documents(spark, "/root/testdata/sf0.01")
    sizes = [len(json.loads(r["value"])["images"]) for r in spark.read.text(seen[0]).collect()]
    assert sum(sizes) == 15000 and max(sizes) <= format_queries.BATCH


def test_annotation_db(spark, tmp_path):
    db = {"images": [{"id": "1", "file_name": "x/A.jpg", "width": 10, "height": 20, "location": "l"}, {"id": "2", "file_name": "y.jpg", "width": 10, "height": 20, "location": "m"}], "annotations": [{"id": "a", "image_id": "1", "category_id": 2, "bbox": [1, 2, 5, 10]}, {"id": "b", "image_id": "1", "category_id": 1}], "categories": [{"id": 1, "name": "Deer"}, {"id": 2, "name": "Fox"}]}
    (tmp_path / "db.json").write_text(json.dumps(db))
    d = documents.AnnotationDb(spark, str(tmp_path / "db.json"))
    assert {r["id"]: r["classes"] for r in d.classes_of_images().collect()} == {"1": ["deer", "fox"], "2": []}
    found = {r["file"]: r["detections"] for r in sinks.detections_from_annotations(d.images, d.annotations).collect()}
    assert found["y.jpg"] == [] and found["x/A.jpg"][0]["bbox"] == [0.1, 0.1, 0.5, 0.5] and found["x/A.jpg"][0]["conf"] == 1.0
    assert d.subset("a.JPG", ignore_case=True)[1].count() == 2
    assert validate.annotation_db(d.images, d.annotations.filter("bbox is not null"), d.categories).count() == 0


def test_nms(spark):
    boxes = [(0.9, [0, 0, 1, 1]), (0.8, [0.05, 0, 1, 1]), (0.7, [5, 5, 1, 1]), (0.95, [0, 0, 1, 1])]
    df = spark.createDataFrame([([{"conf": c, "bbox": list(map(float, b)), "category": "1"} for c, b in boxes],)], "d array<struct<conf:double,bbox:array<double>,category:string>>")
    got = df.select(overlap.suppressed(F.col("d"), 0.45).alias("k")).first()["k"]
    assert [d["conf"] for d in got] == [0.95, 0.7]
    assert all(iou(a["bbox"], b["bbox"]) <= 0.45 for a, b in itertools.combinations(got, 2))


def test_grid_equals_plain_join(spark):
    import random

    rnd = random.Random(4)
    rows = [(k, 0, rnd.random(), rnd.random(), rnd.choice([0.1, 0.11, 0.2, 0.5]), rnd.choice([0.1, 0.12, 0.3])) for k in range(300)]
    d = spark.createDataFrame(rows, "image_id long, key int, x double, y double, w double, h double")
    for t in (0.3, 0.7, 0.9):
        a = {(r["a_image_id"], r["b_image_id"]) for r in overlap.overlaps(d, d, ["key"], t).collect()}
        b = [(r["a_image_id"], r["b_image_id"]) for r in overlap.overlaps(d, d, ["key"], t, grid=True).collect()]
        assert len(b) == len(set(b)) and set(b) == a


def test_repeats(spark):
    rows = [(i, 0, "l", 1, 0.9, 0.1, 0.1, 0.2, 0.2) for i in range(5)] + [(9, 0, "l", 1, 0.9, 0.6, 0.6, 0.2, 0.2)]
    d = spark.createDataFrame(rows, "image_id long, det_ord long, location string, category int, conf double, x double, y double, w double, h double")
    r = overlap.repeated(d, 0.9, 3)
    assert {x["image_id"] for x in r.collect()} == set(range(5))
    neg = {x["image_id"]: x["conf"] for x in overlap.negated(d, r).collect()}
    assert neg[0] == -0.9 and neg[9] == 0.9


def test_smoothing_passes(spark):
    rows = [("g", i, "1", 0.9, c, 0.9) for i, c in enumerate(["deer"] * 5 + ["other", "fox"])]
    d = spark.createDataFrame(rows, "image_id string, det_ord long, category string, conf double, class string, class_conf double")
    assert [r["class"] for r in smoothing.smooth(d).orderBy("det_ord").collect()] == ["deer"] * 7
    tax = spark.createDataFrame([("deer", "mammalia;cervidae"), ("other", ""), ("fox", "mammalia;canidae"), ("red deer", "mammalia;cervidae;cervus")], "class string, description string")
    d2 = spark.createDataFrame([("g", i, "1", 0.9, c, 0.9) for i, c in enumerate(["deer", "deer", "red deer"])], d.schema)
    assert [r["class"] for r in smoothing.smooth(d2, descriptions=tax).orderBy("det_ord").collect()] == ["red deer"] * 3
    assert smoothing.count_text(smoothing.class_counts(d)).first()["text"] == "deer (5), other (1), fox (1)"


def test_sequences_gap_and_null(spark):
    rows = [(1, "l", "2020-01-01 00:00:00"), (2, "l", "2020-01-01 00:01:00"), (3, "l", "2020-01-01 00:02:01"), (4, "l", None), (5, "l", None)]
    d = spark.createDataFrame(rows, "image_id long, location string, t string").withColumn("captured_at", F.to_timestamp("t"))
    got = {r["image_id"]: (r["seq_index"], r["frame_num"]) for r in seqs.sequences(d).collect()}
    assert got == {1: (0, 0), 2: (0, 1), 3: (1, 0), 4: (2, 0), 5: (3, 0)}


def test_motion_history_is_a_fold(spark):
    m = [float(i % 5) for i in range(600)]
    d = spark.createDataFrame([("c", i, x) for i, x in enumerate(m)], "camera string, frame_number int, motion double")
    got = [r["history"] for r in seqs.motion_history(d.limit(200), 0.9).orderBy("frame_number").collect()]
    h = 0.0
    for i, x in enumerate(m[:200]):
        h = 0.9 * h + x
        assert got[i] == pytest.approx(h)


def test_motion_history_has_no_restart(spark):
    m = {c: [float((i * k) % 5) for i in range(600)] for c, k in (("c", 1), ("d", 3))}
    d = spark.createDataFrame([(c, i, x) for c in m for i, x in enumerate(m[c])], "camera string, frame_number int, motion double").repartition(7)
    for decay in (0.9, 0.999, 0.01, 0.0):
        got = {(r["camera"], r["frame_number"]): r["history"] for r in seqs.motion_history(d, decay).collect()}
        assert len(got) == 1200
        for c in m:
            h = 0.0
            for i, x in enumerate(m[c]):
                h = decay * h + x
                assert got[c, i] == pytest.approx(h)


def test_motion_image(spark):
    values = [0, 0, 100] + [100] * 7 + [0] + [0] * 300 + [90, 90]
    d = spark.createDataFrame([("c", p, i, v if p else 0) for p in (0, 1) for i, v in enumerate(values)], "camera string, pixel int, frame_number int, value int").repartition(3)
    got = {(r["pixel"], r["frame_number"]): r["mhi"] for r in seqs.motion_image(d, 25, 5.0).collect()}
    assert [got[1, i] for i in range(12)] == [0, 0, 255, 204, 153, 102, 51, 0, 0, 0, 255, 204]
    assert [got[1, i] for i in (310, 311, 312)] == [0, 255, 204] and {got[0, i] for i in range(len(values))} == {0}


def test_categories(spark):
    d = spark.createDataFrame([("1",), ("9",)], "category string")
    assert [r[0] for r in categories.remapped(d, {"1": "a"}, {}, {"4": "a"}).collect()] == ["4", "5"]
    with pytest.raises(Exception, match="no target"):
        categories.remapped(d, {"1": "a"}, {}, {"4": "a"}, invalid="error").collect()
    m = one(spark, categories.inverted(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("x"))))
    assert m == {"x": "b"}


def test_combine_unique_raises(spark):
    a = spark.createDataFrame([("f", [1])], "file string, detections array<int>")
    with pytest.raises(Exception, match="repeated"):
        combine.combined([a, a]).collect()


def test_evaluate_edges(spark):
    assert evaluate.equivalent_threshold(spark.createDataFrame([(0.5,)], "conf double"), spark.createDataFrame([], "conf double"), 0.2).first()["threshold"] is None
    s = spark.createDataFrame([(["a", "b"], ["b", "a"])], "truth array<string>, pred array<string>")
    assert {(r["truth"], r["pred"]): r["n"] for r in evaluate.multilabel_confusion(s).collect()} == {("a", "a"): 1, ("b", "b"): 1}


def test_crops_and_sampling(spark):
    img = spark.createDataFrame([("a.jpg", [("1", 0.1), ("1", 0.9)])], "file string, detections array<struct<category:string,conf:double>>").withColumn("detections", F.transform("detections", lambda d: d.withField("bbox", F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))))))
    assert [(r["crop_id"], r["crop_file"]) for r in crops.crop_table(img, 0.5).collect()] == [(1, "a.crop_001.jpg")]
    ids = spark.range(100).select(F.col("id").alias("image_id"))
    assert sampling.sample(ids, 10, 1).collect() == sampling.sample(ids.repartition(7), 10, 1).collect()
    c = spark.createDataFrame([("x", f"l{i}", 10) for i in range(10)], "label string, location string, n int")
    s = dict(sampling.greedy_split(c, 0.2, 0.2))
    assert sorted(s.values()) == ["test"] * 2 + ["train"] * 6 + ["val"] * 2


def best_split(counts, seeds, share, limits, weights, limit=0.1):
    import random

    places, kinds = sorted({r[0] for r in counts}), sorted({r[1] for r in counts})
    total = {k: sum(n for _, c, n in counts if c == k) for k in kinds}
    found = []
    for seed in range(seeds):
        val = random.Random(seed).sample(places, int(share * len(places)))
        f = {k: sum(n for p, c, n in counts if c == k and p in val) / total[k] for k in kinds}
        e = {k: abs(f[k] - share) for k in kinds}
        if all(0 < f[k] < 1 and e[k] <= limits.get(k, limit) for k in kinds):
            found.append((sum(e[k] * weights.get(k, 1.0) for k in kinds) / len(kinds), seed, sorted(val)))
    return min(found, default=None)


def test_split_search(spark):
    import random

    rnd = random.Random(1)
    counts = [(f"l{i:02d}", k, rnd.randrange(1, 30)) for i in range(40) for k in ("deer", "fox") if rnd.random() < 0.8]
    counts += [("l03", "lynx", 5), ("l17", "lynx", 20), ("l30", "lynx", 9), ("l31", "lynx", 9)]  # skewed: often only in one part
    d = spark.createDataFrame(counts, "location string, category string, n int").repartition(5)
    for limits, weights in (({"lynx": 0.9}, {}), ({"lynx": 0.3}, {"lynx": 0.1, "fox": 3.0})):
        error, seed, val = best_split(counts, 300, 0.15, limits, weights)
        got = sampling.split_search(d, 300, 0.15, limits, weights).collect()
        assert sorted(r["location"] for r in got) == val and {r["seed"] for r in got} == {seed} and got[0]["error"] == pytest.approx(error)
    with pytest.raises(Exception, match="no split"):
        sampling.split_search(d.filter("category <> 'lynx' or location = 'l03'"), 50, most_error=None).collect()


def test_split_locations_of_all_places(spark):
    from fieldlens.plans.catalog import QUERIES
    from fieldlens.plans.fixtures import Tables

    n = Tables(spark, "/root/testdata/sf0.001")["fx_images"].select("location").distinct().count()
    assert QUERIES["split_locations"](spark, "/root/testdata/sf0.001").select("location").distinct().count() == int(0.15 * n)


def test_split_random(spark):
    import numpy as np

    counts = [(k, f"l{i:02d}", 1 + (i * j) % 7) for i in range(30) for j, k in enumerate(("deer", "fox", "lynx")) if i % (j + 1) == 0]
    d = spark.createDataFrame(counts, "label string, location string, n int").repartition(4)
    for val, test in ((0.2, 0.2), (0.2, 0.0)):
        want = {"train": 1 - val - test, "val": val} | ({"test": test} if test else {})
        best = None
        for seed in range(60):
            rnd = np.random.default_rng(seed)
            a = int(30 * (want["train"] + rnd.uniform(-0.03, 0.03)))
            b = a + int(30 * (val + rnd.uniform(-0.03, 0.03))) if test else 30
            order = [f"l{i:02d}" for i in rnd.permutation(30)]
            split = {"train": order[:a], "val": order[a:b], "test": order[b:]}
            score = 0.0
            for s, t in want.items():
                for k in ("deer", "fox", "lynx"):
                    of = [(p, n) for c, p, n in counts if c == k]
                    score += 2 * (sum(n for p, n in of if p in split[s]) / sum(n for _, n in of) - t) ** 2 + (sum(p in split[s] for p, _ in of) / len(of) - t) ** 2
            if best is None or score < best[0] - 1e-12:
                best = (score, seed, {p: s for s in want for p in split[s]})
        got = sampling.split_random(d, val, test, 60).collect()
        assert {r["location"]: r["split"] for r in got} == best[2] and got[0]["score"] == pytest.approx(best[0])


def test_formats(spark):
    rows = spark.createDataFrame([(0, "a.jpg", 1, 0.9, 0.0, 0.0, 0.5, 0.5, "deer", 0.8), (1, "a.jpg", 1, 0.8, 0.0, 0.0, 0.5, 0.5, "fox", 0.7)], "row_no int, file string, category int, detection_conf double, bbox1 double, bbox2 double, bbox3 double, bbox4 double, class string, classification_conf double")
    r = formats.from_rows(rows).first()
    assert [d["classifications"][0]["id"] for d in r["detections"]] == ["0", "1"]
    lines = spark.createDataFrame([("f", 0, "0 0.5 0.5 1 1"), ("f", 1, "# no"), ("f", 2, "x 1")], "file string, line_no int, line string")
    assert formats.from_label_lines(lines.filter("line_no < 2")).first()["detections"][0]["bbox"] == [0, 0, 1, 1]
    assert {r["line_no"]: r["error"] for r in validate.label_lines(lines, [0]).collect()} == {2: "tokens"}
    assert one(spark, formats.label_classes(F.lit("names:\n  0: deer\n  1: fox\n"))) == {0: "deer", 1: "fox"}
    img = spark.createDataFrame([("a", "f.jpg", 100, 50), ("b", "g.jpg", 1, 1), ("c", "h.jpg", 1, 1)], "image_id string, file string, width int, height int")
    det = spark.createDataFrame([("a", 0, [10.0, 5.0, 50.0, 25.0], 0.12345), ("b", -1, [0.0] * 4, 0.0)], "image_id string, category_id int, bbox array<double>, score double")
    got = {r["file"]: r for r in formats.from_flat_detections(det, img).collect()}
    assert got["f.jpg"]["detections"][0]["bbox"] == [0.1, 0.1, 0.5, 0.5] and got["g.jpg"]["failure"] and got["h.jpg"]["detections"] == []


def test_taxonomy_text(spark):
    e = one(spark, taxonomy.parse_entries(F.lit("[(3, 'species', 'panthera leo', ['lion', 'african lion']), (2, 'genus', 'panthera', [])]")))
    assert e[0]["common"] == ["lion", "african lion"] and e[1]["name"] == "panthera"
    rules = spark.createDataFrame([("t", {"USA": ["CA"]}, None)], "taxon string, allow map<string,array<string>>, block map<string,array<string>>")
    regions = spark.createDataFrame([("USA", "CA"), ("USA", "TX"), ("CAN", None)], "country string, state string")
    r = taxonomy.geofence_matrix(rules, regions).first().asDict()
    assert r["USA:CA"] == 1 and r["USA:TX"] is None and r["CAN"] is None
    assert taxonomy.block_all_except("t", {"A", "B"}, set(), {"B", "C"}) == ["t,allow,C,", "t,block,A,"]


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(i % 3, f"2020-01-01 00:{i:02d}:00", "a") for i in range(0, 50, 4)]
    d = spark.createDataFrame(rows, "location int, t string, category string").select("location", F.to_timestamp("t").alias("captured_at"), "category")
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = streams.session_counts(s, 300, "1 second").writeStream.format("memory").queryName("sessions").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("sessions").collect()}
    assert got == {tuple(r) for r in streams.session_counts(d, 300, "1 second").collect()} and got


def test_detector_failure_is_data(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / n).write_bytes(n.encode())

    def detect(content):
        if content == b"b":
            raise ValueError("bad")
        return [{"category": "1", "conf": 0.5, "bbox": [0.0, 0.0, 1.0, 1.0]}]

    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r["file"][-1]: r for r in streams.detector_rows(files, detect).collect()}
    assert got["b"]["failure"] and got["b"]["detections"] is None and got["a"]["detections"][0]["conf"] == 0.5


def test_filters_keep_failed(spark):
    d = spark.createDataFrame([("a", None, [("1", 0.1)]), ("b", "x", None)], "file string, failure string, detections array<struct<category:string,conf:double>>")
    got = {r["file"]: r["detections"] for r in filters.by_confidence(d, 0.5).collect()}
    assert got == {"a": [], "b": None}


def test_exif(spark, tmp_path):
    def tag(t, kind, n, value):
        return t.to_bytes(2, "big") + kind.to_bytes(2, "big") + n.to_bytes(4, "big") + value

    text = b"2021:02:03 04:05:06\0"
    body = b"MM\0*" + (8).to_bytes(4, "big") + (1).to_bytes(2, "big") + tag(0x9003, 2, 20, (26).to_bytes(4, "big")) + b"\0\0\0\0" + text
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xe1\0\0Exif\0\0" + body)
    (tmp_path / "b.jpg").write_bytes(b"nothing")
    got = {r["path"][-5:]: r["tags"] for r in documents.read_exif(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": {"taken": "2021:02:03 04:05:06"}, "b.jpg": {}}
    assert documents.header_size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")) == (7, 9)
    tags = F.create_map(*map(F.lit, ("lat", "10,30,0", "lat_ref", "S", "lon", "20,0,0", "lon_ref", "E")))
    assert tuple(one(spark, documents.position(tags))) == (-10.5, 20.0)


def test_lookups(spark):
    assert one(spark, documents.model_version(F.lit("x/md_v5a.0.0.pt"))) == "v5a"
    assert one(spark, documents.model_version(F.lit("a_v5a_v4.pt"), first_only=False)) == "multiple"
    assert one(spark, documents.usual_threshold(F.lit(None).cast("string"), F.lit("model_v4.1.pb"))) == 0.8
    assert one(spark, documents.usual_threshold(F.lit("0.3"), F.lit("model_v4.1.pb"))) == 0.3


def test_ordering(spark):
    d = spark.createDataFrame([(2,), (None,), (1,)], "k int")
    assert [r[0] for r in evaluate.ordered(d, "k").collect()] == [None, 1, 2]
    assert [r[0] for r in evaluate.ordered(d, "k", falling=True).collect()] == [2, 1, None]
    assert [r[0] for r in evaluate.ordered(d, "k", nulls="largest").collect()] == [1, 2, None]
    with pytest.raises(Exception, match="null k"):
        evaluate.ordered(d, "k", nulls="error").collect()
    m = F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(1))
    assert [e["key"] for e in one(spark, evaluate.sorted_map(m, by_value=True))] == ["b", "a"]


def test_place_order(spark):
    rows = [("l", 0, 0.50, 0.5, 0.1, 0.1), ("l", 1, 0.10, 0.1, 0.1, 0.1), ("l", 2, 0.52, 0.5, 0.1, 0.1), ("l", 3, 0.12, 0.1, 0.1, 0.1)]
    d = spark.createDataFrame(rows, "location string, cluster long, x double, y double, w double, h double")
    assert {r["cluster"]: r["place"] for r in overlap.by_place(d).collect()} == {1: 0, 3: 1, 0: 2, 2: 3}


def dense_places(rows, threshold):
    """(location, cluster) to place by a full distance matrix."""
    import numpy as np

    out = {}
    for loc in {r[0] for r in rows}:
        at = sorted((r for r in rows if r[0] == loc), key=lambda r: r[1])
        c = np.array([(x + w / 2, y + h / 2) for _, _, x, y, w, h in at])
        far = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2))
        np.fill_diagonal(far, np.inf)
        group = {i: [i] for i in range(len(c))}
        while True:
            i, j = np.unravel_index(np.argmin(far), far.shape)
            if not far[i, j] < threshold:
                break
            far[i] = np.maximum(far[i], far[j])
            far[:, i] = far[i]
            far[j] = far[:, j] = np.inf
            group[i] += group.pop(j)
        order = sorted(group, key=lambda g: (math.fsum(at[i][2] for i in group[g]) / len(group[g]), g))
        flat = [i for g in order for i in sorted(group[g], key=lambda i: (c[i, 0], i))]
        out |= {(loc, at[i][1]): k for k, i in enumerate(flat)}
    return out


def test_place_order_equals_dense(spark):
    import random

    rnd = random.Random(6)
    free = [("a", k, rnd.random(), rnd.random(), rnd.random() / 5, rnd.random() / 5) for k in range(250)]
    ties = [("b", k, rnd.randrange(11) * 0.05, rnd.randrange(9) * 0.05, rnd.randrange(1, 5) / 10, rnd.randrange(1, 5) / 10) for k in range(300)]
    apart = [("c", k, rnd.choice([0.0, 5.0]) + rnd.random() / 8, rnd.choice([0.0, 3.0]) + rnd.random() / 8, 0.1, 0.1) for k in range(60)]
    rows = free + ties + apart
    d = spark.createDataFrame(rows, "location string, cluster long, x double, y double, w double, h double")
    for t in (0.1, 0.03):
        assert {(r["location"], r["cluster"]): r["place"] for r in overlap.by_place(d.repartition(5), t).collect()} == dense_places(rows, t)


def test_review_order_takes_all_boxes(spark):
    from fieldlens.plans.catalog import QUERIES
    from fieldlens.plans.fixtures import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    boxes = t["fx_detections"].join(t["fx_images"].select("image_id", "location"), "image_id").select("location", "x", "y", "w", "h").distinct()
    assert QUERIES["review_order"](spark, "/root/testdata/sf0.001").count() == boxes.count()


def test_shapes_to_lines(spark):
    s = spark.createDataFrame([("f", 11, 11, [("a", "rectangle", [[-5.0, 0.0], [5.0, 10.0]]), ("a", "rectangle", [[50.0, 50.0], [60.0, 60.0]])])], "file string, width int, height int, shapes array<struct<label:string,shape_type:string,points:array<array<double>>>>")
    assert formats.lines_from_shapes(s, {"a": 3}).first()["text"] == "3 0.250 0.500 0.500 1.000"
    assert sinks.dataset_yaml("d", ["x"], train="t") == "path: d\ntrain: t\nnames:\n  0: x\n"


def test_payload(spark):
    d = spark.createDataFrame([("f",)], "id string")
    p = d.select(sinks.payload("id", "p", F.lit("a;b;c;d;e;f;g")).alias("j"))
    assert p.select(sinks.payload_errors(F.col("j")).alias("e")).first()["e"] == []


def test_running_sums(spark):
    import random

    from fieldlens.operators.running import ranked, running

    rnd = random.Random(9)
    keys = rnd.sample(range(10**6), 3000)
    d = spark.createDataFrame([(k / 7, k % 11) for k in keys], "k double, v long").repartition(6)
    for falling in (False, True):
        got = {r["k"]: r["s"] for r in running(d, "k", {"s": "v"}, falling).collect()}
        total = 0
        for k in sorted(keys, reverse=falling):
            total += k % 11
            assert got[k / 7] == total
    assert [r["rank"] for r in ranked(d, "k").orderBy("k").collect()] == list(range(3000))
    assert running(d.filter("k < 0"), "k", {"s": "v"}).count() == 0
    c = sampling.n_chunks(d, 7, "k").groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in c] == [429] * 4 + [428] * 3
