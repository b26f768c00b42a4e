"""Queries that take all rows, held against plain Python where their namesakes' SQL keeps a part."""

import os
from collections import Counter, defaultdict

import pytest

from fieldlens.functions import geometry
from fieldlens.plans.catalog import QUERIES
from fieldlens.plans.fixtures import Tables

SF = "/root/testdata/sf0.001"


def got(spark, name):
    return QUERIES[name](spark, SF).collect()


def iou(a, b):
    w = max(0.0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]))
    h = max(0.0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))
    return w * h / (a["w"] * a["h"] + b["w"] * b["h"] - w * h)


def test_largest_errors(spark):
    a = [r.asDict() for r in Tables(spark, SF)["fx_detections"].collect()]
    b = [r | {"conf": r["conf"] - 0.001 * (r["image_id"] % 5 == 0), "x": r["x"] + 0.004 * (r["image_id"] % 3 == 0)} for r in a]
    conf = coord = 0.0
    several = 0
    for x, y in ((a, b), (b, a)):
        at = defaultdict(list)
        for r in y:
            at[r["image_id"], r["category"]].append(r)
        for r in x:
            near = [(-iou(r, q), q["det_ord"], q) for q in at[r["image_id"], r["category"]]]
            several += len(near) > 1
            best = min(near, key=lambda t: t[:2])
            if -best[0] >= 0.85:
                conf, coord = max(conf, abs(r["conf"] - best[2]["conf"])), max(coord, *(abs(r[k] - best[2][k]) for k in "xywh"))
            else:
                conf = max(conf, r["conf"])
    row = got(spark, "largest_errors_all")[0]
    assert several > 1000 and (row["conf_error"], row["coord_error"]) == (pytest.approx(conf), pytest.approx(coord))


def test_tile_grid(spark):
    want = Counter()
    for (i,) in Tables(spark, SF)["fx_images"].select("image_id").collect():
        for y in geometry.tile_starts(400 + i % 700, 640, 320):
            want.update((i, x, y) for x in geometry.tile_starts(600 + i % 900, 640, 320))
    assert Counter(map(tuple, got(spark, "tile_grid_all"))) == want


def test_common_ancestor(spark):
    t = Tables(spark, SF)
    region = {r["n_nationkey"]: r["n_regionkey"] for r in t["nation"].collect()}
    groups = defaultdict(set)
    for r in t["customer"].collect():
        groups[f"{r['c_mktsegment']}/{region[r['c_nationkey']]}"].add(r["c_nationkey"])
    want = {g: min(n) if len(n) == 1 else 1000 + int(g.split("/")[1]) for g, n in groups.items()}
    assert {r["group"]: r["node_id"] for r in got(spark, "taxonomy_common_ancestor_all")} == want


def test_crop_names(spark):
    rows = got(spark, "crop_names_all")
    assert len({r["image_id"] % 6 for r in rows}) == 6 and len(rows) == Tables(spark, SF)["fx_images"].count()
    for r in rows:
        name, ext = os.path.splitext(r["p"])
        assert r["crop"] == f"{name}.crop_{r['image_id'] % 12:03d}{ext}"


def test_image_status(spark):
    sets = defaultdict(set)
    for r in Tables(spark, SF)["fx_capture"].collect():
        sets[r["image_id"] // 3].add({"click": "empty", "view": "unknown"}.get(r["category"], r["category"]))
    kind = {"empty": "negative", "unknown": "unknown"}
    want = {}
    for i, names in sets.items():
        kinds = {kind.get(n, "positive") for n in names}
        want[i] = (kinds.pop() if len(kinds) == 1 else "ambiguous", next(iter(names)) if len(names) == 1 else None)
    assert {s for s, _ in want.values()} == {"negative", "positive", "unknown", "ambiguous"}
    assert {r["image_id"]: (r["status"], r["only"]) for r in got(spark, "image_status_all")} == want


def label_sets(spark):
    c = Tables(spark, SF)["fx_capture"].collect()
    names = sorted({r["category"] for r in c})
    truth, pred = defaultdict(set), defaultdict(set)
    for r in c:
        n = r["category"]
        truth[r["image_id"] // 3].add(n)
        pred[r["image_id"] // 3].add(names[(names.index(n) + 1) % len(names)] if r["image_id"] % 3 == 0 else n)
    return names, truth, pred


def test_multilabel_scores(spark):
    names, truth, pred = label_sets(spark)
    rows = {r["label"]: r for r in got(spark, "multilabel_scores_all")}
    assert set(rows) == set(names)
    for n in names:
        tp, fp, fn = (sum(p(n in truth[i], n in pred[i]) for i in truth) for p in (lambda t, p: t and p, lambda t, p: p and not t, lambda t, p: t and not p))
        r = rows[n]
        assert (r["tp"], r["fp"], r["fn"]) == (tp, fp, fn) and tp and fp + fn
        assert (r["precision"], r["recall"], r["f1"]) == (pytest.approx(tp / (tp + fp)), pytest.approx(tp / (tp + fn)), pytest.approx(2 * tp / (2 * tp + fp + fn)))


def test_cell_confusion(spark):
    _, truth, pred = label_sets(spark)
    want = Counter((t, p) for i in truth for t in truth[i] for p in pred[i] if not (t != p and p in truth[i] and t in pred[i]))
    assert {(r["truth"], r["pred"]): r["n"] for r in got(spark, "cell_confusion_all")} == want
