"""Golden cases of the detection operators, and the driver queries against DuckDB on the smallest data."""

import json
import os
import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boxloom.errors import DatasetBuildError, ManifestError, ParseFormatError
from boxloom.functions import geometry as G
from boxloom.functions import text as X
from boxloom.functions import paths
from boxloom.operators import convert, masks, matching, messages, parsing, records, stats, sync
from boxloom.plans import queries as plans
from boxloom.plans.oracle import ORACLE
from boxloom.sources import detection, manifest, sinks

SF = "/root/testdata/sf0.001"


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(col).first()[0]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    got, want = plans.QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    show = lambda v: "" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    rows = lambda d: sorted(tuple(show(x) for x in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("xywh,want", [
    ([10.2, 20.7, 30.1, 5.1], (10, 20, 41, 26)), ([-5.0, -5.0, 20.0, 20.0], (0, 0, 15, 15)), ([190.0, 90.0, 50.0, 50.0], (190, 90, 200, 100)),
    ([10.5, 10.5, 0.2, 0.2], (10, 10, 11, 11)), ([10.0, 10.0, 0.0, 5.0], (10, 10, 10, 15)), ([300.0, 10.0, 5.0, 5.0], (200, 10, 200, 15)),
])
def test_clip(spark, xywh, want):
    assert tuple(one(spark, G.xywh_to_xyxy(*map(F.lit, xywh), F.lit(200), F.lit(100)))) == want


@pytest.mark.parametrize("v,want", [((.5, .5, .5, .5), (50, 25, 100, 50)), ((.05, .5, .2, .2), (0, 40, 40, 20)), ((.95, .5, .2, .2), (170, 40, 30, 20))])
def test_yolo(spark, v, want):
    assert tuple(one(spark, G.yolo_to_xywh(*map(F.lit, v), F.lit(200), F.lit(100)))) == pytest.approx(want)


ANSWERS = [
    ("<rotor,100,200,500,800>", True, [(20, 20, 100, 80, 1)], 0), ("<rotor,500,800,100,200>", True, [(20, 20, 100, 80, 1)], 0),
    ("<rotor|100|200|500|800>", True, [(20, 20, 100, 80, 1)], 0), ("<rotor,-50,-50,1200,1200>", True, [(0, 0, 200, 100, 1)], 0),
    ("<rotor,12.5,0,17.5,500>", True, [(2, 0, 4, 50, 1)], 0), ("<rotor,0,0,0,0>", True, [(0, 0, 1, 1, 1)], 0),
    ("<rotor,500,500,500,500>", False, [], 1), ("<rotor,1000,1000,1000,1000>", True, [(199, 99, 200, 100, 1)], 0),
    ("<bolt,100,200,500,800>", True, [(20, 20, 100, 80, -1)], 0), ("<rotor,100,200,500,800>;<rotor,500,500,500,500>", True, [(20, 20, 100, 80, 1)], 1),
    ("", True, [], 0), ("NONE", True, [], 0), ("[]", True, [], 0), ("hello", False, [], 1), (None, True, [], 0),
    ("x</think><answer>a</answer><answer><rotor,100,200,500,800></answer>", True, [(20, 20, 100, 80, 1)], 0),
    ("```text\n<rotor,100,200,500,800>\n```", True, [(20, 20, 100, 80, 1)], 0), ("'<rotor,100,200,500,800>'", True, [(20, 20, 100, 80, 1)], 0),
]


def test_answers(spark):
    df = spark.createDataFrame([(k, a[0]) for k, a in enumerate(ANSWERS)], "k int, t string").withColumns({"width": F.lit(200), "height": F.lit(100)})
    ids = F.create_map(F.lit("rotor"), F.lit(1).cast("bigint"))
    got = parsing.parse_answers(df, "t", "tag_bbox_list", ids=ids).orderBy("k").collect()
    for (text, valid, boxes, errors), r in zip(ANSWERS, got):
        p = r["parsed"]
        assert (p["valid"], [(*a["bbox"], a["label_id"]) for a in p["annotations"]], len(p["errors"])) == (valid, boxes, errors), text
    strict = parsing.parse_answers(df.filter("k = 8"), "t", "tag_bbox_list", ids=ids, strict=True).first()["parsed"]
    assert not strict["valid"] and len(strict["errors"]) == 1
    with pytest.raises(ParseFormatError):
        parsing.parse_answers(df, "t", "xml")


def test_places_are_rounded_as_binary_numbers(spark):
    rng = np.random.default_rng(6)
    values = [*(rng.integers(0, 20_000, 3000) / 20_000), *rng.random(500), *np.nextafter(rng.integers(0, 20_000, 300) / 20_000, 1), 0.12345, 0.00005, 0.5, -0.12345, 1.00005, 0.0, 1e-9]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", G.rounded(F.col("v"), 4).alias("r"))
    assert [(r["v"], r["r"]) for r in df.collect() if r["r"] != round(r["v"], 4)] == []


def test_json_answers(spark):
    texts = ['[{"class":"PET","box":[0,0,500,500]}]', '[["PET",0,0,500,500]]', "[('PET', 0, 0, 500, 500)]", "[]", "nothing", '[{"box":[1,2,3,4]}]']
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumns({"width": F.lit(200), "height": F.lit(100)})
    got = [r["parsed"] for r in parsing.parse_answers(df, "t", "json_bbox_list").orderBy("k").collect()]
    assert [[tuple(a["bbox"]) for a in p["annotations"]] for p in got] == [[(0, 0, 100, 50)]] * 3 + [[]] * 3
    assert [p["valid"] for p in got] == [True] * 4 + [False] * 2


def test_items_are_read_alike_in_both(spark):
    """What the JVM reads equals what Python reads, and plain literals need no Python."""
    plain = [
        "[]", "[{'class': 'PET', 'box': (1, 2.5, 3, 4)}]", '[{"label": "a\\"b", "bbox": [1,2,3,4]}]', "[('PET', 0, -1, 5e2, 1.5), ['x', 1, 2, 3, None],]", "[{'class': 'it is \"x\"', 'box': [1, 2, 3]}]",
        "x [{'class': '(None) [True', 'box': [1, 2, 3, 4],},] y", '[{"class": "", "label": "b", "box": [], "bbox": [1, 2, 3, 4]}]', "[{'box': [1,2,3,4]}, 5, 'a', None, [1, 2], {}]", '[{"category": "", "bbox_2d": []}]',
        "[[None, 1, 2, 3, 4]]", "[{'class': None, 'category': 'c', 'bbox': [1,2,3,4]}]", '["a]", ["b", 1, 2, 3, 4]]', "none", "", None, "no list", "] [", "[1, 2", '[{"class": "a", "box": null}]']
    odd = [
        "[{'class': 5, 'box': [1,2,3,4]}]", "[['a', '1', ' 2', 'x', 4]]", "[{'class': 'a\\'b', 'box': [1,2,3,4]}]", "[(5)]", "['a', true]", "[{'class': 'a' 'b', 'box': [1, 2, 3, 0x10]}]", "[[True, 1, 2, 3, 4]]",
        "[{1: 2}]", "[nan]", "[{'class': 'a', 'box': '1,2,3,4'}]", '[{"class": "a", "class": "b", "box": [1,2,3,4]}]', "[{'class': 'a', 'box': [True, 2, 3, 4]}]", "[foo]", "[{'label': ['a'], 'box': [1,2,3,4]}]", "[[1.0, 1, 2, 3, 4]]"]
    df = spark.createDataFrame(list(enumerate(plain + odd)), "k int, t string")
    rows = parsing.read_items(df, "t").withColumn("p", parsing._json_items("t")).orderBy("k").collect()
    show = lambda r: ([(i["label"], i["coords"], i["bad"]) for i in r["items"]], r["problem"])
    for r in rows:
        assert show(r["_read"]) == show(r["p"]), r["t"]
    assert [r["t"] for r in rows if r["_in_python"]] == odd


def test_items_are_opened_once(spark):
    """An item's kind is told by one expression, a text is cut at each mark by one, whatever reads them; odd numbers and parts come out as Python has them."""
    df = spark.createDataFrame([("[]", 200, 100)], "t string, width int, height int")
    plan = parsing.parse_answers(df, "t", "json_bbox_list")._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    assert {k: text.count(k) for k in ("schemaOfVariant", "</think>", "<answer>")} == {"schemaOfVariant": 1, "</think>": 1, "<answer>": 1}
    texts = [
        '[{"class":"a","box":[null,1,2,3],"bbox":[5,6,7,8]}]', '[["a",12345678901234567890,1,2,1e3]]', '[["a\\"]b",-5,1.25,2,null]]', '[{"class":"a","box":[12345678901234567890,1.5,null,4]}]', '[["a","1",2,3,true]]',
        '[{"meta":{"class":5},"class":"a","box":[1,2,3,4]}]', '[{"my class":5,"class":"a","box":[1,"2",[3],4]}]', '[{"label":"L","class":null,"box":null,"bbox_2d":[1,2,3,4]}]', '[[["a"],1,2,3,4], {}, [], null, "x"]', '[{"class":"a","box":{}}]']
    for r in parsing.read_items(spark.createDataFrame([(t,) for t in texts], "t string"), "t").withColumn("p", parsing._json_items("t")).collect():
        assert r["_read"] == r["p"], r["t"]


def test_strip_takes_white_space_of_unicode(spark):
    df = spark.range(1, 0x3100).select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c")).select(F.concat("c", F.lit(" x"), "c", F.lit("y "), "c").alias("t"))
    assert df.filter(X.strip(F.col("t")) != F.regexp_replace("t", "(?U)^\\s+|\\s+$", "")).count() == 0


def test_metrics_golden(spark):
    schema = "sample_id string, label string, x1 double, y1 double, x2 double, y2 double, idx int"
    gt = spark.createDataFrame([("s1", "rotor", 0., 0., 10., 10., 0), ("s1", "rotor", 20., 20., 30., 30., 1), ("s2", "rotor", 0., 0., 5., 5., 0)], schema)
    pred = spark.createDataFrame([("s1", "rotor", 0., 0., 10., 10., 0), ("s1", "rotor", 20., 20., 30., 25., 1), ("s1", "copper", 50., 50., 60., 60., 2)], schema)
    m = {r["threshold"]: r for r in matching.metrics_by_threshold(gt, pred, [0.5, 0.75]).collect()}
    assert [(m[.5][k]) for k in ("tp", "fp", "fn")] == [2, 1, 1] and m[.5]["mean_iou_tp"] == 0.75 and m[.5]["miou_gt_penalized"] == 0.5
    assert [(m[.75][k]) for k in ("tp", "fp", "fn")] == [1, 2, 2] and m[.75]["mean_iou_tp"] == 1.0 and m[.75]["f1"] == pytest.approx(1 / 3)
    assert matching.best_by_f1(matching.metrics_by_threshold(gt, pred, [0.5, 0.75])).first()["best_threshold"] == 0.5
    status = {(r["side"], r["status"]): 1 for r in matching.box_status(matching.match_boxes(gt, pred, 0.5)).collect()}
    assert set(status) == {("gt", "TP"), ("gt", "FN"), ("pred", "TP"), ("pred", "FP")}
    with pytest.raises(DatasetBuildError):
        matching.metrics_by_threshold(gt, pred, [])


def greedy_by_hand(gt, pred, least, aware):
    def overlap(a, b):
        w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
        inter = max(0.0, w) * max(0.0, h)
        union = (a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - inter
        return inter / union if union > 0 else 0.0

    pairs = sorted((-overlap(a, b), i, j) for i, a in enumerate(gt) for j, b in enumerate(pred) if (a[0] == b[0] or not aware) and overlap(a, b) >= least)
    out, used_g, used_p = [], set(), set()
    for neg, i, j in pairs:
        if i not in used_g and j not in used_p:
            out.append((-neg, i, j))
            used_g.add(i)
            used_p.add(j)
    return out


@pytest.mark.parametrize("aware", [True, False])
def test_crowded_samples_match_alike(spark, aware):
    """One huge box among small ones, boxes that only touch, without extent or not finite, negative places, equal boxes."""
    rng = np.random.default_rng(8)

    def boxes(n):
        c, e = rng.uniform(-200, 200, (n, 2)), rng.exponential(25, (n, 2))
        out = [("ab"[k % 2], *c[k].round(1).tolist(), *(c[k] + e[k]).round(1).tolist()) for k in range(n)]
        return [*out, ("a", -1e6, -1e6, 1e6, 1e6), ("a", 5.0, 5.0, 5.0, 9.0), ("a", 9.0, 9.0, 3.0, 3.0), out[3], out[3], ("b", 0.0, 0.0, 10.0, 10.0), ("b", 10.0, 0.0, 20.0, 10.0)]

    sides = {s: (boxes(70), boxes(90)) for s in ("x", "y", "z")}
    schema = "sample_id string, label string, x1 double, y1 double, x2 double, y2 double, idx int"
    frame = lambda k: spark.createDataFrame([(s, *b, i) for s, both in sides.items() for i, b in enumerate(both[k])] + [(None, "a", 0.0, 0.0, 1.0, 1.0, 0)], schema)
    for least in (matching.TINY, 0.3):
        for crowded in (0, matching.CROWDED):
            got = {r["sample_id"]: [tuple(m) for m in r["matches"]] for r in matching.match_boxes(frame(0), frame(1), least, aware, crowded=crowded).collect()}
            assert got.pop(None) == [(1.0, 0, 0)]
            assert got == {s: greedy_by_hand(*both, least, aware) for s, both in sides.items()}


@pytest.mark.parametrize("aware", [True, False])
@pytest.mark.parametrize("least", [0.0, matching.TINY, 0.4])
def test_matches_of_many_rows_equal_the_fold(spark, least, aware, monkeypatch):
    """Boxes with ties, without extent, without corners or labels, not finite and no numbers; samples of one side only."""
    rng = np.random.default_rng(5)
    odd = [None, float("nan"), float("inf"), -float("inf")]
    rows = []
    for s in range(60):
        for side in (0, 1):
            for i in range(int(rng.integers(0, 9))):
                x, y = rng.integers(0, 6, 2).astype(float).tolist()
                box = [x, y, x + float(rng.integers(-1, 5)), y + float(rng.integers(0, 5))]
                if rng.random() < 0.1:
                    box[int(rng.integers(0, 4))] = odd[int(rng.integers(0, 4))]
                rows.append((s, side, i + 3 * side, [None, "a", "b"][int(rng.integers(0, 3))], *box))
    df = spark.createDataFrame(rows, "sample_id long, side int, idx int, label string, x1 double, y1 double, x2 double, y2 double")
    both = matching.side_by_side(df.filter("side = 0"), df.filter("side = 1")).withColumn("c", matching.candidates(least, aware))
    want = both.select("sample_id", "gt", "pred", matching.greedy(F.col("c"), F.size("gt"), F.size("pred")).alias("m"), matching.matched(least, aware)("gt", "pred").alias("n")).collect()
    show = lambda m: [(str(x["iou"]), x["gt_idx"], x["pred_idx"]) for x in m]
    assert [show(r["n"]) for r in want] == [show(r["m"]) for r in want] and any(r["m"] for r in want)


def test_many_pairs_are_matched_quickly():
    """By a fold over columns, a pair took microseconds."""
    n, side = 5_000, 16
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 60, (n * side, 2))
    boxes = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(side), n)), pa.array(["a"] * n * side), *map(pa.array, (*xy.T, *(xy + 20).T))], ["idx", "label", "x1", "y1", "x2", "y2"])
    rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * side, pa.int32()), boxes)
    start = time.time()
    assert len(matching.matched(matching.TINY, False).func(rows, rows).flatten()) == n * side
    assert time.time() - start < 3


def test_five_thousand_boxes_a_side(spark):
    """With all pairs this would take minutes and gigabytes in one row."""
    at = lambda shift: spark.range(5000).select(F.lit("s").alias("sample_id"), F.lit("a").alias("label"), *[((F.col("id") % 100) * 10 + shift + d).cast("double").alias(c) for c, d in (("x1", 0), ("x2", 8))],
                                                *[(F.floor(F.col("id") / 100) * 10 + d).cast("double").alias(c) for c, d in (("y1", 0), ("y2", 8))], F.col("id").cast("int").alias("idx"))
    row = matching.match_boxes(at(0), at(3)).first()
    assert len(row["matches"]) == 5000 and all(m["gt_idx"] == m["pred_idx"] for m in row["matches"]) and row["unmatched_gt"] == []


def test_best_summary_nan_last(spark):
    df = spark.createDataFrame([("a", .1, float("nan"), 0), ("a", .5, .4, 1), ("a", .7, .4, 2)], "model string, threshold double, f1 double, row_no int")
    assert matching.best_summary(df).first()["best_threshold"] == .7


def test_stats(spark):
    df = spark.createDataFrame([(1.,), (2.,), (3.,), (10.,)], "v double")
    r = stats.numeric_stats(df, "v", max_length=5).first()
    assert (r["mean"], r["median"], r["num_over_max_length"]) == (4, 2.5, 1) and r["std"] == pytest.approx(3.5355339059327378) and r["p99"] == pytest.approx(9.79)
    assert stats.numeric_stats(df.limit(0), "v").first()["mean"] is None and stats.numeric_stats(df.limit(0), "v").first()["p90"] is None
    rng = np.random.default_rng(0)
    groups = {"a": rng.lognormal(0, 8, 60_001), "b": np.repeat([3.0, 7.0], [9, 30_000]), None: -rng.integers(0, 50, 20_000).astype(float), "d": np.array([5.0]), "e": np.array([float("inf"), 1, -float("inf"), 2.5])}
    rows = pd.DataFrame({"g": np.repeat(np.array(list(groups), dtype=object), [len(v) for v in groups.values()]), "v": np.concatenate(list(groups.values()))}).sample(frac=1, random_state=1)
    wide = spark.createDataFrame(rows, "g string, v double").repartition(7).unionByName(spark.createDataFrame([("a", None), ("f", None)], "g string, v double"))
    got = {r["g"]: r for r in stats.numeric_stats(wide, "v", ("g",), 4).collect()}
    for g, v in groups.items():
        s = np.sort(v)
        for n, q in stats.QUANTILES.items():
            k = q * (len(s) - 1)
            lo, hi = s[int(np.floor(k))], s[int(np.ceil(k))]
            assert got[g][n] == pytest.approx(lo if lo == hi else lo * (1 - (k - np.floor(k))) + hi * (k - np.floor(k)), rel=1e-12), (g, n)
        assert got[g]["count"] == len(v) and got[g]["num_over_max_length"] == (v > 4).sum()
    assert got["f"]["count"] == 0 and got["f"]["median"] is None and got["f"]["ratio_over_max_length"] == 0
    split = stats.train_val_split(spark.range(50), "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"val": 10, "train": 40}


RECORD = {"sample_type": "si_simple_data", "sample_id": "a", "assets": [{"type": "image", "uri": "a.jpg", "size": [16, 16], "annotations": [
    {"instance_id": "i", "label_id": 1, "label_name": "rotor", "bbox": {"tl": {"x": 1, "y": 1}, "br": {"x": 3, "y": 3}, "format": "xyxy"}}]}]}
HEADER = {"record_type": "dataset_info", "schema_version": "v", "info": {"dataset_id": "d", "label_info": {"rotor": {"label_id": 1, "label_name": "rotor", "description": " x "}}}}


def test_manifest_modes(spark, tmp_path):
    def write(*lines):
        p = tmp_path / f"m{len(list(tmp_path.iterdir()))}.jsonl"
        p.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
        return str(p)

    sample = {"record_type": "sample", "sample": RECORD}
    good = write("﻿" + json.dumps(HEADER), "", sample)
    rows = manifest.read_samples(spark, good).collect()
    assert [(r["sample_id"], r["line_no"], r["idx"]) for r in rows] == [("a", 3, 0)]
    assert manifest.read_header(spark, good).first()["dataset_id"] == "d"
    labels = manifest.label_table(manifest.read_header(spark, good))
    assert manifest.label_mismatches(manifest.annotations(manifest.read_samples(spark, good)), labels).count() == 0
    with pytest.raises(ManifestError, match="line 1"):
        manifest.read_samples(spark, write(sample, HEADER)).count()
    with pytest.raises(ManifestError, match="line 2"):
        manifest.read_samples(spark, write(HEADER, "{broken")).count()
    with pytest.raises(ManifestError, match="line 2"):
        manifest.read_samples(spark, write(HEADER, HEADER)).count()
    assert manifest.read_samples(spark, write(sample, HEADER, sample), "eval").count() == 1
    assert manifest.read_samples(spark, write(HEADER, "[1]", sample), "lenient").count() == 1
    bad = json.loads(json.dumps(sample))
    bad["sample"]["assets"][0]["size"] = [0, 10]
    with pytest.raises(ManifestError, match="size"):
        manifest.read_samples(spark, write(HEADER, bad)).count()
    out = str(tmp_path / "out")
    sinks.write_manifest(manifest.read_header(spark, good), manifest.read_samples(spark, good), out)
    lines = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert [x["record_type"] for x in lines] == ["dataset_info", "sample"] and lines[0]["schema_version"] == "v" and "schema_version" not in lines[0]["info"]
    assert lines[0]["info"]["label_info"]["rotor"]["label_id"] == 1 and lines[1]["sample"]["assets"][0]["annotations"][0]["bbox"]["br"]["x"] == 3
    again = str(tmp_path / "again")
    sinks.write_manifest(manifest.read_header(spark, out), manifest.read_samples(spark, out), again)
    assert [json.loads(r.value) for r in spark.read.text(again).collect()] == lines


def test_line_numbers_over_splits(spark, tmp_path):
    p = tmp_path / "long.jsonl"
    p.write_text("".join(f'{{"k": {k}, "pad": "{"x" * (k % 50)}"}}\n' + ("\n" if k % 9 == 0 else "") for k in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        rows = manifest.read_jsonl(spark, str(p)).select("line_no", F.variant_get("record", "$.k", "int").alias("k")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want, line = {}, 0
    for k in range(3000):
        line += 1
        want[k] = line
        line += k % 9 == 0
    assert {r["k"]: r["line_no"] for r in rows} == want


def test_lenient_readers(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text("\ufeff" + json.dumps({"record_type": "sample", "x": 1}) + "\n{oops\n" + json.dumps(HEADER) + "\n")
    rows, name = manifest.read_lenient_samples(spark, str(p))
    assert rows.count() == 1 and name == "d" and manifest.read_jsonl(spark, str(p), "skip").count() == 2
    with pytest.raises(Exception, match="line 2"):
        manifest.read_jsonl(spark, str(p)).collect()
    with pytest.warns(UserWarning, match="line 2 of .* is not JSON"):
        assert manifest.read_jsonl(spark, str(p), "warn").count() == 2
    with pytest.warns(UserWarning):
        rows, name = manifest.read_lenient_samples(spark, str(tmp_path / "none.jsonl"))
    assert rows.isEmpty() and name == "unknown"
    assert manifest.first_header(spark, str(p))[1][0]["label_name"] == "rotor"
    (tmp_path / "b.jsonl").write_text(json.dumps({"record_type": "dataset_info", "info": {"dataset_id": "e"}}))
    with pytest.raises(ManifestError, match="label_info"):
        manifest.first_header(spark, str(tmp_path / "b.jsonl"))
    samples = spark.range(3).withColumnRenamed("id", "idx")
    assert manifest.get_record(samples, 2).count() == 1
    with pytest.raises(IndexError):
        manifest.get_record(samples, 3)


def test_label_ids_first_name_counts(spark):
    labels = spark.createDataFrame([(0, 1, "a"), (1, 1, "b")], "position int, label_id long, label_name string")
    annots = spark.createDataFrame([("s", 1, "a"), ("s", 1, "b"), ("s", 2, "c")], "sample_id string, label_id long, label_name string")
    assert sorted(r["label_name"] for r in manifest.label_mismatches(annots, labels).collect()) == ["b", "c"]


def test_numbered(spark):
    df = spark.range(0, 400_000, 3, 7).withColumn("g", F.col("id") % 2)
    got = stats.numbered(df, "id", "n", start=1, group=("g",)).collect()
    rank = {g: {v: k for k, v in enumerate(sorted(r["id"] for r in got if r["g"] == g), 1)} for g in (0, 1)}
    assert len(got) == df.count() and all(rank[r["g"]][r["id"]] == r["n"] for r in got)


def test_conversion_end_to_end(spark, tmp_path):
    doc = {"categories": [{"id": 4, "name": "PET bottle"}, {"id": 9, "name": "can"}], "images": [{"id": 1, "width": 200, "height": 100, "file_name": "a/x.jpg"}, {"id": 2, "width": 9, "height": 9, "file_name": "b.jpg"}, {"id": 3, "width": 50, "height": 50, "file_name": "c.jpg"}],
           "annotations": [{"id": 7, "image_id": 1, "category_id": 4, "bbox": [10.2, 20.7, 30.1, 5.1]}, {"id": 8, "image_id": 1, "category_id": 4, "bbox": [300, 0, 5, 5]}, {"id": 9, "image_id": 3, "category_id": 9, "bbox": [0, 0, 9, 9]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    images = detection.read_coco(spark, str(tmp_path / "c.json"))
    made = {r["line_no"]: r.asDict(recursive=True) for r in records.coco_records(images, [(4, "PET_bottle"), (9, "can")], split="train", source_file="c.json", id_strategy="sequential", id_prefix="p-", drop_empty=True).collect()}
    assert {k: v["sample_id"] for k, v in made.items()} == {0: "p-000001", 2: "p-000002"} and made[0]["invalid"] == 1
    one = made[0]["assets"][0]["annotations"][0]
    assert (one["instance_id"], one["label_id"], one["label_name"], one["bbox"]["tl"]["x"], one["bbox"]["br"]["y"], one["points"][0]["x"]) == ("obj_7", 4, "PET_bottle", 10, 26, 26)
    assert records.coco_records(images, [(4, "PET_bottle")], id_strategy="file_stem").orderBy("line_no").first()["sample_id"] == "x"
    with pytest.raises(Exception, match="invalid box"):
        records.coco_records(images, [(4, "x")], skip_invalid=False).collect()
    with pytest.raises(DatasetBuildError):
        records.coco_records(images, [], id_strategy="uuid")

    samples = images.withColumnRenamed("pos", "idx")
    labels = [{"label_id": 1, "label_name": "PET_bottle", "description": ["a", " bottle "]}, {"label_id": 2, "label_name": "can", "description": None}]
    ids = [(x["label_name"], x["label_id"]) for x in labels]
    entry = {"entry_id": "cfg_k", "config_dir": "/d", "dataset": "CocoWasteDataset"}
    rows = records.entry_records(samples, entry, ids)
    header = records.dataset_header("all", labels, {"split": "train"}, now="2020-01-01T00:00:00")
    part = records.dataset_header("cfg_k", labels, only={"can"}, now="2020-01-01T00:00:00")
    assert list(part["info"]["label_info"]) == ["can"] and part["info"]["label_info"]["can"]["label_id"] == 2
    sinks.write_conversion({"cfg_k": part}, header, {"cfg_k": rows}, str(tmp_path / "out"))
    back = manifest.read_samples(spark, str(tmp_path / "out" / "merged.canonical.jsonl")).collect()
    assert [r["sample_id"] for r in back] == ["cfg_k_000001", "cfg_k_000002", "cfg_k_000003"] and [len(r["assets"][0]["annotations"]) for r in back] == [1, 0, 1]
    got = manifest.read_header(spark, str(tmp_path / "out" / "merged.canonical.jsonl")).first()
    assert got["dataset_id"] == "all" and got["label_info"]["PET_bottle"]["description"] == "a bottle" and got["schema_version"] == records.SCHEMA_VERSION
    with pytest.raises(DatasetBuildError, match="can"):
        records.dataset_header("x", labels, require_descriptions=True)
    with pytest.raises(Exception, match="not in the table"):
        records.entry_records(samples, entry, ids[:1]).collect()
    train = messages.manifest_rows(spark, str(tmp_path / "out" / "merged.canonical.jsonl")).collect()
    assert [m["messages"][1]["content"][0]["text"] for m in train][1] == "<none>" and "PET_bottle: a bottle" in train[0]["messages"][0]["content"][1]["text"]


def test_run_of_a_conversion(spark, tmp_path):
    """A YAML run over a COCO and a YOLO configuration, to manifests and a summary, as a user starts it."""
    doc = {"categories": [{"id": 4, "name": "PET bottle"}, {"id": 9, "name": "can"}], "images": [{"id": k, "width": 200, "height": 100, "file_name": f"{k}.jpg"} for k in (1, 2, 3)],
           "annotations": [{"id": 7, "image_id": 1, "category_id": 9, "bbox": [10.2, 20.7, 30.1, 5.1]}, {"id": 8, "image_id": 3, "category_id": 4, "bbox": [300, 0, 5, 5]}, {"id": 9, "image_id": 3, "category_id": 4, "bbox": [0, 0, 9, 9]}]}
    (tmp_path / "cfg").mkdir()
    (tmp_path / "cfg" / "c.json").write_text(json.dumps(doc))
    (tmp_path / "cfg" / "w.yaml").write_text("dataset: CocoWasteDataset\ndata_dicts:\n  one: {labels: c.json, folder_path: im}\nCLASSES:\n  PET bottle: [a, b]\n  unused: []\n")
    (tmp_path / "cfg" / "y.yaml").write_text("dataset: WarpDataset\nGLOBAL_ROOT: root\ndata_dict:\n  two: {path: lab, folder: pics}\nCLASSES: [fan]\n")
    (tmp_path / "cfg" / "root" / "pics").mkdir(parents=True)
    (tmp_path / "cfg" / "lab").mkdir()
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (40).to_bytes(4, "big") + (20).to_bytes(4, "big") + b"\x08"
    for n in "ab":
        (tmp_path / "cfg" / "root" / "pics" / f"{n}.png").write_bytes(png)
    (tmp_path / "cfg" / "lab" / "b.txt").write_text("0 .5 .5 .5 .5\n")
    (tmp_path / "run.yaml").write_text("configs: [cfg/w.yaml, cfg/y.yaml]\nout_dir: out\nuri_mode: absolute\noptions: {dataset_id: all, drop_empty: true, uri_mode: relative}\n")
    from boxloom.sources import conversion

    said = conversion.convert_run(spark, str(tmp_path / "run.yaml"))
    out = str(tmp_path / "out")
    assert said == {
        "output_dir": out, "merged_output": f"{out}/merged.canonical.jsonl", "per_entry_outputs": [f"{out}/w_one.canonical.jsonl", f"{out}/y_two.canonical.jsonl"], "num_entries": 2, "num_samples_written": 3,
        "num_invalid_annotations_skipped": 1, "num_labels": 4, "labels": {"PET_bottle": 1, "unused": 2, "fan": 3, "can": 4}}
    rows = manifest.read_samples(spark, said["merged_output"]).orderBy("line_no").collect()
    assert [(r["sample_id"], r["assets"][0]["uri"]) for r in rows] == [("w_one_000001", "im/1.jpg"), ("w_one_000003", "im/3.jpg"), ("y_two_000002", "pics/b.png")]
    assert rows[2]["assets"][0]["annotations"][0]["label_id"] == 3 and rows[2]["assets"][0]["annotations"][0]["bbox"]["br"]["x"] == 30
    head = manifest.read_header(spark, said["per_entry_outputs"][1]).first()
    assert head["dataset_id"] == "all_y_two" and list(head["label_info"]) == ["fan"] and head["label_info"]["fan"]["label_id"] == 3
    first = json.loads(spark.read.text(said["per_entry_outputs"][0]).first()["value"])["info"]
    assert list(first["label_info"]) == ["PET_bottle", "unused", "can"] and first["label_info"]["PET_bottle"]["description"] == "a b" and first["metadata"]["entries"][0]["folder_path"] == "im"
    for wrong in ({"odd": 1}, {"uri_mode": "x"}, {"normalization_factor": 0}):
        with pytest.raises(DatasetBuildError):
            conversion.run_options(wrong)
    with pytest.raises(DatasetBuildError, match="no dataset entries"):
        conversion.convert_entries(spark, [], out)


def test_predictions(spark):
    asset = [{"type": "image", "uri": "a.jpg", "caption": None, "annotations": [], "metadata": "{}", "size": [200, 100], "camera_id": None}]
    schema = "line_no long, sample_type string, sample_id string, assets array<struct<type:string,uri:string,caption:string,annotations:array<string>,metadata:string,size:array<int>,camera_id:string>>"
    samples = spark.createDataFrame([(k, "si_simple_data", f"s{k}", asset) for k in range(3)], schema)
    answers = spark.createDataFrame([("s0", "<rotor,100,200,500,800>"), ("s1", "dunno")], "sample_id string, generated_text string").withColumns({"width": F.lit(200), "height": F.lit(100)})
    parsed = parsing.parse_answers(answers, "generated_text", "tag_bbox_list", ids=F.create_map(F.lit("rotor"), F.lit(3).cast("bigint")))
    good, bad = records.prediction_records(samples, parsed)
    g = good.collect()
    assert [r["sample_id"] for r in g] == ["s0"] and g[0]["assets"][0]["annotations"][0]["label_id"] == 3
    said = g[0]["assets"][0]["metadata"]["prediction"]
    assert said["source"] == "model_inference" and said["num_predicted_instances"] == 1 and said["generated_text"].startswith("<rotor")
    assert [r["sample_id"] for r in bad.collect()] == ["s1"]
    info = records.prediction_header(records.dataset_header("d", []), "m", "ck")["info"]
    assert info["metadata"]["prediction_run"] == {"source_dataset_id": "d", "model_name": "m", "checkpoint_path": "ck"} and info["annotation_info"]["source_type"] == "ai"


def test_sinks(spark, tmp_path):
    errors = spark.createDataFrame([("a", "e", "t"), ("b", None, "u")], "sample_id string, error string, generated_text string")
    assert sinks.write_errors(errors, str(tmp_path / "e")) and not sinks.write_errors(errors.limit(0), str(tmp_path / "f"))
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "e")).collect())
    assert sorted(json.loads(text), key=lambda x: x["sample_id"]) == [{"sample_id": "a", "error": "e", "generated_text": "t"}, {"sample_id": "b", "error": None, "generated_text": "u"}]
    box = lambda *v: dict(zip(("x1", "y1", "x2", "y2"), v))
    samples = spark.createDataFrame(
        [(1, "a.jpg", 9, 8, [(4, box(1, 2, 4, 6), None), (4, None, None)]), (2, None, 1, 1, []), (5, "b.jpg", 9, 8, [(4, box(0, 0, 1, 1), 7)])],
        "line_no long, uri string, width int, height int, annotations array<struct<label_id:long,box:struct<x1:long,y1:long,x2:long,y2:long>,area:long>>")
    labels = spark.createDataFrame([(4, "x"), (2, "y")], "label_id long, label_name string")
    sinks.write_coco(*sync.coco_tables(samples, labels), str(tmp_path / "coco"))
    doc = json.loads("".join(r.value for r in spark.read.text(str(tmp_path / "coco")).collect()))
    assert [(i["id"], i["file_name"], i["license"]) for i in doc["images"]] == [(1, "a.jpg", 0), (2, "b.jpg", 0)] and [c["id"] for c in doc["categories"]] == [2, 4]
    assert [(a["id"], a["image_id"], a["bbox"], a["area"]) for a in doc["annotations"]] == [(1, 1, [1.0, 2.0, 3.0, 4.0], 12), (2, 2, [0.0, 0.0, 1.0, 1.0], 7)]


def test_paths(spark, tmp_path):
    uri = lambda p, *a, **k: one(spark, paths.image_uri(F.lit(p), *a, **k))
    assert uri("s3://b/x", "absolute", "/c") == "s3://b/x" and uri("/x/y.jpg", "absolute", "/c") == "/x/y.jpg"
    assert uri("p/../y.jpg", "absolute", "/c") == "/c/y.jpg" and uri("y.jpg", "absolute", "/c", "/g/r") == "/g/r/y.jpg"
    assert uri("./a//b.jpg", "relative", "/c") == "a/b.jpg" and uri("a.jpg", "relative", "/c/d", None, "/c") == "d/a.jpg" and uri("a.jpg", "relative", "/c/d", None, "/c/e/f") == "../../d/a.jpg"
    with pytest.raises(DatasetBuildError):
        uri("a", "odd", "/c")
    assert paths.config_path("x", "/base") == "/base/x" and paths.config_path(None) is None and paths.config_path("gs://x", "/b") == "gs://x"
    assert paths.data_path("no/such", "rel") == "rel/no/such"
    files = spark.createDataFrame([("/im/a.jpg",), ("/im/sub/b.jpg",), ("/im/z/b.jpg",), ("/abs/c.jpg",)], "path string")
    rows = spark.createDataFrame([("a.jpg",), ("x/a.jpg",), ("q/b.jpg",), ("/abs/c.jpg",), ("none.jpg",)], "uri string")
    assert {r["uri"]: r["found"] for r in paths.find_images(rows, files, "/im").collect()} == {"a.jpg": "/im/a.jpg", "x/a.jpg": "/im/a.jpg", "q/b.jpg": "/im/sub/b.jpg", "/abs/c.jpg": "/abs/c.jpg", "none.jpg": None}


def test_pseudo_labels_pass_through(spark):
    import pandas as pd

    schema = ("line_no long, found string, width int, height int, annotations array<struct<instance_id:string,bbox:struct<x1:double,y1:double,x2:double,y2:double>,mask:struct<counts:string,size:array<int>>,source:string>>")
    box = (1.0, 1.0, 3.0, 3.0)
    rows = [(1, "a", 5, 4, [("i", box, None, None), ("j", None, None, None), ("k", box, ("x", [4, 5]), "human")]), (2, None, 5, 4, [("i", box, None, None)]), (3, "c", 5, 4, []), (4, "bad", 5, 4, [("i", box, None, "s")])]

    def predictor(batches):
        for b in batches:
            yield pd.DataFrame({"line_no": b["line_no"], "pos": b["pos"], "height": [4 if f != "bad" else 9 for f in b["found"]], "width": b["width"], "runs": [[5, 2, 13]] * len(b)})

    got = {r["line_no"]: r for r in sync.pseudo_label(spark.createDataFrame(rows, schema), predictor).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1]["mask_source"] and not any(got[k]["mask_source"] for k in (2, 3, 4))
    a = got[1]["annotations"]
    assert masks.unpack_runs(a[0]["mask"]["counts"]) == [5, 2, 13] and a[0]["mask_format"] == "coco_rle" and a[1]["mask"] is None and a[2]["mask"]["counts"] == "x" and a[2]["source"] == "human"


def test_row_layouts(spark):
    df = spark.createDataFrame([("p", "c", None, "t"), (None, None, "do", "t"), (None, None, None, "t"), ("p", None, None, None)], "prompt string, completion string, instruction string, text string")
    assert [r[0] for r in df.select(messages.text_of(df)).collect()] == ["p\nc", "do", "t", ""]
    kind = "messages array<struct<role:string,content:array<struct<type:string,path:string,image_id:string,text:string>>>>, image_registry map<string,string>, image string"
    df = spark.createDataFrame([([("user", [("image", None, "k", None), ("image", None, "unknown", None), ("image", "b.jpg", None, None), ("text", None, None, "x")])], {"k": "a.jpg"}, "b.jpg")], kind)
    assert df.select(messages.image_paths(df)).first()[0] == ["b.jpg", "a.jpg"]
    rows = stats.plot_series(spark.createDataFrame([("b", "0.5", "1"), ("a", "x", "1"), ("a", "0.1", "nan"), ("a", "0.2", "0.3")], "model string, threshold string, f1 string"), "f1").collect()
    assert [(r["model"], r["threshold"]) for r in rows] == [("a", 0.2), ("b", 0.5)]
    kept, missing = stats.by_requested_ids(spark.createDataFrame([("a",), ("b",)], "id string"), "id", ["b", "z"], 5)
    assert [r["id"] for r in kept.collect()] == ["b"] and missing == ["z"]


def test_brush_literals_and_golden_runs():
    """Literal blocks, whose words are read at computed places, and run texts worked out by hand from the packing."""
    pixels = [0, 0, 0, 255, 1, 2, 3, 0, 9, 9, 9, 7, 0, 0, 0, 0]
    bits = f"{16:032b}{7:05b}" + "".join(f"{s - 1:04b}" for s in (3, 4, 8, 16)) + "0" + "01" + f"{11:04b}" + "".join(f"{v:08b}" for v in pixels[:12]) + "1" + "00" + f"{3:03b}" + f"{0:08b}"
    bits += "0" * (-len(bits) % 8)
    data = [int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)]
    assert masks.mask_of(masks.brush_runs(data, 2, 2), 2, 2).tolist() == [[True, False], [True, False]]
    assert masks.brush_runs([b - 256 if b > 127 else b for b in data], 2, 2) == masks.brush_runs(data, 2, 2) == [0, 2, 2]
    # a mask of one column, its lower pixel set, worked out bit by bit: 8 values, words of 8 bits, lengths of 3, 4, 8 or 16 bits
    golden = "".join(["0" * 28 + "1000", "00111", "0010", "0011", "0111", "1111", "1" + "00" + "011" + "0" * 8, "1" + "00" + "011" + "1" * 8]) + "0" * 7
    assert masks.brush_of([1, 1], 1, 2) == [int(golden[i : i + 8], 2) for i in range(0, len(golden), 8)]
    # 15 -> one character 48 + 15; 16 needs a sign: 16 & 31 | 32, then 0; -1 is 48 + 31
    assert masks.pack_runs([15, 16, 14, 15, 13]) == "?" + "`0" + ">" + "O" + "O" and masks.unpack_runs("?`0>OO") == [15, 16, 14, 15, 13]


def test_coco_and_yolo(spark, tmp_path):
    doc = {"categories": [{"id": 1, "name": "PET"}], "images": [{"id": 1, "width": 200, "height": 100, "file_name": "a.jpg"}, {"id": 2, "width": 9, "height": 9, "filename": "b.jpg"}],
           "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [1, 2, 3, 4]}, {"id": 2, "image_id": 1, "category_id": 9, "bbox": [1, 2, 3, 4]}, {"id": 3, "image_id": 7, "category_id": 1, "bbox": [0, 0, 1, 1]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    rows = {r["image"]: [a["class"] for a in r["annotations"]] for r in detection.read_coco(spark, str(tmp_path / "c.json"), "root").collect()}
    assert rows == {"root/a.jpg": ["PET", None], "root/b.jpg": []}
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "a.txt").write_text("0 .5 .5 .5 .5\nx 1 2 3 4\n1 2\n7 .5 .5 .2 .2\n")
    images = spark.createDataFrame([("p/a.JPG", 200, 100), ("p/b.png", 10, 10), ("p/c.txt", 1, 1)], "image string, width int, height int")
    got = {r["image"]: [(a["class"], a["bbox"]) for a in r["annotations"]] for r in detection.read_yolo(spark, images, str(tmp_path / "y"), ["PET"]).collect()}
    assert set(got) == {"p/a.JPG", "p/b.png"} and got["p/b.png"] == [] and [c for c, _ in got["p/a.JPG"]] == ["PET", "7"] and got["p/a.JPG"][0][1] == [50, 25, 100, 50]


COCO = (
    "categories array<struct<id:bigint,name:string>>, images array<struct<id:string,width:int,height:int,file_name:string,filename:string>>, "
    "annotations array<struct<id:string,image_id:string,category_id:bigint,bbox:array<double>>>"
)


def read_whole(spark, path):
    """The whole document in one row, as Spark reads it."""
    doc = spark.read.schema(COCO).json(path, multiLine=True)
    names = {r["id"]: r["name"] for r in reversed(doc.select(F.explode("categories").alias("c")).select("c.*").collect())}
    found = {}
    for r in doc.select(F.posexplode("annotations").alias("at", "a")).select("a.*").collect():
        found.setdefault(r["image_id"], []).append((names.get(r["category_id"]), r["category_id"], r["bbox"], r["id"]))
    images = doc.select(F.posexplode("images").alias("pos", "i")).select("pos", "i.*").collect()
    return sorted((r["pos"], r["id"], r["file_name"] or r["filename"], r["width"], r["height"], found.get(r["id"], []) if r["id"] else []) for r in images)


@pytest.mark.parametrize("split,indent", [("128m", None), ("700", None), ("2k", 1), ("64", None)])
def test_split_coco_documents(spark, tmp_path, split, indent):
    """Ranges that begin in strings with brackets and quotes, in nested objects, between arrays and within the keys of arrays."""
    rng = np.random.default_rng(3)
    odd = ['}"annotations":[{', '\\"}', "}{][", "é}\\", "\u2028}", ""]
    images = [{"id": k, "width": 10 + k, "height": 9, "file_name": f"a{odd[k % 6]}{k}.jpg"} if k % 7 else {"id": k, "width": 1, "height": 1, "filename": "b}"} for k in range(60)]
    annots = [{"id": k, "image_id": int(rng.integers(0, 70)), "category_id": int(rng.integers(0, 4)), "bbox": [1, 2.5, k, 3], "attributes": {"t": {"annotations": [{"id": 5}], "n": odd[k % 6]}},
               "segmentation": [[1, 2], []] if k % 2 else {"counts": "x}y{", "size": [1, 2]}} for k in range(300)]
    categories = [{"id": 1, "name": "a}"}, {"id": 2, "name": 'b"{'}, {"id": 2, "name": "again"}, {"id": 3, "name": "c"}]
    doc = {"info": {"x": {"y": [{"images": [{"id": 9}]}]}}, "licenses": [{"id": 1}], "categories": categories, "images": images, "annotations": annots, "more": [{"id": 1}, 3]}
    if split == "2k":
        doc = dict(reversed(doc.items()))
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=split == "700"), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = detection.read_coco(spark, str(tmp_path / "c.json"))
        assert split == "128m" or got.sparkSession.read.text(str(tmp_path / "c.json"), lineSep="}").rdd.getNumPartitions() > 3
        got = sorted((r["pos"], r["image_id"], r["image"], r["width"], r["height"], [(a["class"], a["category_id"], a["bbox"], a["annotation_id"]) for a in r["annotations"]]) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == read_whole(spark, str(tmp_path / "c.json")) and len(got) == 60


def test_configs(tmp_path):
    assert [e["source"] for e in detection.data_entries({"data_dicts": {"a": {"labels": "x", "folder": "f"}, "b": "y"}})] == ["x", "y"]
    assert detection.merge_options({"a": 1, "options": {"a": 2}}, {"b": 3, "a": None}) == {"a": 2, "b": 3}
    with pytest.raises(DatasetBuildError):
        detection.check_options({"z": 1}, {"a"})
    assert detection.prediction_files(["/x/a.jsonl", {"name": "n", "path": "/x/a.jsonl"}, {"path": "/x/b.jsonl"}]) == [("n", "/x/a.jsonl"), ("b", "/x/b.jsonl")]
    keys = lambda cfg: [e["key"] for e in detection.data_entries(cfg)]
    assert keys({"data_dict": "x/y.json"}) == ["dataset"] and keys({"data_dicts": ["p/q.json", {"m": "z", "n": {"p": "w"}}]}) == ["q", "m", "n"] and keys({}) == []
    for bad in ({"data_dicts": {"a": {"folder": "f"}}}, {"data_dicts": [3]}, {"data_dicts": 5}, {"data_dicts": {"a": 3}}):
        with pytest.raises(DatasetBuildError):
            detection.data_entries(bad)
    with pytest.raises(DatasetBuildError):
        detection.source_of("Nothing")
    assert detection.source_of("WarpDataset") is detection.read_yolo
    with pytest.warns(UserWarning):
        assert detection.entry_specs({"c": {"data_dicts": {"a": "x"}}, "d": {}})[0]["entry_id"] == "c_a"
    for name in ("u.jsonl", "v.json"):
        (tmp_path / name).write_text("")
    assert [n for n, _ in detection.prediction_files(folders=[str(tmp_path)], patterns=["*.json", "*.jsonl"])] == ["v", "u"]
    assert X.description_of([" a ", "", "b"]) == "a b" and X.category_ids("1, 2") == [1, 2] and X.classes_of(["a"]) == {"a": None}


def test_messages(spark):
    df = spark.createDataFrame([("a", "a.jpg", 16, 16, [("rotor", (1., 1., 3., 3.)), ("x", None)]), ("b", "s3://b", 16, 16, [])],
                               "sample_id string, uri string, width int, height int, annotations array<struct<label_name:string,bbox:struct<x1:double,y1:double,x2:double,y2:double>>>")
    rows = {r["sample_id"]: r for r in messages.training_rows(df, [("rotor", " d ")], root="/r").collect()}
    assert rows["a"]["messages"][1]["content"][0]["text"] == "<rotor,62,62,188,188>" and rows["a"]["images"] == ["/r/a.jpg"]
    assert rows["b"]["messages"][1]["content"][0]["text"] == "<none>" and rows["b"]["images"] == ["s3://b"]
    assert messages.training_rows(df, [], schema="prompt_completion", include_target=False).first()["completion"] == []


@given(st.lists(st.lists(st.booleans(), min_size=5, max_size=5), min_size=1, max_size=7))
def test_mask_codecs(rows):
    mask = np.array(rows)
    runs, (h, w) = masks.runs_of(mask), mask.shape
    assert (masks.mask_of(runs, *mask.shape) == mask).all() and masks.unpack_runs(masks.pack_runs(runs)) == runs
    assert masks.runs_of_spans(*masks.spans_of(runs), mask.size) == runs
    assert masks.runs_of_spans(*masks.turned(*masks.spans_of(runs), w, h), mask.size) == masks.runs_of(mask.T)
    assert masks.brush_runs(masks.brush_of(runs, w, h), w, h) == runs


def test_mask_geometry(spark):
    df = spark.createDataFrame([([4, 1, 4],), ([9],), ([0, 9],), (None,)], "runs array<long>").withColumn("h", F.lit(3)).select(masks.mask_geometry("runs", "h").alias("g"), masks.run_area(F.col("runs")).alias("a"))
    got = [(tuple(r["g"])[:4], r["g"]["cx"], r["a"]) for r in df.collect()]
    assert got == [((1, 1, 2, 2), 1.0, 1), ((None,) * 4, None, 0), ((0, 0, 3, 3), 1.0, 9), ((None,) * 4, None, None)]


def test_mask_geometry_equals_pixels(spark):
    rng = np.random.default_rng(1)
    shapes = [(1, 1), (1, 9), (9, 1), (7, 5), (40, 33)] * 12
    drawn = [(rng.random(shape) < p) if k % 3 else np.repeat(rng.random((shape[0], 1)) < p, shape[1], 1) for k, (shape, p) in enumerate((s, q) for s in shapes for q in (0.05, 0.5))]
    big = np.zeros((2160, 3840), dtype=bool)
    big[100:2000, 300:3500] = big[5, 7] = True
    rows = [(k, m.shape[0], masks.runs_of(m)) for k, m in enumerate([*drawn, big])]
    df = spark.createDataFrame(rows, "k int, h int, runs array<long>").select("k", masks.mask_geometry("runs", "h").alias("g"))
    for r in df.collect():
        ys, xs = np.where([*drawn, big][r["k"]])
        want = (xs.min(), ys.min(), xs.max() + 1, ys.max() + 1, xs.mean(), ys.mean(), len(xs)) if len(xs) else (None,) * 6 + (0,)
        assert tuple(r["g"]) == pytest.approx(want) if len(xs) else tuple(r["g"]) == want


#: Percent corners, width, height and the picture, worked out by hand line by line.
POLYGONS = [
    ([(0, 0), (80, 0), (0, 80)], 5, 5, ["#####", "####.", "###..", "##...", "#...."]),  # a right triangle and its edges
    ([(0, 0), (80, 0), (80, 80), (0, 80)], 5, 5, ["#####"] * 5),
    ([(20, 20), (60, 20), (60, 60), (20, 60)], 5, 5, [".....", ".###.", ".###.", ".###.", "....."]),  # both far edges count
    ([(40, 0), (80, 40), (40, 80), (0, 40)], 5, 5, ["..#..", ".###.", "#####", ".###.", "..#.."]),
    ([(0, 0), (80, 80), (80, 0), (0, 80)], 5, 5, ["#...#", "##.##", "#####", "##.##", "#...#"]),  # crosses itself in the middle
    ([(0, 0), (80, 0), (40, 0)], 5, 2, ["#####", "....."]),  # flat: only its level edges
    ([(0, 0), (0, 80), (0, 40)], 2, 5, ["#."] * 5),  # upright and flat
    ([(-100, -100), (200, -100), (200, 200), (-100, 200)], 3, 3, ["###"] * 3),  # beyond the image
    ([(0, 0), (80, 0), (80, 80), (40, 40), (0, 80)], 5, 5, ["#####", "#####", "#####", "##.##", "#...#"]),  # a notch from below
    ([(0, 80), (40, 0), (80, 80)], 5, 5, ["..#..", "..#..", ".###.", ".###.", "#####"]),  # x is 2 - y / 2 and 2 + y / 2: halves go up on the left side, down on the right
    ([(0, 0), (80, 0), (80, 20), (20, 20), (20, 80), (0, 80)], 5, 5, ["#####", "#####", "##...", "##...", "##..."]),  # an L
    ([(30, 30), (50, 30), (50, 50)], 10, 10, [".........." if y not in (3, 4, 5) else "." * y + "#" * (6 - y) + "." * 4 for y in range(10)]),
    ([(0, 0), (100, 100)], 4, 4, ["...."] * 4),
]


@pytest.mark.parametrize("points,width,height,want", POLYGONS)
def test_polygons(points, width, height, want):
    mask = masks.mask_of(masks.polygon_runs(points, width, height), height, width)
    assert ["".join(".#"[int(v)] for v in row) for row in mask] == want


@given(st.lists(st.tuples(st.integers(-20, 120), st.integers(-20, 120)), min_size=3, max_size=9))
def test_polygons_equal_lines_drawn_pixel_by_pixel(points):
    w, h = 23, 17
    px = [(int(x / 100 * w), int(y / 100 * h)) for x, y in points]
    want, bottom = np.zeros((h, w), dtype=bool), max(y for _, y in px)
    for y in range(h):
        cross = []
        for (xa, ya), (xb, yb) in zip(px, px[1:] + px[:1]):
            if ya == yb == y:
                want[y, max(0, min(xa, xb)) : max(0, max(xa, xb) + 1)] = True
            elif ya != yb and min(ya, yb) <= y <= max(ya, yb):
                cross += [xa + (y - ya) * ((xb - xa) / (yb - ya))] * (2 if y == max(ya, yb) and y < bottom else 1)
        cross.sort()
        for a, b in zip(cross[::2], cross[1::2]):
            for x in range(max(0, int(np.floor(a + 0.5))), min(w - 1, int(np.ceil(b - 0.5))) + 1):
                want[y, x] = True
    assert (masks.mask_of(masks.polygon_runs(points, w, h), h, w) == want).all()


def test_sync(spark):
    samples = spark.createDataFrame([(2, "a", "x/a.jpg", 1), (3, "b", "x/b.jpg", 1), (4, "c", "x/c.jpg", 1)], "line_no long, sample_id string, uri string, annotations int")
    region = lambda i, label, **v: {"id": i, "original_width": 200, "original_height": 100, "value": {**v, "rectanglelabels": [label] if label else None}}
    rows = [(0, {"id": 1, "data": {"image": "q/zz.jpg", "sample_id": "a"}, "annotations": [{"result": [region("r", "rotor", x=10., y=10., width=20., height=20.), region("q", None, x=1., y=1., width=1., height=1.), region("n", "new", x=0., y=0., width=50., height=50.)]}]}),
            (1, {"id": 2, "data": {"image": "q/b.jpg"}, "annotations": []}), (2, {"id": 3, "data": {"sample_id": "c"}, "annotations": []})]
    tasks = spark.createDataFrame(rows, f"task_no long, task {sync.TASK}")
    labels = spark.createDataFrame([(4, "rotor", "d")], "label_id long, label_name string, description string")
    done, table = sync.sync(samples, tasks, labels)
    got = {r["sample_id"]: r["reviewed"] for r in done.collect()}
    assert [(a["instance_id"], a["label_id"], tuple(a["box"])) for a in got["a"]] == [("ls_r", 4, (20, 10, 60, 30)), ("ls_n", 5, (0, 0, 100, 50))]
    assert got["b"] == [] and got["c"] is None and {r["label_name"] for r in table.collect()} == {"rotor", "new"}


def test_sync_masks_to_coco(spark):
    import numpy as np

    mask = np.zeros((10, 20), dtype=bool)
    mask[2:6, 3:9] = mask[7, 4] = True
    brush = masks.brush_of(masks.runs_of(mask), 20, 10)
    region = lambda i, kind, **v: {"id": i, "original_width": 20, "original_height": 10, "value": {**v, kind: ["rotor"]}}
    square = [[10., 20.], [50., 20.], [50., 60.], [10., 60.]]
    result = [
        region("m", "brushlabels", rle=brush), region("m", "rectanglelabels", x=0., y=0., width=100., height=100.), region("p", "polygonlabels", points=square),
        region("k", "polygonlabels", points=square), region("k", "keypointlabels", x=50., y=50.), region("r", "rectanglelabels", x=0., y=0., width=50., height=50.),
        region("e", "brushlabels", rle=masks.brush_of([200], 20, 10)), region("t", "polygonlabels", points=square[:2])]
    samples = spark.createDataFrame([(1, "a", "x/a.jpg", 20, 10)], "line_no long, sample_id string, uri string, width int, height int")
    tasks = spark.createDataFrame([(0, {"data": {"sample_id": "a", "image": "a.jpg"}, "annotations": [{"result": result}]})], f"task_no long, task {sync.TASK}")
    done, table = sync.sync(samples, tasks, spark.createDataFrame([(4, "rotor", "d")], "label_id long, label_name string, description string"))
    got = {a["instance_id"][3:]: a for a in done.first()["reviewed"]}
    ys, xs = np.where(mask)
    assert tuple(got["m"]["box"]) == (3, 2, 9, 8) and got["m"]["area"] == 25 and np.allclose(tuple(got["m"]["point"]), (xs.mean(), ys.mean()))
    assert (masks.mask_of(masks.unpack_runs(got["m"]["mask"]["counts"]), *got["m"]["mask"]["size"]) == mask).all()
    assert tuple(got["p"]["box"]) == (2, 2, 11, 7) and tuple(got["p"]["point"]) == (6, 4) and tuple(got["k"]["point"]) == (10, 5)
    assert tuple(got["r"]["box"]) == (0, 0, 10, 5) and got["r"]["mask"] is None and got["r"]["area"] is None
    assert all(got[k]["box"] is None and got[k]["point"] is None and got[k]["area"] == 0 for k in "et")
    annots = sync.coco_tables(done.withColumnRenamed("reviewed", "annotations"), table)[1].orderBy("id").collect()
    assert [(a["bbox"], a["area"], a["segmentation"]) for a in annots] == [
        ([3., 2., 6., 6.], 25, got["m"]["mask"]), ([2., 2., 9., 5.], 45, got["p"]["mask"]), ([2., 2., 9., 5.], 45, got["k"]["mask"]), ([0., 0., 10., 5.], 50, None)]


def test_review_round_trip(spark, tmp_path):
    """A manifest, its masks as importable tasks, the tool's export of them, and the records that the review leaves."""
    mask = np.zeros((6, 8), dtype=bool)
    mask[1:4, 2:7] = mask[5, 0] = True
    counts = masks.pack_runs(masks.runs_of(mask))
    boxed = {"instance_id": "i", "label_id": 1, "label_name": "rotor", "bbox": {"tl": {"x": 1, "y": 1}, "br": {"x": 3, "y": 3}, "format": "xyxy"}}
    asset = lambda uri, size, annotations, **more: {"type": "image", "uri": uri, "size": size, "annotations": annotations, **more}
    samples = [
        asset("im/a.jpg", [8, 6], [boxed, {"instance_id": "j", "label_id": 1, "label_name": "rotor", "mask": {"counts": counts, "size": [6, 8]}}], metadata={"mask_source": "old", "k": [1, None]}),
        asset("im/b.jpg", [8, 6], [boxed]), asset("im/c.jpg", [8, 6], [boxed], metadata={"k": 1}), asset("im/d.jpg", [8, 6], [boxed]), asset("im/e.jpg", [0, 0], [])]
    lines = [HEADER, *[{"record_type": "sample", "sample": {"sample_type": "si_simple_data", "sample_id": f"s{k}", "assets": [a]}} for k, a in enumerate(samples)]]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = manifest.read_samples(spark, str(tmp_path / "m.jsonl"), "lenient")  # the tool's sync refuses nothing
    flat = rows.select("line_no", "sample_id", F.col("assets")[0]["uri"].alias("uri"), F.col("assets")[0]["size"][0].alias("width"), F.col("assets")[0]["size"][1].alias("height"), F.transform(
        F.col("assets")[0]["annotations"], lambda a: F.struct(a["label_name"], a["label_id"], F.struct(F.variant_get(a["mask"]["counts"], "$", "string").alias("counts"), a["mask"]["size"].alias("size")).alias("mask"))).alias("annotations"))
    made = {r["data"]["sample_id"]: r for r in sync.tasks(flat, "/root/store").collect()}
    assert made["s0"]["data"]["image"] == "/data/local-files/?d=im/a.jpg" and made["s0"]["data"]["storage_path"] == "/root/store/im/a.jpg" and made["s1"]["predictions"] is None
    result = made["s0"]["predictions"][0]["result"]
    assert [(x["id"], x["value"]["brushlabels"], x["original_width"]) for x in result] == [("mask_0", ["rotor"], 8)] and masks.brush_runs(result[0]["value"]["rle"], 8, 6) == masks.runs_of(mask)

    results = [
        {**result[0].asDict(recursive=True), "id": "m", "value": {"format": "rle", "rle": result[0]["value"]["rle"], "brushlabels": ["fan"]}},
        {"id": "r", "original_width": 99, "original_height": 99, "type": "x", "value": {"x": 25, "y": 50, "width": 25, "height": 50, "rectanglelabels": ["rotor"]}},
        {"original_width": 8, "original_height": 6, "value": {"x": 50, "y": 50, "keypointlabels": ["rotor"]}}]
    export = [
        {"id": 7, "data": {"image": "/x/1f-a.jpg"}, "annotations": [{"result": results, "extra": 1}]}, {"id": 8, "data": {"image": "q/b.jpg"}, "annotations": []},
        {"id": 9, "data": {"image": "q/c.jpg"}}, {"id": 10, "data": {"image": "q/e.jpg"}, "annotations": [{"result": [{"id": "w", "original_width": 40, "original_height": 20, "value": {"x": 0, "y": 0, "width": 50, "height": 50, "rectanglelabels": ["rotor"]}}]}]}]
    (tmp_path / "tool.json").write_text(json.dumps(export))
    labels = spark.createDataFrame([(1, "rotor", "x")], "label_id long, label_name string, description string")
    records_, table = sync.synced_records(rows, sync.task_rows(detection.read_tool_export(spark, str(tmp_path / "tool.json"))), labels)
    sinks.write_manifest(HEADER, records_, str(tmp_path / "out"), keep_nulls=False)
    got = [json.loads(r.value)["sample"]["assets"][0] for r in spark.read.text(str(tmp_path / "out")).collect()[1:]]
    assert got[0]["metadata"] == {"mask_source": "label_studio_manual", "k": [1, None]} and got[0]["size"] == [8, 6]
    assert got[0]["annotations"] == [
        {"instance_id": "ls_m", "label_id": 2, "label_name": "fan", "attributes": {}, "bbox": {"tl": {"x": 0, "y": 1}, "br": {"x": 7, "y": 6}, "format": "xyxy"}, "mask": {"counts": counts, "size": [6, 8]},
         "mask_format": "coco_rle", "source": "label_studio_manual", "center_point": {"x": pytest.approx(3.75), "y": pytest.approx(35 / 16)}},
        {"instance_id": "ls_r", "label_id": 1, "label_name": "rotor", "attributes": {}, "bbox": {"tl": {"x": 2, "y": 3}, "br": {"x": 4, "y": 6}, "format": "xyxy"}},
        {"instance_id": "inst_0002", "label_id": 1, "label_name": "rotor", "attributes": {}, "center_point": {"x": 4.0, "y": 3.0}}]
    assert got[1]["annotations"] == [] and "metadata" not in got[1] and got[2]["annotations"] == [] and got[2]["metadata"] == {"k": 1, "mask_source": "label_studio_manual"}
    assert got[3]["annotations"] == [boxed] and "metadata" not in got[3] and got[4]["size"] == [40, 20] and got[4]["annotations"][0]["bbox"]["br"] == {"x": 20, "y": 10}
    assert {r["label_name"]: r["label_id"] for r in table.collect()} == {"rotor": 1, "fan": 2}


def test_names_within_names(spark):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("ab1_"), n))
    short, long_ = sorted({word(k) for k in (1, 2, 3, 5, 9, 12) for _ in range(6)}), sorted({word(k) for k in (1, 4, 11, 40) for _ in range(15)})
    long_ += [f"x{short[-1]}y", "é" + short[0]]
    got = sync.contained(spark.createDataFrame([(s,) for s in short], "needle string"), spark.createDataFrame([(s,) for s in long_], "hay string")).collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a in short for b in long_ if a in b)
    assert sync.contained(spark.createDataFrame([], "needle string"), spark.createDataFrame([("a",)], "hay string")).count() == 0


def test_text(spark):
    assert one(spark, X.relative_uri(F.lit("/a/b/c.jpg"), "/a/x/y")) == "../../b/c.jpg"
    assert one(spark, X.task_image_url(F.lit("a b/é.jpg"))) == "/data/local-files/?d=a%20b/%C3%A9.jpg"
    assert one(spark, X.sanitize_label(F.lit(" a  b__c/ "))) == "a_b_c"
    assert one(spark, X.sequential_id(F.lit(7), "obj_", 5)) == "obj_00007" and one(spark, X.file_stem(F.lit("a/b.c.jpg"))) == "b.c"
    with pytest.raises(Exception, match="label name"):
        one(spark, X.sanitize_label(F.lit("//")))
    assert X.class_prompt({"a": ["d"], "b": []}, True).split("classes:\n\n")[1].startswith("# a\n- d\n\n# b\n\nIf none")
    assert "classes: a, b. If none" in X.class_prompt({"a": None, "b": None})


def test_masks_drawn_together_equal_those_drawn_alone(monkeypatch):
    """Brushes, polygons and neither in portions of several sizes, images without pixels among them; the codes too."""
    rng = np.random.default_rng(3)
    rows, want = [], []
    for k in range(400):
        w, h = int(rng.integers(k % 25 > 0, 60)), int(rng.integers(1, 50))
        brush = points = None
        if k % 4 == 1:
            brush = [b - 256 * (b > 127) for b in masks.brush_of(masks.runs_of(rng.random((h, w)) < 0.3), w, h)]
        elif k % 4:
            points = rng.uniform(-30, 130, (int(rng.integers(0, 9)), 2)).round(k % 3).tolist()
        rows.append((brush, points, w, h))
        want.append(masks.brush_runs(brush, w, h) if brush is not None else None if points is None else masks.polygon_runs(points, w, h))
    kinds = (pa.list_(pa.int32()), pa.list_(pa.list_(pa.float64())), pa.int32(), pa.int32())
    for together in (1, 2000, masks.TOGETHER):
        monkeypatch.setattr(masks, "TOGETHER", together)
        values, counts, known = masks.drawn_runs(*[pa.array(c, t) for c, t in zip(zip(*rows), kinds)])
        assert [v.tolist() if k else None for v, k in zip(np.split(values, np.cumsum(counts)[:-1]), known)] == want
        heights = np.array([r[3] for r in rows])
        for runs, r, g in zip(want, rows, masks.geometry_many(values, counts, heights).to_pylist()):
            if not runs or not sum(runs[1::2]):
                assert g == dict.fromkeys(("x1", "y1", "x2", "y2", "cx", "cy")) | {"area": 0}
                continue
            y, x = np.nonzero(masks.mask_of(runs, r[3], r[2]))
            assert (g["x1"], g["y1"], g["x2"], g["y2"], g["area"]) == (x.min(), y.min(), x.max() + 1, y.max() + 1, len(x))
            assert (g["cx"], g["cy"]) == pytest.approx((x.mean(), y.mean()))
        assert masks._texts(values, counts, known).to_pylist() == [None if r is None else masks.pack_runs(r) for r in want]


def test_many_small_masks_are_drawn_quickly():
    """One by one, these took a minute and more."""
    n = 100_000
    box = pa.array([[[5.0, 10.0], [25.0, 10.0], [25.0, 40.0], [5.0, 40.0]]] * n, pa.list_(pa.list_(pa.float64())))
    start = time.time()
    masks.drawn_runs(pa.nulls(n, pa.list_(pa.int32())), box, pa.array([40] * n, pa.int32()), pa.array([20] * n, pa.int32()))
    assert time.time() - start < 20


def test_no_side_of_a_review_is_broadcast_but_the_labels(spark):
    """What tasks and samples are made of passes no driver, however small their columns look to the planner."""
    plan = plans.synced_records(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1


def test_a_task_holds_no_more_of_many_images(spark, monkeypatch):
    """Partitions follow the images, and neither these nor their annotations are broadcast."""
    images, annots = spark.range(900).withColumnRenamed("id", "image_id"), spark.range(1800).select((F.col("id") % 600).alias("image_id"), F.col("id").alias("at"))
    monkeypatch.setattr(convert, "IMAGES_A_TASK", 20)
    grouped = convert.group_annotations(images, annots)
    assert convert.partitions(images) == 45 and grouped.rdd.getNumPartitions() == 45
    assert sorted(len(r["annotations"]) for r in grouped.collect()) == [0] * 300 + [3] * 600
    made = plans.group_annotations(spark, SF)
    assert made.rdd.getNumPartitions() == convert.partitions(plans._images(spark, SF)) and "orderkey" not in "".join(x for x in made._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in x)


def test_label_tables(spark):
    declared = spark.createDataFrame([("b", None, 0), ("a", "x", 1)], "label string, description string, ord int")
    seen = spark.createDataFrame([("c", 0), ("a", 1)], "label string, ord int")
    assert [tuple(r) for r in convert.label_table(declared, seen).orderBy("label_id").collect()] == [(1, "b", None), (2, "a", "x"), (3, "c", None)]


def test_image_listing(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (30).to_bytes(4, "big") + (20).to_bytes(4, "big") + b"\x08"
    bmp = b"BM" + bytes(16) + (7).to_bytes(4, "little") + (-5).to_bytes(4, "little", signed=True)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (40).to_bytes(2, "big") + (60).to_bytes(2, "big") + bytes(8)
    exif = b"\xff\xd8\xff\xe1\xff\xff" + bytes(65533) + b"\xff\xe2\x10\x00" + bytes(4094) + b"\xff\xc2\x00\x11\x08" + (41).to_bytes(2, "big") + (61).to_bytes(2, "big") + bytes(8)
    tag = lambda k, v: k.to_bytes(2, "little") + (3).to_bytes(2, "little") + (1).to_bytes(4, "little") + v.to_bytes(4, "little")
    tiff = b"II*\x00" + (8).to_bytes(4, "little") + (2).to_bytes(2, "little") + tag(256, 11) + tag(257, 12)
    for name, data in {"c.png": png, "a.BMP": bmp, "b.jpg": jpeg, "d.tiff": tiff, "e.png": b"junk", "f.txt": png, "g h+%.jpeg": exif, "i.jpg": jpeg[:9]}.items():
        (tmp_path / name).write_bytes(data)
    got = [(os.path.basename(r["image"]), r["width"], r["height"]) for r in detection.list_images(spark, str(tmp_path)).collect()]
    assert got == [("a.BMP", 7, 5), ("b.jpg", 60, 40), ("c.png", 30, 20), ("d.tiff", 11, 12), ("g h+%.jpeg", 61, 41)]
    reads = []
    assert detection.size_of_image(lambda at, n: reads.append(n) or exif[at : at + n]) == (61, 41) and sum(reads) < 100


def test_dataset_report(spark, tmp_path):
    df = spark.createDataFrame([(k, [("user", [("text", None, "w " * k)])]) for k in range(30)], "idx long, messages array<struct<role:string,content:array<struct<type:string,path:string,text:string>>>>")
    r = stats.dataset_statistics(df, "train", "idx", {"raw_token_length": stats.captured(lambda t: 1 // 0, F.lit("x")), "collated_label_length": F.when(F.col("idx") > 27, 5)}, max_length=3)
    one = r.first()
    assert one["num_errors"] == 30 and len(one["errors"]) == 20 and one["errors"][0].asDict() == {"sample_index": 0, "stage": "raw_inspection", "error": repr(ZeroDivisionError("integer division or modulo by zero"))}
    assert one["raw_token_length"]["count"] == 0 and one["raw_token_length"]["mean"] is None and one["collated_label_length"]["num_over_max_length"] == 2 and one["messages_per_sample"]["mean"] == 1 and one["label_distribution"] == {}
    sinks.write_statistics(r, str(tmp_path / "report"))
    doc = json.loads("\n".join(x.value for x in spark.read.text(str(tmp_path / "report")).collect()))
    assert doc["split"] == "train" and doc["num_samples_total"] == 30 and doc["collated_input_length"]["count"] == 0 and list(doc)[:3] == ["split", "num_samples_total", "num_samples_inspected"]
    plain = stats.dataset_statistics(df, "val", "idx", max_samples=10).first()
    assert plain["num_samples_inspected"] == 10 and plain["raw_token_length"]["max"] == 28 and plain["num_errors"] == 0 and plain["errors"] == []
    with pytest.raises(DatasetBuildError):
        stats.dataset_statistics(df, "x", "idx", {"odd": F.lit(1)})


def test_legacy_rows_and_structure(spark):
    df = spark.createDataFrame([("a.jpg", 200, 100, [("PET", [10.0, 20.0, 30.0, 40.0])])], "image string, width int, height int, annotations array<struct<class:string,bbox:array<double>>>")
    r = messages.legacy_rows(df, {"PET": ["bottle"]}, 1.0, image_root="/r").first()
    assert json.loads(r["target"]) == [{"class": "PET", "box": [0.05, 0.2, 0.2, 0.6]}] and "# PET" in r["prompt"] and r["image_root"] == "/r"
    kind = "messages array<struct<role:string,content:array<struct<type:string,text:string>>>>, images map<string,string>, target struct<instances:array<struct<label:string>>>"
    df = spark.createDataFrame([([("u", [("text", "x"), ("image", None)])], {"q": "a"}, ([("PET",), (None,)],)), (None, None, None)], kind)
    rows = [tuple(r[0]) for r in df.select(stats.sample_structure(df)).collect()]
    assert rows == [(1, 1, 1, 1, 2, ["PET"]), (0, 0, 0, 0, 0, [])]


def test_stream_of_manifests(spark, tmp_path):
    from boxloom.streaming.manifests import stream_samples

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(json.dumps(x) for x in (HEADER, {"record_type": "sample", "sample": RECORD}, {"record_type": "sample", "sample": {**RECORD, "sample_type": "odd"}})))
    q = stream_samples(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {r["problem"] for r in spark.table("streamed").collect()} == {None, "unknown sample_type"}


@pytest.mark.parametrize("parts", [None, 1, 7, 40])
def test_one_file_from_many_tasks(spark, tmp_path, parts):
    """Byte for byte what one task writes, over an older file, with empty, long and non-ASCII lines and keys out of order."""
    import glob

    from boxloom.sources import sinks

    value = F.when(F.col("id") % 11 == 0, "").when(F.col("id") == 500, F.repeat(F.lit("é"), 300_000)).otherwise(F.concat(F.lit("line é "), F.col("id").cast("string")))
    lines = spark.range(3000).repartition(5, F.hash("id")).select((F.col("id") - 7).alias("n"), value.alias("value"))
    want = "".join(("" if k % 11 == 0 else "é" * 300_000 if k == 500 else f"line é {k}") + "\n" for k in range(3000)).encode()
    path = tmp_path / "deep" / "out.jsonl"
    for _ in range(2):
        sinks.write_lines(lines, str(path), parts)
        assert [os.path.basename(p) for p in glob.glob(f"{path}/*")].count("part-00000.txt") == 1
        assert (path / "part-00000.txt").read_bytes() == want
    sinks.write_lines(lines.limit(0), str(path), parts)
    assert (path / "part-00000.txt").read_bytes() == b""
    assert sorted(os.listdir(path.parent)) == ["out.jsonl"] and [r.value for r in spark.read.text(str(path)).collect()] == []


def test_a_failed_write_leaves_the_older_file(spark, tmp_path):
    from boxloom.sources import sinks

    path = tmp_path / "out"
    sinks.write_lines(spark.createDataFrame([(1, "old")], "n long, value string"), str(path))
    broken = spark.range(100).select(F.col("id").alias("n"), F.when(F.col("id") == 50, F.raise_error(F.lit("broken")).cast("string")).otherwise("x").alias("value"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_lines(broken, str(path), 4)
    assert (path / "part-00000.txt").read_text() == "old\n" and sorted(os.listdir(tmp_path)) == ["out"]


def test_conversion_of_a_registered_class(spark, tmp_path):
    """A class of the user's own is read by its reader; one that is unknown, taken or short of columns raises."""
    from boxloom.sources import conversion

    boxes = "pos int, image string, width int, height int, annotations array<struct<class:string,bbox:array<double>>>"
    spark.createDataFrame([(0, "a.png", 100, 50, [("cup", [1.0, 2.0, 10.0, 10.0])]), (1, "b.png", 100, 50, []), (2, "c.png", 100, 50, [("cup", [0.0, 0.0, 5.0, 5.0]), ("jar", [200.0, 0.0, 5.0, 5.0])])], boxes).write.parquet(str(tmp_path / "t"))
    (tmp_path / "t.yaml").write_text("dataset: TableDataset\ndata_dicts: {one: {path: t, folder: im}}\nCLASSES: {cup: [a cup]}\n")
    (tmp_path / "u.yaml").write_text("dataset: NoSuchDataset\ndata_dicts: {one: {path: t}}\nCLASSES: {cup: []}\n")
    seen = []

    def read_table(spark, path, folder):
        seen.append((path, folder))
        return spark.read.parquet(path)

    known = dict(detection.SOURCES)
    try:
        detection.register_source("TableDataset", read_table)
        detection.register_source("TableDataset", read_table)
        with pytest.raises(DatasetBuildError, match="already"):
            detection.register_source("coco", read_table)
        said = conversion.convert_configs(spark, [str(tmp_path / "t.yaml")], str(tmp_path / "out"), {"uri_mode": "relative", "drop_empty": True})
        assert set(seen) == {(str(tmp_path / "t"), "im")}
        assert said["num_samples_written"] == 2 and said["num_invalid_annotations_skipped"] == 1 and said["labels"] == {"cup": 1, "jar": 2}
        rows = manifest.read_samples(spark, said["merged_output"]).orderBy("line_no").collect()
        assert [(r["sample_id"], len(r["assets"][0]["annotations"])) for r in rows] == [("t_one_000001", 1), ("t_one_000003", 1)]
        with pytest.raises(DatasetBuildError, match="unknown dataset class"):
            conversion.convert_configs(spark, [str(tmp_path / "u.yaml")], str(tmp_path / "out2"))
        detection.SOURCES["NoSuchDataset"] = lambda s, p, f: s.read.parquet(p).drop("width")
        with pytest.raises(DatasetBuildError, match="gives no width"):
            conversion.convert_configs(spark, [str(tmp_path / "u.yaml")], str(tmp_path / "out3"))
    finally:
        detection.SOURCES.clear()
        detection.SOURCES.update(known)
