"""Matching of predicted with true boxes, and the metrics from it.

Greedy one-to-one matching takes candidates by falling IoU. Those above a threshold are a prefix of
that order, so one matching at the smallest IoU serves every threshold. A sample's boxes meet in one
row by a single shuffle and are matched there, many samples at once; those of a crowded sample meet in the cells of
a grid, and its greedy pass is a fold over the sorted candidates inside the JVM.
"""

from __future__ import annotations

from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.errors import DatasetBuildError
from boxloom.functions.geometry import iou, rounded, safe_div
from boxloom.operators.masks import places_within

#: Least IoU that counts as an overlap at all.
TINY = 1e-9
FOUND = "array<struct<iou:double,gt_idx:int,pred_idx:int>>"


def side_by_side(gt: DataFrame, pred: DataFrame, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Full outer by keys: arrays gt and pred of struct(idx, label, x1, y1, x2, y2), empty where a side has none."""
    cols = [F.col(c) for c in ("idx", "label", "x1", "y1", "x2", "y2")]
    rows = gt.select(*keys, F.lit(0).alias("side"), F.struct(*cols).alias("box")).unionByName(
        pred.select(*keys, F.lit(1).alias("side"), F.struct(*cols).alias("box")))
    pick = lambda k: F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("box"))))
    return rows.groupBy(*keys).agg(pick(0).alias("gt"), pick(1).alias("pred"))


def _candidate(g: Column, i: Column, p: Column, j: Column) -> Column:
    """Sorted by falling IoU, then indices; g and p are the boxes' places in their arrays."""
    return F.struct((-iou(g, p)).alias("neg"), g["idx"].alias("gt_idx"), p["idx"].alias("pred_idx"), i.cast("int").alias("g"), j.cast("int").alias("p"))


def candidates(least: float, class_aware: bool) -> Column:
    """array<struct(neg, gt_idx, pred_idx, g, p)> of the pairs of a row, by falling IoU, then indices."""
    def near(g: Column, i: Column) -> Column:
        pair = lambda p, j: _candidate(g, i, p, j)
        each = F.transform("pred", (lambda p, j: F.when(p["label"] == g["label"], pair(p, j))) if class_aware else pair)
        return F.filter(each, lambda c: -c["neg"] >= least)

    return F.array_sort(F.flatten(F.transform("gt", near)))


def grid_candidates(rows: DataFrame, least: float, class_aware: bool, keys: tuple[str, ...]) -> DataFrame:
    """keys and the candidates of rows of many boxes, for a least IoU above 0, without meeting all pairs.

    A box is posted to the cells of its sample's grid that it touches; two boxes that overlap meet in the cell of their
    overlap's upper left corner, and only there. Cells are as wide and high as the sample's boxes in the quadratic mean,
    so that postings are at most four times the boxes however unlike these are. Boxes without extent, or with corners
    that are not finite, overlap nothing.
    """
    every = F.concat("gt", "pred")
    sound = lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]) & (F.greatest(*[F.abs(b[c]) for c in ("x1", "y1", "x2", "y2")]) < 1e12)
    mean = lambda lo, hi: F.sqrt(F.aggregate(F.filter(every, sound), F.lit(0.0), lambda a, b: a + (b[hi] - b[lo]) * (b[hi] - b[lo])) / F.greatest(F.size(F.filter(every, sound)), F.lit(1)))
    sized = rows.select(*keys, "gt", "pred", mean("x1", "x2").alias("cw"), mean("y1", "y2").alias("ch")).withColumns({c: F.when(F.col(c) > 0, F.col(c)).otherwise(1.0) for c in ("cw", "ch")})
    cell = lambda v, extent: F.floor(v / F.col(extent))

    def posted(side: str, at: str) -> DataFrame:
        boxes = sized.select(*keys, "cw", "ch", F.posexplode(side).alias(at, side)).filter(sound(F.col(side)))
        b = F.col(side)
        cells = F.flatten(F.transform(F.sequence(cell(b["x1"], "cw"), cell(b["x2"], "cw")), lambda cx: F.transform(
            F.sequence(cell(b["y1"], "ch"), cell(b["y2"], "ch")), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))
        label = [b["label"].alias("label")] if class_aware else []
        return boxes.select(*keys, at, side, "cw", "ch", *label, F.explode(cells).alias("c")).select(*keys, at, side, "cw", "ch", *(["label"] if class_aware else []), "c.cx", "c.cy")

    meet = posted("gt", "g").join(posted("pred", "p").drop("cw", "ch"), [*keys, "cx", "cy", *(["label"] if class_aware else [])])
    g, p = F.col("gt"), F.col("pred")
    once = (cell(F.greatest(g["x1"], p["x1"]), "cw") == F.col("cx")) & (cell(F.greatest(g["y1"], p["y1"]), "ch") == F.col("cy"))
    found = meet.filter(once).select(*keys, _candidate(g, F.col("g"), p, F.col("p")).alias("c")).filter(-F.col("c.neg") >= least)
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("met"))


#: Bits of a word of the maps of taken boxes.
WORD = 62


def greedy(cands: Column, n_gt: Column, n_pred: Column) -> Column:
    """The fold: a candidate is kept if neither of its boxes is taken, which two bitmaps tell."""
    word = lambda at: F.floor(at / WORD).cast("int")
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), (at % WORD).cast("int"))
    is_taken = lambda words, at: F.get(words, word(at)).bitwiseAND(bit(at)) != 0
    take = lambda words, at: F.transform(words, lambda w, i: F.when(i == word(at), w.bitwiseOR(bit(at))).otherwise(w))
    none = lambda n: F.array_repeat(F.lit(0).cast("long"), (F.floor(n / WORD) + 1).cast("int"))

    def step(acc: Column, c: Column) -> Column:
        one = F.struct((-c["neg"]).alias("iou"), c["gt_idx"].cast("int").alias("gt_idx"), c["pred_idx"].cast("int").alias("pred_idx"))
        kept = F.struct(F.concat(acc["found"], F.array(one)).alias("found"), take(acc["gt"], c["g"]).alias("gt"), take(acc["pred"], c["p"]).alias("pred"))
        return F.when(is_taken(acc["gt"], c["g"]) | is_taken(acc["pred"], c["p"]), acc).otherwise(kept)

    zero = F.struct(F.array().cast(FOUND).alias("found"), none(n_gt).alias("gt"), none(n_pred).alias("pred"))
    return F.aggregate(cands, zero, step, lambda acc: acc["found"])


#: Pairs that are matched together.
TOGETHER = 1 << 17


def greedy_pairs(neg: np.ndarray, g: np.ndarray, p: np.ndarray, n_gt: int, n_pred: int) -> np.ndarray:
    """Which pairs the greedy pass takes, best first: in every round those that come first for both of their boxes."""
    order = np.argsort(neg, kind="stable")
    taken = []
    first_g, first_p, free_g, free_p = np.empty(n_gt, dtype=np.int64), np.empty(n_pred, dtype=np.int64), np.ones(n_gt, dtype=bool), np.ones(n_pred, dtype=bool)
    g, p, left = g[order], p[order], np.arange(len(order))
    while len(left):
        first_g[g[left[::-1]]] = left[::-1]  # of several the last that is written stays, the first of the order
        first_p[p[left[::-1]]] = left[::-1]
        best = left[(first_g[g[left]] == left) & (first_p[p[left]] == left)]
        taken.append(best)
        free_g[g[best]] = free_p[p[best]] = False
        left = left[free_g[g[left]] & free_p[p[left]]]
    return order[np.sort(np.concatenate(taken))] if taken else order


def matched(least: float, class_aware: bool):
    """A function (gt, pred) -> matches of rows of boxes by index, as candidates and greedy give them, many rows at once."""
    def match(gt: pa.Array, pred: pa.Array) -> pa.Array:
        boxes = [side.flatten() for side in (gt, pred)]
        sizes = [pc.fill_null(pc.list_value_length(side), 0).to_numpy(zero_copy_only=False).astype(np.int64) for side in (gt, pred)]
        heads = [np.cumsum(n) - n for n in sizes]
        corner = [{c: pc.cast(b.field(c), pa.float64()).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")} for b in boxes]
        whole = [np.logical_and.reduce([b.field(c).is_valid().to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")]) for b in boxes]
        labels = pc.fill_null(pa.concat_arrays([b.field("label") for b in boxes]).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        label = labels[: len(boxes[0])], labels[len(boxes[0]) :]
        side = lambda lo, hi: np.maximum(0.0, hi - lo)
        own = [side(c["x1"], c["x2"]) * side(c["y1"], c["y2"]) for c in corner]
        pairs = sizes[0] * sizes[1]
        found = []
        for rows in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(np.cumsum(pairs) // TOGETHER)) + 1) if len(pairs) else []:
            many = np.repeat(sizes[1][rows], sizes[0][rows])  # pairs of each true box
            row_of = np.repeat(rows, sizes[0][rows])
            true = heads[0][rows[0]] + np.arange(len(row_of))
            g, p = np.repeat(true, many), np.repeat(heads[1][row_of], many) + places_within(many)
            sound = whole[0][g] & whole[1][p]
            if class_aware:
                sound &= (label[0][g] == label[1][p]) & (label[0][g] >= 0)
            g, p = g[sound], p[sound]
            a, b = ({c: v[at] for c, v in of.items()} for of, at in zip(corner, (g, p)))
            # a number that is none counts as the largest, as it does in Spark
            inter = side(np.maximum(a["x1"], b["x1"]), np.fmin(a["x2"], b["x2"])) * side(np.maximum(a["y1"], b["y1"]), np.fmin(a["y2"], b["y2"]))
            union = own[0][g] + own[1][p] - inter
            over = np.divide(inter, union, out=np.zeros(len(g)), where=(union > 0) | np.isnan(union))
            kept = (over >= least) | np.isnan(over)
            g, p, over = g[kept], p[kept], over[kept]
            at, first = heads[0][rows[0]], heads[1][rows[0]]
            chosen = greedy_pairs(-over, g - at, p - first, int(sizes[0][rows].sum()), int(sizes[1][rows].sum()))
            of = row_of[g[chosen] - at]
            chosen, of = chosen[np.argsort(of, kind="stable")], np.sort(of)
            found.append((of, over[chosen], g[chosen], p[chosen]))
        of, over, g, p = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(4))
        idx = [pc.cast(b.field("idx"), pa.int32()).take(pa.array(at)) for b, at in zip(boxes, (g, p))]
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(pairs)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(over.astype(float)), *idx], ["iou", "gt_idx", "pred_idx"]))

    def quiet(gt: pa.Array, pred: pa.Array) -> pa.Array:
        with np.errstate(all="ignore"):
            return match(gt, pred)

    return F.arrow_udf(quiet, FOUND)


#: Pairs of a sample from which on its boxes meet in a grid.
CROWDED = 1 << 16


def match_boxes(gt: DataFrame, pred: DataFrame, threshold: float = TINY, class_aware: bool = True, keys: tuple[str, ...] = ("sample_id",), crowded: int = CROWDED) -> DataFrame:
    """keys, matches, unmatched_gt, unmatched_pred: one row per sample on either side.

    A sample of more than ``crowded`` pairs finds its candidates in a grid, by cells over all tasks; matches are the same.
    Whether there may be one is counted first, from the keys alone. Boxes of one side and sample have different idx.
    """
    rows = side_by_side(gt, pred, keys)
    match = matched(threshold, class_aware)
    matches = match("gt", "pred")
    sides = gt.select(*keys, F.lit(0).alias("_side")).unionByName(pred.select(*keys, F.lit(1).alias("_side")))
    if threshold > 0 and not sides.groupBy(*keys, "_side").count().filter(F.col("count") > isqrt(crowded)).isEmpty():
        many = F.size("gt").cast("long") * F.size("pred") > crowded
        for k in keys:
            many &= F.col(k).isNotNull()
        grid = grid_candidates(rows.filter(many), threshold, class_aware, keys)
        rows = rows.join(grid, list(keys), "left")
        met = F.coalesce("met", F.array().cast(dict(grid.dtypes)["met"]))
        matches = F.when(many, greedy(met, F.size("gt"), F.size("pred"))).otherwise(match(F.when(~many, F.col("gt")), F.when(~many, F.col("pred"))))
    rows = rows.withColumn("matches", matches)
    free = lambda side, idx: F.array_except(F.transform(side, lambda b: b["idx"].cast("int")), F.transform("matches", lambda m: m[idx]))
    return rows.withColumn("unmatched_gt", free("gt", "gt_idx")).withColumn("unmatched_pred", free("pred", "pred_idx")).select(*keys, "gt", "pred", "matches", "unmatched_gt", "unmatched_pred")


def metrics_by_threshold(gt: DataFrame, pred: DataFrame, thresholds: list[float], class_aware: bool = True, keys: tuple[str, ...] = ("sample_id",), by: tuple[str, ...] = ()) -> DataFrame:
    """One row per group of ``by`` and threshold; ``by`` names columns of both sides (a model, say)."""
    if not thresholds:
        raise DatasetBuildError("at least one threshold is required")
    matched = match_boxes(gt, pred, min(TINY, *thresholds), class_aware, (*by, *keys))
    tiny = F.filter("matches", lambda m: m["iou"] >= TINY)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, m: a + m["iou"])
    sums = [F.sum(F.size("gt")).alias("n_gt"), F.sum(F.size("pred")).alias("n_pred"), F.sum(total(tiny)).alias("iou_tiny"), F.sum(F.size(tiny)).alias("n_tiny")]
    above = lambda t: F.filter("matches", lambda m: m["iou"] >= t)
    for k, t in enumerate(thresholds):
        kept = above(t)
        sums += [F.sum(F.size(kept)).alias(f"tp{k}"), F.sum(total(kept)).alias(f"iou{k}")]
    one = matched.groupBy(*by).agg(*sums)
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(k).alias("no"), F.col(f"tp{k}").alias("tp"), F.col(f"iou{k}").alias("iou")) for k, t in enumerate(thresholds)])
    rows = one.select(*by, "n_gt", "n_pred", "iou_tiny", "n_tiny", F.explode(each).alias("e")).select(
        *by, "e.threshold", "e.no", "e.tp", "e.iou", (F.col("n_pred") - F.col("e.tp")).alias("fp"), (F.col("n_gt") - F.col("e.tp")).alias("fn"), "n_gt", "iou_tiny", "n_tiny")
    p, r = safe_div(F.col("tp"), F.col("tp") + F.col("fp")), safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return rows.withColumn("precision", p).withColumn("recall", r).select(
        *by, "threshold", "tp", "fp", "fn", "precision", "recall",
        safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"),
        safe_div(F.col("iou"), F.col("tp")).alias("mean_iou_tp"), safe_div(F.col("iou_tiny"), F.col("n_gt")).alias("miou_gt_penalized"),
        safe_div(F.col("iou_tiny"), F.col("n_tiny")).alias("mean_iou_positive_matches"), "no",
    )


def best_by_f1(metrics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The row of each group with the largest (f1, threshold); the first given of an exact tie."""
    best = metrics.groupBy(*by).agg(F.max_by(F.struct(*[c for c in metrics.columns if c not in by]), F.struct("f1", "threshold", -F.col("no"))).alias("b"))
    return best.select(*by, *[F.col(f"b.{c}").alias(f"best_{c}") for c in ("threshold", "f1", "precision", "recall")], "b.miou_gt_penalized", "b.mean_iou_positive_matches")


def best_summary(table: DataFrame, row_order: str = "row_no") -> DataFrame:
    """Best row a model of merged metric tables: f1, then threshold, downward, NaN and null last, then input order.

    Without a column f1 the first row of each model. Only the columns there are come along.
    """
    if "f1" in table.columns:
        keys = [F.desc_nulls_last(F.nanvl("f1", F.lit(None).cast("double"))), F.desc_nulls_last(F.nanvl("threshold", F.lit(None).cast("double")))]
    else:
        keys = []
    ranked = table.withColumn("rn", F.row_number().over(Window.partitionBy("model").orderBy(*keys, row_order))).filter("rn = 1")
    new = {"threshold": "best_threshold", "f1": "best_f1", "precision": "best_precision", "recall": "best_recall"}
    rest = ("miou_gt_penalized", "mean_iou_positive_matches", "mean_iou_tp", "tp", "fp", "fn")
    return ranked.select("model", *[F.col(a).alias(b) for a, b in new.items() if a in table.columns], *[c for c in rest if c in table.columns]).orderBy("model")


def box_status(matched: DataFrame, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """One row a box: keys, side, idx, status TP, FP or FN, iou, text and corners, for rendering.

    text is what a picture writes at the box: status, label and, on predictions that hit, the IoU with two places; GT at the
    true boxes that are hit.
    """
    corners = ("x1", "y1", "x2", "y2")
    found = lambda key: F.map_from_entries(F.transform("matches", lambda m: F.struct(m[key], m["iou"])))
    hits = {"gt": found("gt_idx"), "pred": found("pred_idx")}

    def each(side: str, missed: str) -> Column:
        def one(b: Column) -> Column:
            iou_ = F.try_element_at(hits[side], b["idx"].cast("int"))
            share = F.format_string(" | IoU=%.2f", rounded(iou_, 2)) if side == "pred" else F.lit("")
            text = F.when(iou_.isNotNull(), F.concat(F.lit("TP " if side == "pred" else "GT "), b["label"], share)).otherwise(F.concat(F.lit(missed + " "), b["label"]))
            return F.struct(F.lit(side).alias("side"), b["idx"].cast("int").alias("idx"), F.when(iou_.isNotNull(), "TP").otherwise(missed).alias("status"), iou_.alias("iou"), text.alias("text"), *[b[c].alias(c) for c in corners])

        return F.transform(side, one)

    return matched.select(*keys, F.explode(F.concat(each("gt", "FN"), each("pred", "FP"))).alias("b")).select(*keys, "b.*")


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """In the given order, columns united, with the table's number."""
    if not tables:
        raise DatasetBuildError("no datasets given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("src_no", F.lit(k)) for k, t in enumerate(tables)])
