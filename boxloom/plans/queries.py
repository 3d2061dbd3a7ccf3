"""Driver queries over the star schema: boxes, labels and messages are derived from its tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxloom.functions import geometry as G
from boxloom.functions import text as X
from boxloom.operators import convert, masks, matching, parsing, records, stats, sync

THRESHOLDS = (0.1, 0.25, 0.5, 0.75, 0.9)
BOX = ("x1", "y1", "x2", "y2")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """side 0 (truth) for even orders, 1 for odd ones; eight orders a sample."""
    q, ln = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    x1, y1 = F.col("l_partkey") * 7 % 60, F.col("l_suppkey") * 13 % 60
    rows = _t(spark, d, "lineitem").select(
        F.floor(F.col("l_orderkey") / 8).alias("sample_id"), (F.col("l_orderkey") % 2).cast("int").alias("side"), (ln % 2).alias("m"),
        "l_orderkey", ln.alias("l_linenumber"), F.col("l_returnflag").alias("label"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"),
        (x1 + 10 + q % 20).cast("double").alias("x2"), (y1 + 10 + ln % 7 * 3).cast("double").alias("y2"))
    order = Window.partitionBy("sample_id", "side").orderBy("l_orderkey", "l_linenumber", "label", *BOX)
    return rows.withColumn("idx", (F.row_number().over(order) - 1).cast("int"))


def _sides(spark, d):
    b = boxes(spark, d)
    return b.filter("side = 0"), b.filter("side = 1")


def iou_pairs(spark, d):
    rows = matching.side_by_side(*_sides(spark, d)).withColumn("c", F.explode(matching.candidates(0.5, True)))
    return rows.select("sample_id", F.col("c.gt_idx").alias("gt_idx"), F.col("c.pred_idx").alias("pred_idx"), F.round(-F.col("c.neg"), 9).alias("iou"))


def _matches(spark, d, class_aware):
    m = matching.match_boxes(*_sides(spark, d), class_aware=class_aware)
    return m.select("sample_id", F.explode("matches").alias("m")).select("sample_id", "m.gt_idx", "m.pred_idx", F.round("m.iou", 9).alias("iou"))


def match_greedy(spark, d):
    return _matches(spark, d, True)


def match_class_agnostic(spark, d):
    return _matches(spark, d, False)


def box_status(spark, d):
    done = matching.box_status(matching.match_boxes(*_sides(spark, d), threshold=0.5))
    return done.select("sample_id", "side", "idx", "status", "text", "x1", "y2")


def _metrics(spark, d):
    gt, pred = _sides(spark, d)
    models = F.explode(F.array(F.lit("m0"), F.lit("m1")))
    return matching.metrics_by_threshold(gt.withColumn("model", models), pred.withColumn("model", F.concat(F.lit("m"), F.col("m").cast("string"))), list(THRESHOLDS), by=("model",))


def _rounded(df, *keep):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def metrics_by_threshold(spark, d):
    return _rounded(_metrics(spark, d).drop("no"), "threshold")


def summary_best_f1(spark, d):
    return _rounded(matching.best_by_f1(_metrics(spark, d), ("model",)))


def outer_align(spark, d):
    rows = matching.side_by_side(*_sides(spark, d))
    return rows.select("sample_id", F.size("gt").alias("n_gt"), F.size("pred").alias("n_pred"))


def _images(spark, d):
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select(k.alias("image_id"), (k % 5 * 128 + 640).cast("int").alias("width"), (k % 3 * 120 + 480).cast("int").alias("height"))


def _raw_boxes(spark, d):
    lines, images = _t(spark, d, "lineitem"), _images(spark, d)
    if many := convert.partitions(images):
        lines, images = lines.repartition(many, "l_orderkey"), images.repartition(many, "image_id")
    li = lines.join(images.hint("merge"), F.col("l_orderkey") == F.col("image_id"))
    return li.select(
        "image_id", "width", "height", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"), (F.col("l_suppkey") % 30).cast("int").alias("category_id"),
        (F.col("l_partkey") % F.col("width") - 20).cast("double").alias("x"), (F.col("l_suppkey") * 11 % F.col("height") - 10).cast("double").alias("y"),
        (F.col("l_quantity") * 3.3).alias("w"), (F.col("l_linenumber") * 9.7 - 9.7).alias("h"))


def xywh_clip(spark, d):
    r = _raw_boxes(spark, d).withColumn("box", G.xywh_to_xyxy(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width"), F.col("height")))
    return r.select("image_id", "p", "s", "n", "box.*", G.is_valid(F.col("box")).alias("valid"), G.center(F.col("box"))["x"].alias("cx"), G.center(F.col("box"))["y"].alias("cy"))


def yolo_to_xywh(spark, d):
    u = lambda c, m: (F.col(c) * m % 1000) / 1000
    r = _raw_boxes(spark, d).withColumn("b", G.yolo_to_xywh(u("p", 37), u("s", 91), u("p", 11), u("n", 130), F.col("width"), F.col("height")))
    return r.select("image_id", "p", "s", "n", *[F.round(f"b.{c}", 6).alias(c) for c in "xywh"])


def normalize_text(spark, d):
    r = boxes(spark, d)
    return r.select("sample_id", "side", "idx", X.to_text(*[G.normalize(F.col(c), 160) for c in BOX]).alias("txt"))


def denormalize_clip(spark, d):
    r = _raw_boxes(spark, d)
    coords = F.array((F.col("p") * 7 % 1300 - 100).cast("double"), (F.col("s") * 13 % 1300 - 100).cast("double"), (F.col("p") * 3 % 1300 - 100).cast("double"), (F.col("n") * 170).cast("double"))
    return r.withColumn("b", G.to_pixels(coords, F.col("width"), F.col("height"))).select("image_id", "p", "s", "n", "b.*")


def sanitize_labels(spark, d):
    return _t(spark, d, "part").select("p_partkey", X.sanitize_label(F.concat("p_name", F.lit(" /"), "p_type")).alias("label_name"))


def label_table(spark, d):
    declared = _t(spark, d, "nation").select(F.col("n_name").alias("label"), F.concat(F.lit("nation "), "n_name").alias("description"), F.col("n_nationkey").alias("ord"))
    return convert.label_table(declared, _t(spark, d, "part").select(F.col("p_brand").alias("label"), F.col("p_partkey").alias("ord")))


def label_collisions(spark, d):
    brand = F.col("p_brand")
    written = F.array(brand, F.replace(brand, F.lit("#"), F.lit(" ")), F.concat(F.lit("_"), F.replace(brand, F.lit("#"), F.lit("__"))))
    return convert.label_collisions(_t(spark, d, "part").select(F.explode(F.slice(written, 1, (F.col("p_partkey") % 3 + 1).cast("int"))).alias("label")))


def _named(spark, d):
    names = _t(spark, d, "nation").select(F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("class"))
    return _raw_boxes(spark, d).join(F.broadcast(names), "category_id", "left")  # a nation table has 25 rows


def _nation_labels(spark, d):
    return _t(spark, d, "nation").select(X.sanitize_label(F.col("n_name")).alias("label_name"), (F.col("n_nationkey") + 1).alias("label_id"))


def invalid_counts(spark, d):
    rows = _named(spark, d).withColumn("bbox", F.array("x", "y", "w", "h")).withColumn("at", F.col("p"))
    done = convert.convert_boxes(rows, F.broadcast(_nation_labels(spark, d)))  # 25 rows
    kept = done.select("image_id", F.struct("p", "s", "n").alias("at"), "valid")
    return convert.conversion_counts(convert.group_annotations(_images(spark, d), kept, spread=False))


def category_filter(spark, d):
    named = _named(spark, d)
    kept = convert.keep_categories(named, _t(spark, d, "nation").select(F.col("n_nationkey").alias("category_id")), [1, 3, 5, 7])
    return kept.groupBy("category_id", "class").agg(F.count(F.lit(1)).alias("n"))


def group_annotations(spark, d):
    rows = _named(spark, d).select("image_id", F.struct("p", "s", "n").alias("at"), F.coalesce("class", F.lit("?")).alias("class"))
    g = convert.group_annotations(_images(spark, d), rows, spread=False)
    return g.select("image_id", F.array_join(F.transform("annotations", lambda a: a["class"]), ",").alias("classes"))


def label_consistency(spark, d):
    named = _named(spark, d).select("category_id", "class")
    return named.groupBy("category_id").agg(F.count_if(F.col("class").isNull()).alias("unknown"), F.count_if(F.col("class").isNotNull()).alias("known"))


def _answers(spark, d):
    norm = lambda c: G.half_even(G.normalize(F.col(c), 160)).cast("string")
    item = F.concat(F.lit("<"), "label", F.lit(","), F.concat_ws(",", *[norm(c) for c in BOX]), F.lit(">"))
    rows = boxes(spark, d).filter("side = 1").withColumn("item", item)
    t = rows.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "item"))), lambda s: s["item"]), ";").alias("t"))
    k = F.col("sample_id")
    return t.select("sample_id", F.when(k % 17 == 0, "no boxes in sight").when(k % 13 == 0, "<none>").when(k % 11 == 0, F.concat(F.lit("let me see <x,1,2,3,4></think> "), "t")).when(k % 7 == 0, F.concat(F.lit("<answer>"), "t", F.lit("</answer>"))).otherwise(F.col("t")).alias("answer"))


def clean_text(spark, d):
    return _answers(spark, d).select("sample_id", X.clean_answer(F.col("answer")).alias("cleaned"))


def parse_tags(spark, d):
    p = parsing.parse_answers(_answers(spark, d).withColumn("width", F.lit(160)).withColumn("height", F.lit(160)), "answer", "tag_bbox_list")
    return p.select(
        "sample_id", "parsed.valid", "parsed.is_empty", F.size("parsed.annotations").alias("n_items"), F.size("parsed.errors").alias("n_errors"),
        F.aggregate("parsed.annotations", F.lit(0).cast("long"), lambda a, x: a + x["bbox"]["x1"] + x["bbox"]["y1"] + x["bbox"]["x2"] + x["bbox"]["y2"]).alias("corner_sum"))


def _messages(spark, d):
    part = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("path"), "text")
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.struct("role", F.array(part).alias("content")).alias("m"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda s: s["m"]).alias("messages"))


def flatten_messages(spark, d):
    return _messages(spark, d).select("conv_id", X.flatten_messages(F.col("messages")).alias("txt"))


def structure_counts(spark, d):
    none = F.lit(None).cast("string")
    text = F.struct(F.lit("text").alias("type"), none.alias("path"), F.col("text").alias("text"))
    image = F.struct(F.lit("image").alias("type"), F.lit("a.jpg").alias("path"), none.alias("text"))
    parts = F.when(F.col("turn") % 3 == 1, F.array(image, text)).when(F.col("turn") % 3 == 2, F.array(text, image, image)).otherwise(F.array(text))
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.struct("role", parts.alias("content")).alias("m"))
    m = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda s: s["m"]).alias("messages"))
    return m.select("conv_id", stats.structure_counts(F.col("messages")).alias("s")).select("conv_id", "s.*")


def numeric_stats(spark, d):
    return _rounded(stats.numeric_stats(_t(spark, d, "documents"), "n_chars", ("lang",), 2000))


def _words_or_error(text):
    words = re.findall(r"[^ \n\t]+", text)
    if len(words) % 5 == 0:
        raise ValueError("a fifth")
    return len(words)


def dataset_statistics(spark, d):
    """A report, a row a distribution: two of three turns are inspected for words, of which some cannot be counted."""
    none = F.lit(None).cast("string")
    text = F.struct(F.lit("text").alias("type"), none.alias("path"), F.col("text").alias("text"))
    image = F.struct(F.lit("image").alias("type"), F.lit("a.jpg").alias("path"), none.alias("text"))
    parts = F.when(F.col("turn") % 3 == 1, F.array(image, text)).otherwise(F.array(text))
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.struct("role", parts.alias("content")).alias("m"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("t"))
    named = grouped.select("conv_id", F.transform("t", lambda x: x["m"]).alias("messages"), F.struct(F.transform(F.filter("t", lambda x: x["turn"] > 0), lambda x: F.struct(x["m"]["role"].alias("label"))).alias("instances")).alias("target"))
    data = stats.numbered(named, "conv_id", "idx")
    words = stats.captured(_words_or_error, X.flatten_messages(F.col("messages")))
    report = stats.dataset_statistics(data, "train", "idx", {"raw_token_length": words, "collated_input_length": F.size("messages") * 7}, 25, 40)
    fields = ("count", "min", "mean", "std", "median", "p90", "p95", "p99", "max")
    over = lambda n: (F.col(n)["num_over_max_length"] if n in stats.LENGTHS else F.lit(None)).cast("bigint").alias("over")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), *[(F.col(n)[f] if f in ("count", "min", "max") else F.round(F.col(n)[f], 6)).alias(f) for f in fields], over(n)) for n in (*stats.LENGTHS, *stats.COUNTS)])).alias("x")
    labels = F.array_join(F.transform(F.map_entries("label_distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return report.select("num_samples_total", "num_samples_inspected", "num_errors", F.element_at("errors", 1)["sample_index"].alias("first_error"), F.size("errors").alias("told"), labels.alias("labels"), each).select("*", "x.*").drop("x")


def label_histogram(spark, d):
    return stats.label_histogram(_t(spark, d, "labels"), "quality")


def stride_sample(spark, d):
    docs = _t(spark, d, "documents")
    n = docs.agg(F.count(F.lit(1)).alias("total"))
    return docs.join(F.broadcast(n), F.lit(True)).filter(stats.is_stride_pick(F.col("doc_id"), F.col("total"), 77)).select("doc_id")


def batches(spark, d):
    return _t(spark, d, "documents").groupBy(stats.batch_number(F.col("doc_id"), 16).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"))


def topn_ids(spark, d):
    return stats.first_by_id(_t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id")), "id", 20)


def split_counts(spark, d):
    return stats.train_val_split(_t(spark, d, "documents").select("doc_id"), "doc_id")


def csv_union_best(spark, d):
    m = _metrics(spark, d).withColumn("row_no", F.col("no").cast("long"))
    parts = [m.filter("no < 2").drop("mean_iou_tp"), m.filter("no >= 2")]
    return _rounded(matching.best_summary(matching.union_tables(parts)))


def fingerprint(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.fingerprint(F.col("doc_id"), F.col("lang"), F.col("n_chars")).alias("fp"))


def rle_area(spark, d):
    runs = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: (F.col("p_partkey") * i % 17).cast("long"))
    return _t(spark, d, "part").select("p_partkey", masks.run_area(runs).alias("area"))


def rle_roundtrip(spark, d):
    """Runs packed and unpacked again, with the length of the text, which SQL counts from the runs' differences."""
    runs = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: (F.col("p_partkey") * i * 31 % 1700).cast("long"))
    p = _t(spark, d, "part").select("p_partkey", masks.encode_runs(runs).alias("counts"))
    again = p.select("p_partkey", F.length("counts").alias("n_chars"), masks.decode_runs("counts").alias("runs"))
    return again.select("p_partkey", "n_chars", F.array_join(F.transform("runs", lambda r: r.cast("string")), ",").alias("runs"))


def convert_records(spark, d):
    """Records of one entry, flattened: what a converted manifest says of every box."""
    rows = _named(spark, d).select("image_id", F.struct("p", "s", "n").alias("at"), "class", F.array("x", "y", "w", "h").alias("bbox"))
    images = convert.group_annotations(stats.numbered(_images(spark, d), "image_id", "idx"), rows, spread=False)
    samples = images.withColumn("image", F.concat(F.lit("imgs/../pics/"), F.col("image_id").cast("string"), F.lit(".jpg")))
    labels = [(r["label_name"], r["label_id"]) for r in _nation_labels(spark, d).collect()]  # 25 rows
    entry = {"entry_id": "cfg_a", "config_dir": "/data/cfg", "config_path": "/data/cfg/a.yaml", "dataset": "CocoWasteDataset", "global_root": "/data/sets"}
    made = records.entry_records(samples, entry, labels, common_folder="/data/common")
    a = F.explode_outer(F.col("assets")[0]["annotations"]).alias("a")
    flat = made.select("line_no", "sample_id", F.col("assets")[0]["uri"].alias("uri"), "invalid", a)
    return flat.select(
        "line_no", "sample_id", "uri", "invalid", "a.instance_id", "a.label_id", "a.label_name", F.col("a.bbox.tl.x").alias("x1"), F.col("a.bbox.tl.y").alias("y1"),
        F.col("a.bbox.br.x").alias("x2"), F.col("a.bbox.br.y").alias("y2"), F.col("a.points")[0]["x"].alias("cx"), F.col("a.points")[0]["y"].alias("cy"))


def task_match(spark, d):
    samples = _t(spark, d, "documents").select(F.col("doc_id").alias("line_no"), F.col("doc_id").cast("string").alias("sample_id"), F.format_string("imgs/doc_%05d.jpg", "doc_id").alias("uri"))
    k = F.col("page_id")
    name = F.format_string("doc_%05d.jpg", "page_id")
    path = (
        F.when(k % 6 == 0, "x/none.png").when(k % 6 == 1, F.concat(F.lit("x/"), name)).when(k % 6 == 2, F.concat(F.lit("x/4f2-"), name))
        .when(k % 6 == 3, F.format_string("x/doc_%04d", (k / 10).cast("long"))).when(k % 6 == 4, F.lit("x/zz")))
    key = F.when(k % 6 == 0, k.cast("string"))
    return sync.match_tasks(_t(spark, d, "pages").select(k.alias("task_no"), key.alias("key"), path.alias("path")), samples)


def _hand_packed_brush() -> list[int]:
    """A brush of 40 x 20 pixels in blocks of another kind than the library writes: row 2 has alpha at columns 5 and 7."""
    def block(run: int, length: int, *values: int) -> str:
        return f"{run}11{length - 1:016b}" + "".join(f"{v:08b}" for v in values)

    bits = f"{3200:032b}" + "00111" + "0010" + "0011" + "0111" + "1111"
    bits += block(1, 340, 0) + block(0, 16, 9, 9, 9, 255, 1, 1, 1, 0, 0, 0, 0, 1, 7, 7, 7, 0) + block(1, 2844, 0)
    bits += "0" * (-len(bits) % 8)
    return [int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)]


def _reviews(spark, d):
    """A tool's results: per part a rectangle, a polygon with a key point, a polygon that overrides a rectangle, an unlabelled
    one, one without id, a triangle and a brush. Even parts know their size, 40 x 20; of odd ones the tool does."""
    k = F.col("p_partkey")
    x, y = k % 10 * 5, k % 7 * 10
    num = lambda c: c.cast("double")
    corner = lambda a, b: F.array(num(a), num(b))
    square = F.array(corner(x, y), corner(x + 20, y), corner(x + 20, y + 30), corner(x, y + 30))
    none = F.lit(None)

    def region(i, label, key, points=none, rect=None, point=None, brush=none):
        x0, y0 = rect[:2] if rect else point or (none, none)
        w, h = rect[2:] if rect else (none, none)
        value = F.struct(
            brush.cast("array<int>").alias("rle"), points.cast("array<array<double>>").alias("points"), num(x0).alias("x"), num(y0).alias("y"), num(w).alias("width"), num(h).alias("height"),
            *[(F.array(F.lit(label)) if n == key and label else none.cast("array<string>")).alias(n) for n in sync.LABEL_KEYS])
        return F.struct(F.lit(i).cast("string").alias("id"), F.when(k % 2 == 1, 40).otherwise(7).alias("original_width"), F.when(k % 2 == 1, 20).otherwise(9).alias("original_height"), value.alias("value"))

    results = F.array(
        region("r", "box", "rectanglelabels", rect=(x, y, x + 7, y + 3)), region("p", "poly", "polygonlabels", square), region("p", None, "keypointlabels", point=(x, y)),
        region("o", "both", "rectanglelabels", rect=(F.lit(0), F.lit(0), F.lit(100), F.lit(100))), region("o", "mask", "polygonlabels", square),
        region(None, None, "labels", rect=(x, y, x, y)), region(None, "late", "labels", rect=(F.lit(10), F.lit(10), F.lit(50), F.lit(50))),
        region("t", "corner", "polygonlabels", F.array(corner(F.lit(0), F.lit(0)), corner(F.lit(25), F.lit(0)), corner(F.lit(0), F.lit(50)))), region("b", "brushed", "brushlabels", brush=F.array(*map(F.lit, _hand_packed_brush()))))
    size = lambda n: F.when(k % 2 == 0, n).otherwise(0)
    return _t(spark, d, "part").select(k.alias("line_no"), size(40).alias("width"), size(20).alias("height"), F.posexplode(results).alias("pos", "r"))


def reviewed_instances(spark, d):
    done = sync.reviewed_instances(_reviews(spark, d))
    return done.select("line_no", "instance_id", "label", "box.*", F.round("point.x", 6).alias("px"), F.round("point.y", 6).alias("py"), F.col("area").cast("long").alias("area"), F.col("mask").isNotNull().alias("has_mask"))


def synced_records(spark, d):
    """Records that a review leaves: two regions in three of four samples, an emptied one, and every seventh that no task knows."""
    k = F.col("p_partkey")
    text = lambda c: F.lit(c).cast("string")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(None).cast("boolean").alias("is_positive"))
    old = F.struct(
        F.concat(F.lit("old_"), k.cast("string")).alias("instance_id"), F.lit(1).cast("bigint").alias("label_id"), text("box").alias("label_name"), F.struct(point(k % 9, k % 7).alias("tl"), point(k % 9 + 3, k % 7 + 2).alias("br"), text("xyxy").alias("format")).alias("bbox"),
        F.lit(None).cast("array<struct<x:double,y:double,is_positive:boolean>>").alias("points"), F.lit(None).cast("struct<counts:variant,size:array<int>>").alias("mask"), text(None).alias("caption"), F.lit(None).cast("map<string,string>").alias("attributes"))
    asset = F.struct(
        text("image").alias("type"), F.concat(F.lit("im/"), k.cast("string"), F.lit(".png")).alias("uri"), text(None).alias("caption"), F.array(old).alias("annotations"),
        F.when(k % 3 == 0, F.parse_json(F.concat(F.lit('{"mask_source":"none","part":'), k.cast("string"), F.lit("}")))).alias("metadata"), F.when(k % 2 == 0, F.array(F.lit(40), F.lit(20))).alias("size"), text(None).alias("camera_id"))
    part = _t(spark, d, "part")
    samples = part.select(k.cast("long").alias("line_no"), text("si_simple_data").alias("sample_type"), k.cast("string").alias("sample_id"), F.array(asset).alias("assets"))
    regions = _reviews(spark, d).filter("r.id = 'o' or r.id = 'r'").groupBy("line_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "r"))), lambda x: x["r"]).alias("result"))
    data = F.struct(F.concat(F.lit("up/"), k.cast("string"), F.lit(".png")).alias("image"), text(None).alias("img"), text(None).alias("uri"), F.when(k % 5 == 0, k.cast("string")).alias("sample_id"), text(None).alias("id"))
    done = F.when(k % 4 == 0, F.array().cast("array<struct<result:array<" + sync.REGION + ">>>")).otherwise(F.array(F.struct(F.col("result").cast("array<" + sync.REGION + ">").alias("result"))))
    tasks = part.filter(k % 7 > 0).join(sync.shuffled(regions), k == F.col("line_no")).select(k.alias("task_no"), F.struct(k.cast("bigint").alias("id"), data.alias("data"), done.alias("annotations")).alias("task"))
    labels = spark.createDataFrame([(1, "box", "d")], "label_id long, label_name string, description string")
    records_, _ = sync.synced_records(samples, tasks, labels)
    a = F.col("assets")[0]
    flat = records_.select("sample_id", F.array_join(F.transform(a["size"], lambda v: v.cast("string")), "x").alias("size"), F.try_variant_get(a["metadata"], "$.mask_source", "string").alias("mask_source"), F.try_variant_get(a["metadata"], "$.part", "bigint").alias("part"), F.posexplode_outer(a["annotations"]).alias("pos", "i"))
    get = lambda path, kind: F.try_variant_get("i", f"$.{path}", kind)
    return flat.select("sample_id", "size", "mask_source", "part", "pos", *[get(n, t).alias(n) for n, t in (("instance_id", "string"), ("label_id", "bigint"), ("label_name", "string"), ("mask_format", "string"), ("source", "string"))],
                       *[get(f"bbox.{c}", "bigint").alias(c.replace(".", "_")) for c in ("tl.x", "tl.y", "br.x", "br.y")], F.round(get("center_point.x", "double"), 6).alias("px"), F.round(get("center_point.y", "double"), 6).alias("py"))


def coco_records(spark, d):
    """Records of COCO images with sequential ids: images without a valid selected box are not written, nor counted."""
    rows = _raw_boxes(spark, d).select("image_id", F.struct("p", "s", "n").alias("at"), F.col("category_id").cast("bigint").alias("category_id"), F.array("x", "y", "w", "h").alias("bbox"), F.concat_ws("-", "p", "n").alias("annotation_id"))
    images = convert.group_annotations(stats.numbered(_images(spark, d), "image_id", "pos"), rows, spread=False).withColumn("image", F.concat(F.lit("a/"), F.col("image_id").cast("string"), F.lit(".jpg")))
    made = records.coco_records(images, [(3, "three"), (5, "five")], "train", "c.json", drop_empty=True, id_strategy="sequential", id_prefix="t-")
    flat = made.select("sample_id", "invalid", F.col("assets")[0]["metadata"]["coco_image_id"].alias("image_id"), F.explode(F.col("assets")[0]["annotations"]).alias("a"))
    return flat.select("sample_id", "image_id", "invalid", "a.instance_id", "a.label_id", "a.label_name", F.col("a.bbox.tl.x").alias("x1"), F.col("a.bbox.br.y").alias("y2"))


def coco_export(spark, d):
    b = F.struct(*[F.col(c).cast("long").alias(c) for c in BOX]).alias("box")
    rows = boxes(spark, d).select(F.col("sample_id").alias("image_id"), F.struct("side", "idx").alias("at"), (F.ascii("label") % 5).alias("label_id"), F.when(F.col("l_linenumber") < 5, b).alias("box"), F.lit(None).cast("long").alias("area"))
    images = _t(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 8).alias("image_id")).distinct()
    samples = convert.group_annotations(images, rows).select(
        F.col("image_id").alias("line_no"), F.when(F.col("image_id") % 7 > 0, F.concat(F.lit("i/"), F.col("image_id").cast("string"))).alias("uri"), F.lit(160).alias("width"), F.lit(160).alias("height"), "annotations")
    labels = _t(spark, d, "region").select(F.col("r_regionkey").alias("label_id"), F.col("r_name").alias("label_name"))
    images, annots, cats = sync.coco_tables(samples, labels)
    named = annots.join(images, "image_id").join(cats.select(F.col("id").alias("category_id"), "name"), "category_id")
    return named.select("id", "image_id", "file_name", "name", *[F.col("bbox")[i].alias(c) for i, c in enumerate(("x", "y", "w", "h"))], "area", "iscrowd")


def parse_json(spark, d):
    """Answers as lists of objects or of 5-tuples, in JSON or as Python writes them, some broken, some with a bad item."""
    norm = lambda c: G.half_even(G.normalize(F.col(c), 160))
    four = F.array(*[norm(c) for c in BOX])
    item = F.when(F.col("idx") % 2 == 0, F.to_json(F.struct(F.col("label").alias("class"), four.alias("box")))).otherwise(
        F.concat(F.lit('["'), "label", F.lit('", '), F.array_join(F.transform(four, lambda v: v.cast("string")), ", "), F.lit("]")))
    rows = boxes(spark, d).filter("side = 1").withColumn("item", item)
    t = rows.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "item"))), lambda s: s["item"]), ", ").alias("t"))
    k = F.col("sample_id")
    answer = F.when(k % 17 == 0, "none to see").when(k % 13 == 0, "[]").when(k % 11 == 0, F.concat(F.lit("Here: ["), "t", F.lit("] done"))).when(k % 7 == 0, F.concat(F.lit("[{'class': None}, "), F.translate("t", '"[]', "'()"), F.lit(",]"))).when(
        k % 5 == 0, F.concat(F.lit("[['x', '1', 0x2, 3, 'y'], "), "t", F.lit("]"))).otherwise(F.concat(F.lit("["), "t", F.lit("]")))
    p = parsing.parse_answers(t.select("sample_id", answer.alias("answer"), F.lit(160).alias("width"), F.lit(160).alias("height")), "answer", "json_bbox_list")
    total = F.aggregate("parsed.annotations", F.lit(0).cast("long"), lambda a, x: a + x["bbox"]["x1"] + x["bbox"]["y1"] + x["bbox"]["x2"] + x["bbox"]["y2"])
    return p.select("sample_id", "parsed.valid", "parsed.is_empty", F.size("parsed.annotations").alias("n_items"), F.size("parsed.errors").alias("n_errors"), total.alias("corner_sum"))


def label_xml(spark, d):
    labels = F.array_sort(F.collect_list(F.struct(F.col("r_regionkey").alias("label_id"), F.col("r_name").alias("label_name"))))
    return _t(spark, d, "region").agg(X.label_config(labels).alias("xml"))


def variant_metadata(spark, d):
    v = F.try_parse_json("props")
    rows = _t(spark, d, "events").select("event_type", F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("is_object"), F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.none", "string").alias("none"))
    return rows.groupBy("event_type", "is_object").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"), F.count("none").alias("none"))


def unit_boxes(spark, d):
    """Extents and corners in 0..1 to four places of boxes as they come, outside of the image too."""
    r = _raw_boxes(spark, d)
    u = G.unit_xyxy(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    far, low = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    return r.select("image_id", "p", "s", "n", u.alias("u"), F.round(G.width(F.col("x"), far), 6).alias("across"), F.round(G.area(F.col("x"), F.col("y"), far, low), 4).alias("area")).select("image_id", "p", "s", "n", "u.*", "across", "area")


def prompt_boxes(spark, d):
    r = _raw_boxes(spark, d)
    box = F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    return r.withColumn("b", G.prompt_box(box, F.col("width"), F.col("height"))).select("image_id", "p", "s", "n", "b.*")


def image_places(spark, d):
    """Where a record's image is found and what the review tool is given for it: remote, absolute and relative names."""
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.when(F.col("p_partkey") % 3 == 0, F.lit("/d/im/")).otherwise(""), "p_name", F.lit(" *é~(1)/"), "p_brand", F.lit(".v2.jpg")).alias("image"))
    pages = _t(spark, d, "pages").filter("url is not null").select((-1 - F.col("page_id")).alias("k"), F.col("url").alias("image"))
    i = F.col("image")
    local = ~i.rlike(X.REMOTE)
    return parts.unionByName(pages).select(
        "k", X.resolve_uri(i, "/data/set").alias("place"), F.when(local, X.task_image_url(X.relative_uri(X.resolve_uri(i, "/d/im"), "/d/im"))).alias("task_url"),
        X.file_stem(i).alias("stem"), X.basename(i).alias("name"))


def attribute_texts(spark, d):
    """Attributes of every kind as a COCO document keeps them."""
    e, kind = _t(spark, d, "events"), F.col("event_id") % 6
    value = (
        F.when(kind == 0, "null").when(kind == 1, F.when(F.col("value") > 100, "true").otherwise("false")).when(kind == 2, F.get_json_object("props", "$.k"))
        .when(kind == 3, F.to_json(F.struct(F.col("event_type").alias("x")))).when(kind == 4, F.concat(F.lit('["'), "event_type", F.lit('",1]'))))
    v = F.parse_json(value)
    return e.select("event_id", X.attribute_text(F.when(kind == 3, F.variant_get(v, "$.x", "variant")).otherwise(v)).alias("text"))


def plot_series(spark, d):
    """Metrics as texts, some of them no numbers, as the plots take them."""
    li = _t(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.when(F.col("l_linenumber") == 3, F.lit("n/a")).when(F.col("l_linenumber") == 5, F.lit("NaN")).otherwise(F.col("l_discount").cast("string")).alias("threshold"),
        F.when(F.col("l_quantity").cast("long") % 7 == 0, F.lit("")).otherwise(F.col("l_tax").cast("string")).alias("f1"))
    return stats.plot_series(li, "f1")


QUERIES = {f.__name__: f for f in (
    metrics_by_threshold, summary_best_f1, iou_pairs, match_greedy, match_class_agnostic, box_status, outer_align, xywh_clip, yolo_to_xywh, normalize_text,
    denormalize_clip, sanitize_labels, label_table, label_collisions, invalid_counts, category_filter, group_annotations, label_consistency,
    clean_text, parse_tags, flatten_messages, structure_counts, numeric_stats, dataset_statistics, label_histogram, stride_sample, batches, topn_ids, split_counts,
    csv_union_best, fingerprint, rle_area, rle_roundtrip, label_xml, variant_metadata, convert_records, task_match, reviewed_instances, synced_records, coco_records, coco_export, parse_json,
    unit_boxes, prompt_boxes, image_places, attribute_texts, plot_series,
)}
