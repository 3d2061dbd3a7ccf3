"""Exchange with an annotation tool: tasks out, reviewed labels in, COCO out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions import geometry as G
from boxloom.functions.text import basename, sequential_id, task_image_url
from boxloom.operators import masks as M
from boxloom.operators.stats import numbered

#: Order in which a result's label and shape are looked for (fixed values).
LABEL_KEYS = ("brushlabels", "polygonlabels", "rectanglelabels", "labels", "keypointlabels")
REGION = (
    "struct<id:string,original_width:int,original_height:int,value:struct<rle:array<int>,points:array<array<double>>,"
    "x:double,y:double,width:double,height:double," + ",".join(f"{k}:array<string>" for k in LABEL_KEYS) + ">>"
)
TASK = f"struct<id:bigint,data:struct<image:string,img:string,uri:string,sample_id:string,id:string>,annotations:array<struct<result:array<{REGION}>>>>"


#: What an imported mask result states of itself, and what a reviewed mask is marked with (fixed values of the formats).
RESULT = {"type": "brushlabels", "from_name": "mask", "to_name": "image", "image_rotation": 0, "origin": "prediction"}
MODEL_VERSION, MASK_FORMAT, REVIEWED = "sam2_rle_masks", "coco_rle", "label_studio_manual"


def mask_predictions(annotations: Column, names: Column, width: Column, height: Column) -> Column:
    """Importable results of annotations (label_name, label_id, mask: counts and size); without label or mask they are passed over.

    An empty label name is looked up by its id. Results are numbered among themselves, mask_0 on; the mask is packed as
    the tool's brush.
    """
    label = lambda a: F.coalesce(F.when(a["label_name"] != "", a["label_name"]), F.when(a["label_id"].isNotNull(), F.element_at(names, a["label_id"])))
    drawn = lambda a: (F.coalesce(a["mask"]["counts"], F.lit("")) != "") & (F.coalesce(F.size(a["mask"]["size"]), F.lit(0)) == 2)
    kept = F.filter(annotations, lambda a: (F.coalesce(label(a), F.lit("")) != "") & drawn(a))
    packed = M.brushes(F.transform(kept, lambda a: F.struct(a["mask"]["counts"].alias("counts"), a["mask"]["size"].alias("size"))))
    fixed = lambda n: F.lit(RESULT[n]).alias(n)
    result = lambda z, i: F.struct(
        F.concat(F.lit("mask_"), i.cast("string")).alias("id"), fixed("type"), fixed("from_name"), fixed("to_name"), width.cast("int").alias("original_width"),
        height.cast("int").alias("original_height"), fixed("image_rotation"), fixed("origin"),
        F.struct(F.lit("rle").alias("format"), z["rle"].alias("rle"), F.array(z["label"]).alias("brushlabels")).alias("value"))
    return F.transform(F.arrays_zip(F.transform(kept, label).alias("label"), packed.alias("rle")), result)


def tasks(samples: DataFrame, root: str, labels: list[tuple[int, str]] = ()) -> DataFrame:
    """line_no and a task's data and predictions: samples (line_no, sample_id, uri, and annotations, width, height for predictions) under root.

    Without a uri no task, without an id idx_<line_no>; predictions are null where no annotation has a mask.
    """
    base = root.rstrip("/")
    path = F.when(F.startswith("uri", F.lit("/")), F.col("uri")).otherwise(F.concat(F.lit(base + "/"), "uri"))
    relative = F.when(F.startswith(path, F.lit(base + "/")), F.substring(path, F.lit(len(base) + 2), F.length(path))).otherwise(path)
    number = F.col("line_no") if "line_no" in samples.columns else F.col("idx")
    data = F.struct(
        task_image_url(relative).alias("image"), F.coalesce("sample_id", F.concat(F.lit("idx_"), number.cast("string"))).alias("sample_id"), path.alias("storage_path"))
    out = samples.filter("uri is not null and uri <> ''").withColumn("data", data)
    if "annotations" not in samples.columns:
        return out.select(number.alias("line_no"), "data")
    names = F.create_map(*[F.lit(x) for pair in labels for x in pair]) if labels else F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<string>"))
    out = out.withColumn("result", mask_predictions(F.col("annotations"), names, F.col("width"), F.col("height")))
    predictions = F.when(F.size("result") > 0, F.array(F.struct(F.lit(MODEL_VERSION).alias("model_version"), "result")))
    return out.select(number.alias("line_no"), "data", predictions.alias("predictions"))


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input and so must not be broadcast.

    The planner takes a table's size from its compressed file and the share of the columns that are read; what is made from
    them, a task with its results from a key alone, may be thousands of times that, and all of it would pass the driver.
    """
    return side.hint("merge")


#: Lengths of grams. A name is looked up by grams of the longest of these that fits into it.
GRAMS = (8, 4, 2, 1)


def _grams(name: Column, length: int) -> Column:
    every = F.transform(F.sequence(F.lit(1), F.length(name) - (length - 1)), lambda i: F.substring(name, i, F.lit(length)))
    return F.when(F.length(name) >= length, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def contained(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(needle, hay) of distinct, not empty names where the first is part of the second.

    An inverted index: each name of hay is posted under its grams, a row a place at most for each gram length that
    some needle needs. A needle is looked up under the one of its grams that the fewest are posted under, and what
    is found there is verified; a gram that nobody has proves that there is nothing.
    """
    asked = needles.withColumn("q", F.coalesce(*[F.when(F.length("needle") >= q, q) for q in GRAMS]))
    present = sorted(r["q"] for r in asked.select("q").distinct().collect())  # GRAMS at most
    if not present:
        return needles.limit(0).select("needle", F.col("needle").alias("hay"))
    named = [F.transform(_grams(F.col("hay"), q), lambda g: F.struct(F.lit(q).alias("q"), g.alias("gram"))) for q in present]  # noqa: B023
    posted = hay.select("hay", F.explode(F.concat(*named)).alias("p")).select("hay", "p.q", "p.gram")
    many = posted.groupBy("q", "gram").agg(F.count(F.lit(1)).alias("n"))
    own = asked.select("needle", "q", F.explode(F.coalesce(*[F.when(F.col("q") == q, _grams(F.col("needle"), q)) for q in present])).alias("gram"))
    rarest = own.join(shuffled(many), ["q", "gram"], "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "q")).alias("r")).filter("r.n > 0")
    return rarest.select("needle", "r.q", "r.gram").join(shuffled(posted), ["q", "gram"]).filter(F.col("hay").contains(F.col("needle"))).select("needle", "hay")


def match_tasks(tasks_: DataFrame, samples: DataFrame) -> DataFrame:
    """task_no with the line_no of its sample: by id, else by basename, else by one basename within the other.

    tasks (task_no, key, path), samples (line_no, sample_id, uri). A task without a path never
    matches. Each tier takes the first sample in file order. Ids and basenames are looked up in one join, those that a task
    has, so that tasks without an id do not meet in one place. Only what the first two tiers leave reaches the third, which
    looks names up in an inverted index of grams, each side's names in the other's.
    """
    t = tasks_.filter("path is not null and path <> ''").withColumn("base", basename(F.col("path")))
    s = samples.withColumn("sbase", basename(F.col("uri")))
    tier = lambda k, name: F.struct(F.lit(k).alias("tier"), name.alias("name"))
    posted = s.select("line_no", F.explode(F.array(tier(0, F.col("sample_id")), tier(1, F.when(F.col("sbase") != "", F.col("sbase"))))).alias("p")).select("line_no", "p.*")
    first = posted.filter("name is not null").groupBy("tier", "name").agg(F.min("line_no").alias("line_no"))
    asked = F.filter(F.array(tier(0, F.col("key")), tier(1, F.when(F.col("base") != "", F.col("base")))), lambda x: x["name"].isNotNull())
    found = t.select("task_no", "base", F.explode_outer(asked).alias("a")).select("task_no", "base", "a.*").join(shuffled(first), ["tier", "name"], "left")
    by = lambda k: F.min(F.when(F.col("tier") == k, F.col("line_no")))
    two = found.groupBy("task_no", "base").agg(F.coalesce(by(0), by(1)).alias("line_no"))
    names = first.filter("tier = 1").select(F.col("name").alias("base"), F.col("line_no").alias("by_name"))
    left = two.filter("line_no is null and base <> ''").select("base").distinct()
    if not left.isEmpty():
        in_task = contained(names.select(F.col("base").alias("needle")), left.select(F.col("base").alias("hay"))).select(F.col("needle").alias("sbase"), F.col("hay").alias("base"))
        in_name = contained(left.select(F.col("base").alias("needle")), names.select(F.col("base").alias("hay"))).select(F.col("hay").alias("sbase"), F.col("needle").alias("base"))
        places = names.select(F.col("base").alias("sbase"), F.col("by_name").alias("by_part"))
        third = in_task.unionByName(in_name).join(shuffled(places), "sbase").groupBy("base").agg(F.min("by_part").alias("by_part"))
        two = two.join(shuffled(third), "base", "left").withColumn("line_no", F.coalesce("line_no", "by_part"))
    return two.select("task_no", "line_no").filter("line_no is not null")


def last_task_per_sample(matched: DataFrame) -> DataFrame:
    return matched.groupBy("line_no").agg(F.max("task_no").alias("task_no"))


def region_label(v: Column) -> Column:
    return F.coalesce(*[F.try_element_at(v[k], F.lit(1)) for k in LABEL_KEYS])


def region_shape(v: Column) -> Column:
    return F.when(v["rle"].isNotNull(), "rle").when(v["points"].isNotNull(), "polygon").when(v["width"].isNotNull(), "rect").when(v["x"].isNotNull(), "keypoint")


def task_rows(export: DataFrame) -> DataFrame:
    """(task_no, task: TASK) of a tool's export as read_tool_export gives it; fields the sync does not know are left out."""
    return export.select("task_no", F.from_json(F.to_json("task"), TASK).alias("task"))


def reviewed_instances(results: DataFrame) -> DataFrame:
    """results (line_no, pos, r: region) of first annotations -> one instance an id: label, shape, box, point, mask, area.

    Shapes are drawn at the sample's size, columns width and height, and where these are missing or 0 at the one that the
    tool states for the image's first result.

    Results that share an id are one instance, of which the last label and shape count; without an id
    each is its own, inst_<k>, k the number of instances before it, labelled or not. Instances without
    a label go; without a shape they keep no box. Brushes
    and polygons give the mask (packed counts and size), whose box, unless the mask is empty, overrides
    the rectangle and whose centroid is the point where there is no keypoint; area is the mask's.
    """
    v = F.col("r.value")
    stated = F.struct(F.col("r.original_width").alias("w"), F.col("r.original_height").alias("h"))
    tool = F.min_by(stated, F.when((stated["w"] > 0) & (stated["h"] > 0), F.col("pos"))).over(Window.partitionBy("line_no"))  # an image's results
    given = [F.col(c) if c in results.columns else F.lit(None).cast("int") for c in ("width", "height")]
    known = F.when((given[0] > 0) & (given[1] > 0), F.struct(given[0].cast("int").alias("w"), given[1].cast("int").alias("h")))
    results = results.withColumn("_size", F.coalesce(known, tool))
    w, h = F.col("_size.w"), F.col("_size.h")
    own = F.when(F.coalesce(F.col("r.id"), F.lit("")) != "", F.concat(F.lit("ls_"), F.col("r.id"))).otherwise(F.concat(F.lit("gen_"), F.col("pos").cast("string")))
    shape = region_shape(v)
    rect = G.percent_rect(v["x"], v["y"], v["width"], v["height"], w, h)
    point = F.when(shape == "keypoint", F.struct(G.percent_to_pixels(v["x"], w).alias("x"), G.percent_to_pixels(v["y"], h).alias("y")))
    rows = results.select("line_no", "pos", own.alias("instance_id"), region_label(v).alias("label"), shape.alias("shape"), F.when(shape == "rect", rect).alias("box"), point.alias("point"),
        F.when(v["rle"].isNotNull() | v["points"].isNotNull(), F.struct(v["rle"].alias("rle"), v["points"].alias("points"), h.alias("h"), w.alias("w"))).alias("drawn"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    one = rows.groupBy("line_no", "instance_id").agg(F.min("pos").alias("pos"), last("label"), last("shape"), last("box"), last("point"), last("drawn"))
    number = F.row_number().over(Window.partitionBy("line_no").orderBy("pos")) - 1  # one row an instance of an image
    one = one.withColumn("instance_id", F.when(F.col("instance_id").startswith("gen_"), sequential_id(number, "inst_", 4)).otherwise(F.col("instance_id"))).filter("label is not null")
    one = one.withColumn("m", M.region_masks("drawn.rle", "drawn.points", "drawn.w", "drawn.h"))  # only what an instance ends up with is drawn
    one = one.withColumn("g", F.col("m.g")).withColumn("counts", F.col("m.counts"))
    drawn = F.col("drawn").isNotNull()
    box = F.when(F.col("g.x1").isNotNull(), F.struct(*[F.col(f"g.{n}").alias(n) for n in ("x1", "y1", "x2", "y2")]))
    centre = F.when(F.col("g.cx").isNotNull(), F.struct(F.col("g.cx").alias("x"), F.col("g.cy").alias("y")))
    mask = F.when(drawn, F.struct("counts", F.array("drawn.h", "drawn.w").alias("size")))
    return one.select(
        "line_no", "instance_id", "pos", "label", "shape", F.coalesce(box, "box").alias("box"), F.coalesce("point", centre).alias("point"),
        mask.alias("mask"), F.when(drawn, F.col("g.area")).alias("area"))


def extend_labels(labels: DataFrame, instances: DataFrame) -> DataFrame:
    """labels with the new names of instances (label, line_no, pos) numbered on from the largest id, by first appearance."""
    first = instances.groupBy("label").agg(F.min(F.struct("line_no", "pos")).alias("at"))  # a row a name; instances are not moved by label
    new = first.join(labels, first.label == labels.label_name, "left_anti")
    top = labels.agg(F.coalesce(F.max("label_id"), F.lit(0)).alias("top"))
    numbered = new.withColumn("k", F.row_number().over(Window.orderBy("at")))
    added = numbered.join(F.broadcast(top), F.lit(True)).select((F.col("k") + F.col("top")).alias("label_id"), F.col("label").alias("label_name"), F.concat(F.lit("Validated class "), "label").alias("description"))
    return labels.select("label_id", "label_name", "description").unionByName(added)


def sync(samples: DataFrame, task_rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples with the column reviewed, labels): a matched task's first annotation replaces all; unmatched have null.

    samples (line_no, sample_id, uri; width and height where they are known); task_rows (task_no, task: TASK). Beside
    reviewed are the task_no, whether the task is annotated at all, and the first size that the tool states for the image.
    """
    t = task_rows.select("task_no", "task", F.coalesce("task.data.sample_id", "task.data.id").alias("key"), F.coalesce("task.data.image", "task.data.img", "task.data.uri").alias("path"))
    chosen = last_task_per_sample(match_tasks(t.select("task_no", "key", "path"), samples)).join(shuffled(t.select("task_no", "task")), "task_no")
    first = F.try_element_at(F.col("task.annotations"), F.lit(1))["result"]
    results = chosen.select("line_no", F.posexplode(F.coalesce(first, F.array())).alias("pos", "r"))
    if {"width", "height"} <= set(samples.columns):
        results = results.join(shuffled(samples.select("line_no", "width", "height")), "line_no")
    inst = reviewed_instances(results)
    table = extend_labels(labels, inst)
    named = inst.join(F.broadcast(table.select("label_id", F.col("label_name").alias("label"))), "label")  # a label table
    made = named.groupBy("line_no").agg(F.array_sort(F.collect_list(F.struct("pos", "instance_id", "label_id", F.col("label").alias("label_name"), "box", "point", "shape", "mask", "area"))).alias("reviewed"))
    sized = F.filter(F.coalesce(first, F.array()), lambda r: (r["original_width"] > 0) & (r["original_height"] > 0))
    told = chosen.select("line_no", "task_no", (F.coalesce(F.size("task.annotations"), F.lit(0)) > 0).alias("annotated"), F.try_element_at(sized, F.lit(1)).alias("_r"))
    told = told.select("line_no", "task_no", "annotated", F.when(F.col("_r").isNotNull(), F.array("_r.original_width", "_r.original_height")).alias("stated"))
    done = samples.join(shuffled(told), "line_no", "left").join(shuffled(made), "line_no", "left")
    empty = F.array().cast(dict(made.dtypes)["reviewed"])
    return done.withColumn("reviewed", F.when(F.col("task_no").isNotNull(), F.coalesce("reviewed", empty))), table


def synced_records(samples: DataFrame, task_rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sample records as a review leaves them, labels): line_no, sample_type, sample_id, assets, to be written with nulls left out.

    samples as read_samples gives them; task_rows (task_no, task: TASK). A sample's image is its first asset's uri, else
    the file name in its metadata. A matched sample's first asset gets the reviewed instances: id, label, attributes,
    bbox, mask with its format and source, center_point; metadata.mask_source says so, where the task has no annotation
    at all only if there is metadata. A size that is missing or 0 becomes the tool's. Other samples and assets stay.
    """
    asset = F.col("assets")[0]
    extent = lambda k: F.coalesce(F.get(asset["size"], F.lit(k)), F.lit(0))
    file = F.coalesce(F.when(asset["uri"] != "", asset["uri"]), F.try_variant_get(asset["metadata"], "$.original_file_name", "string"))
    flat = samples.select("line_no", "sample_id", file.alias("uri"), extent(0).alias("width"), extent(1).alias("height"))
    done, table = sync(flat, task_rows, labels)
    rows = samples.select("line_no", "sample_type", "sample_id", "assets").join(shuffled(done.select("line_no", "task_no", "reviewed", "width", "height", "annotated", "stated")), "line_no")

    as_variant = lambda c: F.parse_json(F.to_json(c))  # noqa: E731  nulls are left out
    corner = lambda b, x, y: F.struct(b[x].alias("x"), b[y].alias("y"))
    new = lambda i: F.struct(
        i["instance_id"].alias("instance_id"), i["label_id"].alias("label_id"), i["label_name"].alias("label_name"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("attributes"),
        F.when(i["box"].isNotNull(), F.struct(corner(i["box"], "x1", "y1").alias("tl"), corner(i["box"], "x2", "y2").alias("br"), F.lit("xyxy").alias("format"))).alias("bbox"),
        i["mask"].alias("mask"), F.when(i["mask"].isNotNull(), MASK_FORMAT).alias("mask_format"), F.when(i["mask"].isNotNull(), REVIEWED).alias("source"), i["point"].alias("center_point"))
    matched = F.col("task_no").isNotNull()

    def remade(a: Column, k: Column) -> Column:
        ours = matched & (k == 0)
        past = F.variant_get(a["metadata"], "$", "map<string,variant>")
        others = F.map_filter(F.coalesce(past, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))), lambda n, _: n != "mask_source")
        marked = F.parse_json(F.to_json(F.map_concat(others, F.create_map(F.lit("mask_source"), F.parse_json(F.lit(f'"{REVIEWED}"'))))))
        size = F.when(ours & F.col("annotated") & ((F.col("width") == 0) | (F.col("height") == 0)), F.coalesce("stated", a["size"])).otherwise(a["size"])
        return F.struct(
            a["type"].alias("type"), a["uri"].alias("uri"), a["caption"].alias("caption"),
            F.when(ours, F.transform("reviewed", lambda i: as_variant(new(i)))).otherwise(F.transform(a["annotations"], as_variant)).alias("annotations"),
            F.when(ours & (F.col("annotated") | a["metadata"].isNotNull()), marked).otherwise(a["metadata"]).alias("metadata"), size.alias("size"), a["camera_id"].alias("camera_id"))

    return rows.select("line_no", "sample_type", "sample_id", F.transform("assets", remade).alias("assets")), table


def reviewed_header(header: dict, table: DataFrame) -> dict:
    """The header after a review: masks announced, labels rebuilt from the table (label_id, label_name, description)."""
    info = dict(header["info"])
    old = {k: v.get("description") for k, v in (info.get("label_info") or {}).items()}
    rows = table.orderBy("label_id").collect()  # a label table
    info["label_info"] = {r["label_name"]: {
        "label_id": r["label_id"], "label_name": r["label_name"], "description": old.get(r["label_name"]) if r["label_name"] in old else r["description"],
        "aliases": [], "parent_label": "root"} for r in rows}
    return {**header, "info": info | {"has_semantic_masks": True}}


def coco_tables(samples: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) with sequential ids; samples without a uri and annotations without a box go.

    samples (line_no, uri, width, height, annotations: array of struct(label_id, box, area, and mask
    (counts, size) where they have masks), as sync's reviewed). segmentation is the mask, null without
    one. Ids count from 1 in file order; no task numbers all rows (see numbered).
    """
    boxed = F.filter("annotations", lambda a: a["box"].isNotNull())
    kept = numbered(samples.filter("uri is not null and uri <> ''").withColumn("_boxed", boxed), "line_no", "image_id", start=1)
    images = kept.select("image_id", F.col("uri").alias("file_name"), "width", "height")
    each = numbered(kept.select("image_id", F.posexplode("_boxed").alias("k", "a")), "image_id", "id", start=1, then=("k",))
    b = F.col("a.box")
    has_mask = "mask" in samples.schema["annotations"].dataType.elementType.names
    segmentation = F.col("a.mask") if has_mask else F.lit(None).cast("struct<counts:string,size:array<int>>")
    w, h = (b["x2"] - b["x1"]).cast("double"), (b["y2"] - b["y1"]).cast("double")
    annots = each.select(
        "id", "image_id", F.col("a.label_id").alias("category_id"), segmentation.alias("segmentation"),
        F.array(b["x1"].cast("double"), b["y1"].cast("double"), w, h).alias("bbox"), F.coalesce("a.area", (w * h).cast("long")).alias("area"), F.lit(0).alias("iscrowd"))
    cats = labels.select(F.col("label_id").alias("id"), F.col("label_name").alias("name"), F.lit("object").alias("supercategory"))
    return images, annots, cats


def mask_messages(annots: DataFrame) -> DataFrame:
    """Per annotation with a mask: area share in percent and what is odd (size differs, empty)."""
    area = F.col("area")
    odd = F.when((F.col("mask_h") != F.col("height")) | (F.col("mask_w") != F.col("width")), "size differs from the image").when(area == 0, "mask is empty")
    return annots.filter("area is not null").select("sample_id", "instance_id", (100.0 * area / (F.col("width") * F.col("height"))).alias("percent"), odd.alias("problem"))


def has_any_mask(annotations: Column) -> Column:
    return F.exists(annotations, lambda a: a["mask"].isNotNull())


def samples_to_show(samples: DataFrame, most: int = 0) -> DataFrame:
    """Samples with masks and a found image, the first ``most`` by line_no; all for 0."""
    shown = samples.filter(has_any_mask(F.col("annotations")) & F.col("found").isNotNull())
    return shown.orderBy("line_no").limit(most) if most else shown


def pseudo_label(samples: DataFrame, predictor, overwrite: bool = False, name: str = "sam2_box_prompt_rle") -> DataFrame:
    """samples with masks for their boxes; every sample comes back.

    samples (line_no, found, width, height, annotations: array of struct with instance_id, bbox struct
    x1..y2, mask (counts, size), source). predictor takes batches of (line_no, pos, found, width,
    height, x1, y1, x2, y2) through mapInPandas and gives (line_no, pos, height, width, runs); what it
    fails on it leaves out. A box is asked about if its image was found and it has no mask, or all with
    overwrite. A mask of another size than the image is refused. mask_source names the predictor where
    anything changed, mask_format and source say so per instance; a source that is there stays.
    """
    each = samples.filter("found is not null").select("line_no", "found", "width", "height", F.posexplode("annotations").alias("pos", "a"))
    asked = each.filter(F.col("a.bbox").isNotNull() & (F.col("a.mask").isNull() | F.lit(overwrite)))
    box = G.prompt_box(F.col("a.bbox"), F.col("width"), F.col("height"))
    prompts = asked.select("line_no", "pos", "found", "width", "height", box.alias("b")).select("line_no", "pos", "found", "width", "height", "b.*")
    schema = "line_no long, pos int, height int, width int, runs array<long>"
    made = prompts.mapInPandas(predictor, schema).withColumnRenamed("height", "mask_h").withColumnRenamed("width", "mask_w")
    sized = made.join(samples.select("line_no", "width", "height"), "line_no").filter((F.col("mask_h") == F.col("height")) & (F.col("mask_w") == F.col("width")))
    packed = sized.select("line_no", "pos", F.struct(M.encode_runs("runs").alias("counts"), F.array("mask_h", "mask_w").alias("size")).alias("mask"))
    new = packed.groupBy("line_no").agg(F.map_from_entries(F.collect_list(F.struct("pos", "mask"))).alias("new"))  # an image's boxes

    def one(a: Column, i: Column) -> Column:
        mask = F.try_element_at(F.col("new"), i)
        fields = [f for f in samples.schema["annotations"].dataType.elementType.names if f not in ("mask", "mask_format", "source")]
        return F.struct(
            *[a[f].alias(f) for f in fields], F.coalesce(mask, a["mask"]).alias("mask"), F.when(mask.isNotNull(), "coco_rle").alias("mask_format"),
            F.when(mask.isNotNull(), F.coalesce(a["source"], F.lit(name))).otherwise(a["source"]).alias("source"))

    done = samples.join(new, "line_no", "left").withColumn("annotations", F.transform("annotations", one))
    return done.withColumn("mask_source", F.when(F.col("new").isNotNull(), F.lit(name))).drop("new")
