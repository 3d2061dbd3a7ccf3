"""Manifest records and headers from detection data, and prediction records from answers."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.errors import DatasetBuildError
from boxloom.functions import geometry as G
from boxloom.functions.paths import image_uri
from boxloom.functions.text import description_of, file_stem, sanitize_label, sequential_id
from boxloom.operators.stats import numbered

#: What a header states unless it is told otherwise; readers take any text.
SCHEMA_VERSION = "data_schema.v2"
#: Fixed values of the manifest format.
SAMPLE_TYPE = "si_simple_data"
ID_STRATEGIES = ("image_id", "sequential", "file_stem")
#: Defaults of a conversion's header (fixed values).
DEFAULTS = {
    "description": "", "domain": None, "split": None, "annotation_source": "imported", "annotation_quality": "auto",
    "prompt_template_version": "v1", "answer_format": "tag_bbox_list", "normalization_factor": 1000,
}


def _point(x: Column, y: Column, positive: Column | None = None) -> Column:
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), (positive if positive is not None else F.lit(None).cast("boolean")).alias("is_positive"))


def box_struct(box: Column) -> Column:
    return F.struct(_point(box["x1"], box["y1"]).alias("tl"), _point(box["x2"], box["y2"]).alias("br"), F.lit("xyxy").alias("format"))


def _instance(instance_id: Column, label_id: Column, label: Column, box: Column, centre: bool, attributes: Column | None = None) -> Column:
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    middle = G.center(box)
    points = F.array(_point(middle["x"], middle["y"], middle["is_positive"])) if centre else F.lit(None).cast("array<struct<x:bigint,y:bigint,is_positive:boolean>>")
    return F.struct(
        instance_id.alias("instance_id"), label_id.cast("long").alias("label_id"), label.alias("label_name"), box_struct(box).alias("bbox"), points.alias("points"),
        F.lit(None).cast("struct<counts:string,size:array<int>>").alias("mask"), F.lit(None).cast("string").alias("caption"), (attributes if attributes is not None else none).alias("attributes"))


def _sample(sample_id: Column, uri: Column, width: Column, height: Column, annotations: Column, metadata: Column) -> list[Column]:
    asset = F.struct(
        F.lit("image").alias("type"), uri.alias("uri"), F.lit(None).cast("string").alias("caption"), annotations.alias("annotations"),
        metadata.alias("metadata"), F.array(width.cast("int"), height.cast("int")).alias("size"), F.lit(None).cast("string").alias("camera_id"))
    return [F.lit(SAMPLE_TYPE).alias("sample_type"), sample_id.alias("sample_id"), F.array(asset).alias("assets")]


def _ids_of(labels: list[tuple[str, int]]) -> Column:
    return F.create_map(*[F.lit(x) for pair in labels for x in pair]) if labels else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))


def _xyxy(a: Column, width: Column, height: Column) -> Column:
    b = lambda k: F.get(a["bbox"], F.lit(k))
    return F.when(F.size(a["bbox"]) == 4, G.xywh_to_xyxy(b(0), b(1), b(2), b(3), width, height))


def entry_records(
    samples: DataFrame, entry: dict, labels: list[tuple[str, int]], skip_invalid: bool = True, centre_points: bool = True, drop_empty: bool = False,
    sanitize: bool = True, instance_metadata: bool = False, uri_mode: str = "relative", common_folder: str | None = None,
) -> DataFrame:
    """Records of one entry: line_no, sample_type, sample_id, assets, and invalid, the number of boxes left out.

    samples (idx from 0, image, width, height, annotations: array of struct(class, bbox, ...)). Sample
    ids count source samples from 1, dropped ones too, and instance ids all source annotations from 0. A null class
    or box is left out whatever the options; a label the table lacks raises. entry: entry_id,
    config_dir, config_path, dataset, global_root, folder.
    """
    w, h, ids = F.col("width"), F.col("height"), _ids_of(labels)
    name = sanitize_label if sanitize else (lambda c: c)
    known = lambda b: F.coalesce(F.element_at(ids, b["name"]), F.raise_error(F.concat(F.lit("label is not in the table: "), b["raw"])).cast("bigint"))
    refuse = F.raise_error(F.concat(F.lit("invalid box in "), F.col("image"))).cast("boolean")

    def read(a: Column, i: Column) -> Column:
        """What an instance is built from, each part worked out once."""
        label = F.when(a["class"].isNotNull(), name(a["class"]))
        return F.struct(i.alias("i"), a["class"].alias("raw"), label.alias("name"), a["bbox"].alias("bbox"), _xyxy(a, w, h).alias("box"))

    def made(b: Column) -> Column:
        valid = F.when(G.is_valid(b["box"]), True).otherwise(F.lit(False) if skip_invalid else refuse)
        more = None
        if instance_metadata:
            more = F.create_map(
                F.lit("raw_label"), b["raw"], F.lit("raw_bbox_xywh"), F.to_json(b["bbox"]), F.lit("source_entry"), F.lit(entry["entry_id"]))
        one = _instance(sequential_id(b["i"], "obj_", 5), known(b), b["name"], b["box"], centre_points, more)
        return F.when(b["raw"].isNotNull() & b["bbox"].isNotNull(), F.when(valid, one))

    every = samples.withColumn("_made", F.filter(F.transform(F.transform("annotations", read), made), lambda x: x.isNotNull()))
    every = every.withColumn("invalid", (F.size("annotations") - F.size("_made")).cast("long"))
    if drop_empty:
        every = every.filter(F.size("_made") > 0)
    text = lambda k: F.lit(entry.get(k)).cast("string")
    metadata = F.struct(
        text("entry_id").alias("source_entry"), text("config_path").alias("source_config"), text("dataset").alias("dataset_class"), text("global_root").alias("global_root"),
        text("folder").alias("folder_path"), F.size("_made").alias("num_instances"), F.col("invalid").alias("num_invalid_annotations_skipped"),
        F.lit("grounder_bbox_xywh_pixel").alias("bbox_source"), F.lit("pixel_xyxy").alias("bbox_coordinate_space"))
    uri = image_uri(F.col("image"), uri_mode, entry.get("config_dir", "/"), entry.get("global_root"), common_folder)
    return every.select(F.col("idx").cast("long").alias("line_no"), *_sample(sequential_id(F.col("idx") + 1, entry["entry_id"] + "_", 6), uri, w, h, F.col("_made"), metadata), "invalid")


def coco_sample_id(strategy: str, prefix: str, image_id: Column, number: Column, file: Column) -> Column:
    """By image id, by the number among the written samples, or by the file's stem."""
    if strategy not in ID_STRATEGIES:
        raise DatasetBuildError(f"sample id strategy {strategy!r} is none of {', '.join(ID_STRATEGIES)}")
    base = {"image_id": image_id.cast("string"), "sequential": sequential_id(number), "file_stem": F.coalesce(file_stem(file), number.cast("string"))}[strategy]
    return F.concat(F.lit(prefix), base)


def coco_records(
    images: DataFrame, labels: list[tuple[int, str]], split: str | None = None, source_file: str = "", skip_invalid: bool = True, centre_points: bool = True,
    drop_empty: bool = False, id_strategy: str = "image_id", id_prefix: str = "",
) -> DataFrame:
    """Records of COCO images (pos, image_id, image, width, height, annotations: array of struct(category_id, bbox, annotation_id)).

    Label ids are the category ids, instance ids those of the annotations; only the labels given are
    selected. Sequential ids count written samples from 1; they also stand for a file without a name.
    """
    names = F.create_map(*[F.lit(x) for pair in labels for x in pair]) if labels else F.lit(None).cast("map<bigint,string>")
    w, h = F.col("width"), F.col("height")
    refuse = F.raise_error(F.concat(F.lit("invalid box in "), F.col("image"))).cast("boolean")
    chosen = F.filter("annotations", lambda a: a["category_id"].isin([k for k, _ in labels]))

    read = lambda a: F.struct(a["annotation_id"].cast("string").alias("id"), a["category_id"].alias("category"), _xyxy(a, w, h).alias("box"))

    def made(b: Column) -> Column:
        valid = F.when(G.is_valid(b["box"]), True).otherwise(F.lit(False) if skip_invalid else refuse)
        return F.when(valid, _instance(F.concat(F.lit("obj_"), F.coalesce(b["id"], F.lit("unknown"))), b["category"], F.element_at(names, b["category"]), b["box"], centre_points))

    rows = images.withColumn("_chosen", chosen)
    if drop_empty:
        rows = rows.filter(F.size("_chosen") > 0)
    rows = rows.withColumn("_made", F.filter(F.transform(F.transform("_chosen", read), made), lambda x: x.isNotNull())).withColumn("invalid", (F.size("_chosen") - F.size("_made")).cast("long"))
    if drop_empty:
        rows = rows.filter(F.size("_made") > 0)
    rows = rows.withColumn("_n", F.col("pos").cast("long")) if id_strategy == "image_id" else numbered(rows, "pos", "_n", start=1)
    metadata = F.struct(
        F.lit("COCO").alias("source_format"), F.lit(source_file).alias("source_file"), F.lit(split).cast("string").alias("split"), F.col("image_id").alias("coco_image_id"),
        F.col("image").alias("original_file_name"), F.size("_made").alias("num_instances"), F.col("invalid").alias("num_invalid_annotations_skipped"),
        F.lit("coco_bbox_xywh").alias("bbox_source"), F.lit("pixel_xyxy").alias("bbox_coordinate_space"),
        F.lit("bbox_center_generated" if centre_points else None).cast("string").alias("points_source"), F.lit(None).cast("string").alias("mask_source"))
    sample_id = coco_sample_id(id_strategy, id_prefix, F.col("image_id"), F.col("_n"), F.col("image"))
    return rows.select(F.col("pos").cast("long").alias("line_no"), *_sample(sample_id, F.col("image"), w, h, F.col("_made"), metadata), "invalid")


def label_info(labels: list[dict], require_descriptions: bool = False) -> dict[str, dict]:
    """The header's labels, in order, from label_id, label_name and what else is known of them."""
    out = {}
    for x in labels:
        text = description_of(x.get("description"))
        if require_descriptions and not text:
            raise DatasetBuildError(f"label {x['label_name']!r} needs a description")
        out[x["label_name"]] = {
            "label_id": int(x["label_id"]), "label_name": x["label_name"], "description": text, "aliases": list(x.get("aliases") or []), "parent_label": x.get("parent_label")}
    return out


def dataset_header(dataset_id: str, labels: list[dict], options: dict | None = None, notes: str = "", metadata: dict | None = None, only: set[str] | None = None, now: str | None = None, require_descriptions: bool = False, schema_version: str = SCHEMA_VERSION) -> dict:
    """A header record. only: the labels a single entry declares or uses; the ids stay those of all."""
    o = DEFAULTS | {k: v for k, v in (options or {}).items() if v is not None}
    now = now or datetime.datetime.now().isoformat(timespec="seconds")
    chosen = [x for x in labels if only is None or x["label_name"] in only]
    return {"record_type": "dataset_info", "schema_version": schema_version, "info": {
        "dataset_id": dataset_id, "description": o["description"], "annotation_info": {"source_type": o["annotation_source"], "quality": o["annotation_quality"], "notes": notes},
        "domain": o["domain"], "split": o["split"], "date_collected": None, "date_last_update": now, "label_info": label_info(chosen, require_descriptions),
        "message_build_info": {
            "prompt_template_version": o["prompt_template_version"], "answer_format": o["answer_format"], "normalization_factor": o["normalization_factor"],
            "metadata": {"sample_type": SAMPLE_TYPE, "target_encoding": o["answer_format"], "bbox_storage_coordinates": "pixel_xyxy", "bbox_message_coordinates": f"normalized_{o['normalization_factor']}"}},
        "metadata": {"date_converted": now, **(metadata or {})}}}


def prediction_header(header: dict, model_name: str | None, checkpoint: str | None, notes: str = "Model predictions.") -> dict:
    """The header of a prediction manifest: another origin, and the run it comes from."""
    info = dict(header["info"])
    run = {"source_dataset_id": info["dataset_id"], "model_name": model_name, "checkpoint_path": checkpoint}
    info |= {
        "description": f"Predictions for dataset {info['dataset_id']}", "annotation_info": {"source_type": "ai", "quality": "auto", "notes": notes},
        "metadata": {**(info.get("metadata") or {}), "prediction_run": run}}
    return {**header, "info": info}


def prediction_records(samples: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with the predicted boxes as annotations and metadata.prediction, rows of failed answers).

    samples (line_no, sample_type, sample_id, assets); parsed (sample_id, generated_text, parsed). A
    sample whose answer failed is in the second table only; one without an answer in neither.
    """
    p = F.col("parsed")
    boxes = F.transform(p["annotations"], lambda a: _instance(a["instance_id"], a["label_id"], a["label_name"], a["bbox"], False))
    debug = F.struct(p.alias("result"), F.size(p["annotations"]).alias("num_instances"))
    said = F.struct(
        F.lit("model_inference").alias("source"), F.col("generated_text").alias("generated_text"), debug.alias("parse_debug"), F.size(p["annotations"]).alias("num_predicted_instances"))
    asset = F.col("assets")[0]
    kept = [asset[c].alias(c) for c in ("type", "uri", "caption")]
    metadata = F.struct(asset["metadata"].alias("source"), said.alias("prediction"))
    new = F.array(F.struct(*kept, boxes.alias("annotations"), metadata.alias("metadata"), asset["size"].alias("size"), asset["camera_id"].alias("camera_id")))
    joined = samples.join(parsed.select("sample_id", "generated_text", "parsed"), "sample_id")
    good = joined.filter("parsed.valid").select("line_no", "sample_type", "sample_id", new.alias("assets"))
    bad = joined.filter("not parsed.valid").select("sample_id", F.array_join("parsed.errors", "; ").alias("error"), "generated_text")
    return good, bad
