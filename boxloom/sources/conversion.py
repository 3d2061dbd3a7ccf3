"""Whole conversions: from configurations to manifests, an entry each and all merged, with a summary."""

from __future__ import annotations

import datetime
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxloom.errors import DatasetBuildError
from boxloom.functions.paths import config_path, data_path
from boxloom.functions.text import classes_of, description_of
from boxloom.operators import convert, records
from boxloom.sources import detection, sinks

#: Options of a run and their defaults (fixed values of the run's format).
RUN = {
    "common_data_folder": None, "dataset_id": "merged_grounded_dataset_v1", "description": "Merged canonical dataset from dataset grounders.", "domain": None, "split": None,
    "annotation_source": "imported", "annotation_quality": "auto", "sample_type": records.SAMPLE_TYPE, "prompt_template_version": "single_image_dataset_level_prompt_generation",
    "answer_format": "tag_bbox_list", "normalization_factor": 1000, "uri_mode": "absolute", "drop_empty": False, "skip_invalid_bboxes": True, "generate_center_points": True,
    "include_instance_metadata": False, "sanitize_label_names": True,
}
#: What a converted header says of its source (fixed values).
ORIGIN = {"source_format": "grounded_dataset_samples", "schema_conversion": "grounders_to_canonical_schema_v2"}
NOTES = "Converted from detection datasets."


def run_options(options: dict | None = None) -> dict:
    """RUN with what is given over it; unknown names and values raise."""
    chosen = RUN | {k: v for k, v in (options or {}).items() if v is not None}
    detection.check_options(chosen, set(RUN), {"uri_mode": ("absolute", "relative"), "answer_format": ("tag_bbox_list",), "sample_type": (records.SAMPLE_TYPE,)}, ("normalization_factor",))
    return chosen


def read_run(path: str) -> tuple[list[str], str, dict]:
    """(configurations, output folder, options) of a run's YAML; a nested ``options`` wins, paths are seen from the file."""
    base = os.path.dirname(os.path.abspath(path))
    run = detection.merge_options(detection.load_yaml(path))
    configs = run.pop("configs", None) or run.pop("config_paths", None)
    run.pop("config_paths", None)
    out = run.pop("out_dir", None)
    if not configs or not out:
        raise DatasetBuildError(f"{path}: configs and out_dir are required")
    return [config_path(p, base) for p in configs], config_path(out, base), run_options(run)


def read_entries(config_paths: list[str]) -> list[dict]:
    """entry_id, dataset, source, folder, global_root, classes, config_path and config_dir of every entry, in order."""
    found = []
    for path in map(os.path.abspath, config_paths):
        cfg, name = detection.load_yaml(path), os.path.splitext(os.path.basename(path))[0]
        for e in detection.entry_specs({name: cfg}):
            root = cfg.get("GLOBAL_ROOT")
            found.append(e | {
                "dataset": str(cfg.get("dataset") or e["dataset"]), "classes": classes_of(cfg.get("CLASSES")), "config_path": path, "config_dir": os.path.dirname(path),
                "global_root": None if root is None else str(root), "folder_path": e["folder"]})
    return found


def entry_samples(spark: SparkSession, entry: dict) -> DataFrame:
    """idx from 0, image, width, height, annotations (class, bbox, ...) of an entry, in its source's order.

    A reader that was registered for a class of its own is called with the session, the source's path and the entry's folder, as read_coco is.
    """
    source = data_path(entry["source"], entry["config_dir"])
    reader = detection.source_of(entry["dataset"])
    if reader is not detection.read_yolo:
        rows = reader(spark, source, entry["folder"])
        if missing := {"pos", "image", "width", "height", "annotations"} - set(rows.columns):
            raise DatasetBuildError(f"{entry['entry_id']}: the reader of {entry['dataset']} gives no {', '.join(sorted(missing))}")
        return rows.withColumn("idx", F.col("pos").cast("long"))
    root = data_path(entry["global_root"], entry["config_dir"])
    folder = os.path.join(root, entry["folder"]) if root and entry["folder"] else data_path(entry["folder"], entry["config_dir"]) or root
    if not folder:
        raise DatasetBuildError(f"{entry['entry_id']}: neither folder nor GLOBAL_ROOT says where the images are")
    listed = detection.list_images(spark, folder)
    numbers = listed.select("image", (F.row_number().over(Window.orderBy("image")) - 1).cast("long").alias("idx"))  # the names of a listing, which the driver made
    boxes = detection.read_yolo(spark, listed, source, list(entry["classes"]))
    base = folder.rstrip("/") + "/"
    return boxes.join(numbers, "image").withColumn("image", F.concat(F.lit(entry["folder"].rstrip("/") + "/" if entry["folder"] else ""), F.substring("image", F.lit(len(base) + 1), F.length("image"))) if entry["folder"] else F.col("image"))


def convert_entries(spark: SparkSession, entries: list[dict], out_dir: str, options: dict | None = None) -> dict:
    """Writes <entry>.canonical.jsonl and merged.canonical.jsonl under out_dir; returns the summary of the run.

    The label table is that of all entries: declared classes first, then classes as they are seen. An entry's header
    has the labels it declares or uses. Samples are numbered before empty ones are dropped.
    """
    o = run_options(options)
    if not entries:
        raise DatasetBuildError("no dataset entries found")
    if len({e["entry_id"] for e in entries}) < len(entries):
        raise DatasetBuildError("entries share an id")
    samples = {e["entry_id"]: entry_samples(spark, e) for e in entries}
    declared = [(c, description_of(d), k) for k, (c, d) in enumerate((c, d) for e in entries for c, d in e["classes"].items())]
    seen = None
    for k, e in enumerate(entries):
        each = samples[e["entry_id"]].select("idx", F.posexplode("annotations").alias("at", "a"))
        rows = each.groupBy(F.col("a.class").alias("label")).agg(F.min(F.struct("idx", "at")).alias("first")).select("label", F.lit(k).alias("k"), "first")
        seen = rows if seen is None else seen.unionByName(rows)
    order = Window.orderBy("k", "first")  # a row an entry and class
    seen = seen.select("label", F.row_number().over(order).alias("ord"))
    table = convert.label_table(spark.createDataFrame(declared, "label string, description string, ord long"), seen, o["sanitize_label_names"])
    labels = [r.asDict() for r in table.orderBy("label_id").collect()]
    ids = [(x["label_name"], x["label_id"]) for x in labels]
    clean = dict(spark.createDataFrame([(c,) for c in {c for c, _, _ in declared}], "c string").select("c", convert.sanitize_label(F.col("c"))).collect()) if declared and o["sanitize_label_names"] else {c: c for c, _, _ in declared}

    now = datetime.datetime.now().isoformat(timespec="seconds")
    common = {"uri_mode": o["uri_mode"], "common_data_folder": o["common_data_folder"]}
    told = lambda es: ORIGIN | common | {"entries": [{n: e[k] for n, k in (("entry_id", "entry_id"), ("dataset_class", "dataset"), ("source_path", "source"), ("folder_path", "folder"), ("global_root", "global_root"), ("config_path", "config_path"))} for e in es]}
    made, headers, written, invalid = {}, {}, 0, 0
    for e in entries:
        name = e["entry_id"]
        build = lambda drop: records.entry_records(
            samples[name], e, ids, o["skip_invalid_bboxes"], o["generate_center_points"], drop, o["sanitize_label_names"], o["include_instance_metadata"], o["uri_mode"], o["common_data_folder"])  # noqa: B023
        made[name] = build(o["drop_empty"])
        own = F.transform(F.col("assets")[0]["annotations"], lambda a: a["label_name"])
        all_ = build(False)
        counts = all_.agg(F.sum("invalid").alias("invalid"), F.count_if((F.size(own) > 0) | F.lit(not o["drop_empty"])).alias("written"), F.array_distinct(F.flatten(F.collect_set(F.array_distinct(own)))).alias("used")).first()
        written, invalid = written + counts["written"], invalid + (counts["invalid"] or 0)
        only = {clean[c] for c in e["classes"]} | set(counts["used"])
        headers[name] = records.dataset_header(f"{o['dataset_id']}_{name}", labels, o, NOTES, told([e]), only, now)
    merged = records.dataset_header(o["dataset_id"], labels, o, NOTES, told(entries), None, now)
    sinks.write_conversion(headers, merged, made, out_dir)
    return {
        "output_dir": out_dir, "merged_output": f"{out_dir}/merged.canonical.jsonl", "per_entry_outputs": [f"{out_dir}/{n}.canonical.jsonl" for n in made], "num_entries": len(entries),
        "num_samples_written": written, "num_invalid_annotations_skipped": invalid, "num_labels": len(labels), "labels": dict(ids)}


def convert_configs(spark: SparkSession, config_paths: list[str], out_dir: str, options: dict | None = None) -> dict:
    return convert_entries(spark, read_entries(config_paths), out_dir, options)


def convert_run(spark: SparkSession, path: str) -> dict:
    """The run that a YAML file describes."""
    configs, out_dir, options = read_run(path)
    return convert_configs(spark, configs, out_dir, options)
