"""Detection data in other formats: COCO JSON, YOLO text, class and run configurations, metric tables."""

from __future__ import annotations

import glob
import os
import re
import warnings
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxloom.errors import DatasetBuildError
from boxloom.functions.geometry import yolo_to_xywh
from boxloom.functions.text import file_stem
from boxloom.sources.split_json import objects

IMAGE = "id string, width int, height int, file_name string, filename string"
ANNOTATION = "id string, image_id string, category_id bigint, bbox array<double>"
CATEGORY = "id bigint, name string"
#: Image endings that are read, in either case (fixed values).
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "bmp", "tiff")


def read_coco(spark: SparkSession, path: str, img_root: str | None = None) -> DataFrame:
    """One row an image: image_id, pos, image, width, height, annotations in file order with their class names.

    Images without annotations keep an empty array; annotations of no image go; an unknown category
    gives a null class. A document is read by all cores (see split_json), in three scans: for its structure, for
    its categories, and for images and annotations, which meet in one shuffle.
    """
    read = lambda wanted, kind: wanted.select("path", "name", "no", F.from_json("value", kind).alias("o"))
    names = read(objects(spark, path, ("categories",)), CATEGORY).groupBy("path", F.col("o.id").alias("category_id")).agg(F.min_by("o.name", "no").alias("class"))
    both = read(objects(spark, path, ("images", "annotations")), f"{IMAGE}, {ANNOTATION.partition(', ')[2]}")
    is_image = F.col("name") == "images"
    keyed = both.select("path", "no", is_image.alias("is_image"), F.when(is_image, F.col("o.id")).otherwise(F.col("o.image_id")).alias("image_id"), F.when(~is_image, F.col("o.category_id")).alias("category_id"), "o").join(names, ["path", "category_id"], "left")
    file = F.coalesce("o.file_name", "o.filename")
    image = F.concat(F.lit(img_root.rstrip("/") + "/"), file) if img_root else file
    seen = F.collect_list(F.when(F.col("is_image"), F.struct(F.col("no").cast("int").alias("pos"), image.alias("image"), F.col("o.width").alias("width"), F.col("o.height").alias("height"))))
    boxes = F.array_sort(F.collect_list(F.when(~F.col("is_image"), F.struct(F.col("no").alias("at"), "class", "category_id", F.col("o.bbox").alias("bbox"), F.col("o.id").alias("annotation_id")))))
    grouped = keyed.filter("image_id is not null or is_image").groupBy("path", "image_id").agg(seen.alias("i"), boxes.alias("annotations"))
    return grouped.select("image_id", F.explode("i").alias("i"), F.when(F.col("image_id").isNotNull(), F.col("annotations")).otherwise(F.slice("annotations", 1, 0)).alias("annotations")).select("image_id", "i.pos", "i.image", "i.width", "i.height", "annotations")


def _jpeg_size(read) -> tuple[int, int] | None:
    """Width and height from the first frame header of a JPEG; other segments are skipped, however long."""
    at = 2
    while True:
        head = read(at, 9)
        if len(head) < 9 or head[0] != 0xFF:
            return None
        kind = head[1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(head[7:9], "big"), int.from_bytes(head[5:7], "big")
        at += 2 if kind in (0x01, *range(0xD0, 0xD9)) else 2 + int.from_bytes(head[2:4], "big")


def _tiff_size(read) -> tuple[int, int] | None:
    """Width and height from the tags of a TIFF's first directory, wherever it is."""
    order = "little" if read(0, 2) == b"II" else "big"
    number = lambda data, a, n: int.from_bytes(data[a : a + n], order)
    first, found = number(read(4, 4), 0, 4), {}
    entries = read(first + 2, 12 * number(read(first, 2), 0, 2))
    for at in range(0, len(entries) - 11, 12):
        found[number(entries, at, 2)] = number(entries, at + 8, 2 if number(entries, at + 2, 2) == 3 else 4)
    return (found[256], found[257]) if {256, 257} <= set(found) else None


def size_of_image(read) -> tuple[int, int] | None:
    """(width, height) of a PNG, BMP, JPEG or TIFF from a few short reads, read(at, n); None for anything else."""
    try:
        head = read(0, 26)
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            found = int.from_bytes(head[16:20], "big"), int.from_bytes(head[20:24], "big")
        elif head[:2] == b"BM":
            found = int.from_bytes(head[18:22], "little", signed=True), abs(int.from_bytes(head[22:26], "little", signed=True))
        elif head[:2] == b"\xff\xd8":
            found = _jpeg_size(read)
        elif head[:4] in (b"II*\x00", b"MM\x00*"):
            found = _tiff_size(read)
        else:
            found = None
    except (IndexError, ValueError):
        return None
    return found if found and min(found) > 0 else None


_SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def _opened(path: str):
    """(file system, path in it) of a path as Spark gives it; raises for stores that only Spark reads."""
    return FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def _sizes(rows: list) -> pd.DataFrame:
    return pd.DataFrame([r or (None, None) for r in rows], columns=["width", "height"], dtype="Int32")


@F.pandas_udf(_SIZE)
def _sizes_of_files(paths: pd.Series) -> pd.DataFrame:
    def size(path: str):
        try:
            store, name = _opened(path)
            with store.open_input_file(name) as f:
                return size_of_image(lambda at, n: f.read_at(n, at) if at < f.size() else b"")
        except OSError:
            return None

    return _sizes([size(p) for p in paths])


@F.pandas_udf(_SIZE)
def _sizes_of_contents(content: pd.Series) -> pd.DataFrame:
    return _sizes([size_of_image(lambda at, n, c=bytes(c): c[at : at + n]) for c in content])


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """image, width, height of the images in a folder, by name; what cannot be read is left out.

    Of each file some short pieces are read. From a store that only Spark reads, files come whole.
    """
    files = spark.read.format("binaryFile").load(folder).filter(F.lower("path").rlike("\\.(" + "|".join(IMAGE_ENDINGS) + ")$"))
    some = files.select("path").first()
    try:
        direct = bool(some) and _opened(some["path"]) is not None
    except (ValueError, OSError):
        direct = False
    size = _sizes_of_files("path") if direct else _sizes_of_contents("content")
    sized = files.select(F.regexp_replace("path", "^file:/*", "/").alias("image"), size.alias("s"))
    return sized.filter("s.width is not null").select("image", "s.width", "s.height").orderBy("image")


def read_yolo(spark: SparkSession, images: DataFrame, labels_path: str, classes: list[str]) -> DataFrame:
    """images (image, width, height) with the boxes of the label file of the same stem.

    Lines with fewer than five parts or with a part that is no number are passed over; a class number
    out of range becomes its text; an image without a label file has no annotations.
    """
    lines = spark.read.text(labels_path, wholetext=True).select(file_stem(F.input_file_name()).alias("stem"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    parts = F.filter(F.split(F.trim("value"), "\\s+"), lambda t: t != "")
    numbers = F.transform(F.slice(parts, 2, 4), lambda t: t.try_cast("double"))
    read = lines.select("stem", "line", F.try_element_at(parts, F.lit(1)).try_cast("double").alias("no"), numbers.alias("v")).filter(
        (F.size("v") == 4) & F.col("no").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    named = F.array(*map(F.lit, classes)) if classes else F.array().cast("array<string>")
    no = F.col("no").cast("int")
    label = F.when(no >= 0, F.get(named, no))
    boxes = read.withColumn("class", F.coalesce(label, no.cast("string")))
    seen = images.filter(F.lower("image").rlike("\\.(" + "|".join(IMAGE_ENDINGS) + ")$")).withColumn("stem", file_stem(F.col("image")))
    joined = seen.join(boxes, "stem", "left")
    box = yolo_to_xywh(F.get("v", F.lit(0)), F.get("v", F.lit(1)), F.get("v", F.lit(2)), F.get("v", F.lit(3)), F.col("width"), F.col("height"))
    item = F.when(F.col("v").isNotNull(), F.struct(F.col("line").alias("at"), "class", F.array(box["x"], box["y"], box["w"], box["h"]).alias("bbox")))
    return joined.groupBy("image", "width", "height").agg(F.array_sort(F.collect_list(item)).alias("annotations")).orderBy("image")


def load_yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        root = yaml.safe_load(f)
    if not isinstance(root, dict):
        raise DatasetBuildError(f"{path}: the root must be a mapping")
    return root


def label_descriptions(root: dict) -> dict:
    """The ``labels`` mapping of a taxonomy, or its compact form without the four keys about the file."""
    if isinstance(root.get("labels"), dict):
        return root["labels"]
    return {k: v for k, v in root.items() if k not in ("taxonomy_id", "version", "description", "domain")}


def data_entries(cfg: dict, where: str = "configuration") -> list[dict]:
    """key, source and folder of every entry of data_dicts, else data_dict.

    A mapping has an entry per key; a list one per text, keyed by its stem, and one per key of a
    mapping in it; a text is the one entry "dataset". An entry is a path, or a mapping with a source.
    """
    given = cfg.get("data_dicts") or cfg.get("data_dict") or []
    if isinstance(given, str):
        pairs = [("dataset", given)]
    elif isinstance(given, dict):
        pairs = list(given.items())
    elif isinstance(given, list):
        pairs = []
        for item in given:
            if not isinstance(item, (str, dict)):
                raise DatasetBuildError(f"{where}: an entry is a path or a mapping, not {item!r}")
            pairs += [(os.path.splitext(os.path.basename(item))[0], item)] if isinstance(item, str) else list(item.items())
    else:
        raise DatasetBuildError(f"{where}: data_dicts must be a mapping, a list or a path")

    def entry(key, value) -> dict:
        if not isinstance(value, (str, dict)):
            raise DatasetBuildError(f"{where}: entry {key!r} is neither a path nor a mapping")
        value = {"path": value} if isinstance(value, str) else value
        first = lambda *names: next((str(value[n]) for n in names if value.get(n)), None)
        if (source := first("labels", "path", "p")) is None:
            raise DatasetBuildError(f"{where}: entry {key!r} names no labels, path or p")
        return {"key": str(key), "source": source, "folder": first("folder_path", "img_root", "folder")}

    return [entry(k, v) for k, v in pairs]


def entry_specs(configs: dict[str, dict], default_class: str = "CocoWasteDataset") -> list[dict]:
    """The entries of all configurations, in order; one without entries is warned about."""
    specs = []
    for name, cfg in configs.items():
        entries = data_entries(cfg, name)
        if not entries:
            warnings.warn(f"{name}: no data entries", stacklevel=2)
        specs += [{"config": name, "entry_id": f"{name}_{e['key']}", "dataset": cfg.get("dataset", default_class), "classes": cfg.get("CLASSES"), **e} for e in entries]
    return specs


def merge_options(*layers: dict | None) -> dict:
    """Later layers win where they say something; a nested ``options`` wins over its own top level."""
    out: dict = {}
    for layer in layers:
        layer = dict(layer or {})
        nested = layer.pop("options", None) or {}
        out |= {k: v for k, v in (layer | nested).items() if v is not None}
    return out


def check_options(options: dict, known: set[str], choices: dict[str, tuple] | None = None, positive: tuple[str, ...] = ()) -> None:
    if unknown := sorted(set(options) - known):
        raise DatasetBuildError(f"unknown keys: {', '.join(unknown)}")
    for k, allowed in (choices or {}).items():
        if k in options and options[k] not in allowed:
            raise DatasetBuildError(f"{k} must be one of {', '.join(map(str, allowed))}")
    for k in positive:
        if k in options and not options[k] > 0:
            raise DatasetBuildError(f"{k} must be positive")


def prediction_files(explicit: list | None = None, folders: list[str] | None = None, patterns: list[str] | str = "*.jsonl") -> list[tuple[str, str]]:
    """(name, path): given files, then every folder's matches of every pattern, sorted; a repeated path keeps its first place and its last name."""
    stem = lambda p: os.path.splitext(os.path.basename(p))[0]
    found: dict[str, tuple[str, str]] = {}
    every = [(str(e.get("name", stem(e["path"]))), e["path"]) if isinstance(e, dict) else (stem(e), e) for e in explicit or []]
    for folder in folders or []:
        for pattern in [patterns] if isinstance(patterns, str) else patterns:
            every += [(stem(p), p) for p in sorted(glob.glob(os.path.join(folder, pattern)))]
    for name, path in every:
        found[os.path.realpath(path)] = (name, path)
    return list(found.values())


def read_metric_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Metric CSVs under one another, columns united, with _source_file and row_no; model and threshold are required."""
    if not paths:
        raise DatasetBuildError("no metric tables given")
    tables = []
    for k, path in enumerate(paths):
        t = spark.read.csv(path, header=True)
        if missing := {"model", "threshold"} - set(t.columns):
            raise DatasetBuildError(f"{path}: missing {', '.join(sorted(missing))}")
        tables.append(t.withColumn("_source_file", F.lit(path)).withColumn("row_no", F.lit(k).cast("long") * (1 << 40) + F.monotonically_increasing_id()))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    if not every.filter(F.col("threshold").try_cast("double").isNull()).isEmpty():
        raise DatasetBuildError("threshold must be a number")
    text = {"model", "_source_file", "row_no"}
    return every.select(*[F.col(c) if c in text else F.col(c).try_cast("double").alias(c) for c in every.columns])


def read_tool_export(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of an annotation tool's JSON export, a list or a single object, as VARIANT rows with task_no; see sync.task_rows."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    each = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    return doc.select(F.posexplode(each).alias("task_no", "task"))


def label_map_of_xml(spark: SparkSession, xml: str) -> dict[str, int]:
    """1-based ids of the key-point labels of a tool configuration."""
    row = spark.createDataFrame([(xml,)], "x string").select(F.xpath("x", F.lit("//KeyPointLabels/Label/@value")).alias("v")).first()
    return {v: k for k, v in enumerate((v for v in row["v"] if v), 1)}


#: Readers by dataset class; see register_source.
SOURCES = {"CocoWasteDataset": read_coco, "coco": read_coco, "WarpDataset": read_yolo, "yolo": read_yolo}


def register_source(name: str, reader: Callable[[SparkSession, str, str | None], DataFrame]) -> None:
    """Makes a dataset class known to conversions: reader(spark, path, folder) gives pos, image, width, height and annotations
    (class, bbox as x, y, width, height) of every image, as read_coco does."""
    if SOURCES.setdefault(name, reader) is not reader:
        raise DatasetBuildError(f"dataset class {name!r} has a reader already")


def source_of(name: str):
    """The reader registered for a dataset class."""
    if name not in SOURCES:
        raise DatasetBuildError(f"unknown dataset class {name!r}; known: {', '.join(SOURCES)}")
    return SOURCES[name]
