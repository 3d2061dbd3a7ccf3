"""Row types of detection manifests, and their validation as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the manifest format.
LABEL_NAME_PATTERN = "^[A-Za-z0-9_.:-]+$"
SOURCE_TYPES = ("human", "ai", "ai_human_reviewed", "synthetic", "imported", "web_scrap")
QUALITIES = ("raw", "weak", "auto", "reviewed", "good", "gold")
ANSWER_FORMATS = ("tag_bbox_list", "text")

#: Coordinates are read as double: 1.0 is an int to the format, 1.5 is not; see ``is_whole``.
POINT = "struct<x:double,y:double,is_positive:boolean>"
BBOX = f"struct<tl:{POINT},br:{POINT},format:string>"
MASK = "struct<counts:variant,size:array<int>>"
ANNOTATION = (
    f"struct<instance_id:string,label_id:bigint,label_name:string,bbox:{BBOX},points:array<{POINT}>,"
    f"mask:{MASK},caption:string,attributes:map<string,string>>"
)
ASSET = (
    f"struct<type:string,uri:string,caption:string,annotations:array<{ANNOTATION}>,metadata:variant,"
    "size:array<int>,camera_id:string>"
)
SAMPLE = f"struct<sample_type:string,sample_id:string,assets:array<{ASSET}>>"
LABEL = "struct<label_id:bigint,label_name:string,description:string,aliases:array<string>,parent_label:string>"
INFO = (
    "struct<dataset_id:string,description:string,annotation_info:struct<source_type:string,quality:string,notes:string>,"
    "domain:string,split:string,date_collected:string,date_last_update:string,label_info:map<string,"
    f"{LABEL}>,message_build_info:struct<prompt_template_version:string,answer_format:string,"
    "normalization_factor:int,metadata:variant>,metadata:variant>"
)
RECORD = f"struct<record_type:string,schema_version:string,info:{INFO},sample:{SAMPLE}>"

BOX_ROW = T.StructType([
    T.StructField("sample_id", T.StringType()), T.StructField("label_name", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")],
])


def is_whole(c: Column) -> Column:
    return c == F.rint(c)


def bbox_problem(b: Column) -> Column:
    """Why a box is refused, or null: whole coordinates, format xyxy, corners in order."""
    points = [b["tl"]["x"], b["tl"]["y"], b["br"]["x"], b["br"]["y"]]
    whole = is_whole(points[0]) & is_whole(points[1]) & is_whole(points[2]) & is_whole(points[3])
    return (
        F.when(b.isNull(), None)
        .when(~F.coalesce(whole, F.lit(False)), "bbox coordinates must be integers")
        .when(F.coalesce(b["format"], F.lit("xyxy")) != "xyxy", "bbox format must be xyxy")
        .when(~((b["tl"]["x"] < b["br"]["x"]) & (b["tl"]["y"] < b["br"]["y"])), "bbox corners out of order")
    )


def sample_problem(s: Column) -> Column:
    """Why a sample is refused, or null: type, one asset, positive size, boxes."""
    asset = F.try_element_at(s["assets"], F.lit(1))
    boxes = F.filter(F.transform(F.coalesce(asset["annotations"], F.array()), lambda a: bbox_problem(a["bbox"])), lambda p: p.isNotNull())
    size = asset["size"]
    return (
        F.when(s.isNull(), "sample is missing")
        .when(~F.coalesce(s["sample_type"] == "si_simple_data", F.lit(False)), "unknown sample_type")
        .when(s["sample_id"].isNull(), "sample_id is missing")
        .when(F.coalesce(F.size(s["assets"]), F.lit(0)) != 1, "exactly one asset is required")
        .when(~F.coalesce((F.size(size) == 2) & (F.get(size, F.lit(0)) > 0) & (F.get(size, F.lit(1)) > 0), F.lit(False)), "size must be two positive integers")
        .otherwise(F.try_element_at(boxes, F.lit(1)))
    )


def info_problems(info: Column) -> Column:
    """array<string> of what breaks the header's contract."""
    labels = F.map_entries(info["label_info"])
    a = info["annotation_info"]
    found = F.array(
        F.when(info["dataset_id"].isNull(), "dataset_id is missing"),
        F.when(~F.coalesce(a["source_type"], F.lit("imported")).isin(*SOURCE_TYPES), "unknown source_type"),
        F.when(~F.coalesce(a["quality"], F.lit("raw")).isin(*QUALITIES), "unknown quality"),
        F.when(~F.coalesce(info["message_build_info"]["answer_format"], F.lit("tag_bbox_list")).isin(*ANSWER_FORMATS), "unknown answer_format"),
        F.when(F.exists(labels, lambda e: e["key"] != e["value"]["label_name"]), "label_info key differs from label_name"),
        F.when(F.exists(labels, lambda e: ~e["value"]["label_name"].rlike(LABEL_NAME_PATTERN)), "label_name has characters that are not allowed"),
    )
    return F.filter(found, lambda p: p.isNotNull())
