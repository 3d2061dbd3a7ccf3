"""Manifests: JSON lines with one header record and sample records."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxloom.errors import ManifestError
from boxloom.operators.stats import numbered
from boxloom.schema import RECORD, sample_problem

#: Broken lines that are warned of.
MOST_WARNINGS = 20
MODES = ("strict", "class", "eval", "lenient")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no from 1, value) of the non-empty lines; a byte order mark is dropped.

    Files are split as any text is. Within a split the ids that Spark gives its rows are consecutive,
    so a line's number is its place in the split and the lines of the splits before it: one short row
    a split is all that is added up.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    splits = lines.groupBy("path", "block").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("many"))
    upto = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "block", "low", F.coalesce(F.sum("many").over(upto), F.lit(0)).alias("before"))
    value = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "\r$", "")
    numbered_ = lines.join(splits, ["path", "block"]).select("path", (F.col("before") + F.col("at") - F.col("low") + 1).alias("line_no"), value.alias("value"))
    return numbered_.filter(F.trim("value") != "")


def read_jsonl(spark: SparkSession, path: str, on_error: str = "raise") -> DataFrame:
    """path, line_no and record (VARIANT) of any JSON lines; on_error: raise, or skip broken lines, or warn of the first of them, too."""
    rows = numbered_lines(spark, path).select("path", "line_no", F.try_parse_json("value").alias("record"))
    if on_error == "warn":
        for r in rows.filter("record is null").orderBy("path", "line_no").limit(MOST_WARNINGS).collect():
            warnings.warn(f"line {r['line_no']} of {r['path']} is not JSON", stacklevel=2)
    if on_error in ("skip", "warn"):
        return rows.filter("record is not null")
    if on_error != "raise":
        raise ManifestError(f"on_error is raise, skip or warn, not {on_error!r}")
    broken = F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" of "), F.col("path"), F.lit(": not JSON"))).cast("boolean")
    return rows.filter(F.when(F.col("record").isNull(), broken).otherwise(True))


def read_lenient_samples(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(samples as VARIANT with line_no, dataset id): broken lines skipped, "unknown" without a header, nothing for a missing file."""
    try:
        rows = read_jsonl(spark, path, "skip")
        kind = F.try_variant_get("record", "$.record_type", "string")
        head = rows.filter(kind == "dataset_info").agg(F.max_by(F.try_variant_get("record", "$.info.dataset_id", "string"), "line_no")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        warnings.warn(f"no such manifest: {path}", stacklevel=2)
        return spark.createDataFrame([], "path string, line_no long, record variant"), "unknown"
    return rows.filter(kind == "sample"), head or "unknown"


def first_header(spark: SparkSession, path: str) -> tuple[str, list[dict]]:
    """(dataset id, labels in order) of the first header anywhere; without labels it raises."""
    records = read_records(spark, path).filter("record.record_type = 'dataset_info'")
    found = records.orderBy("line_no").select("record.info.dataset_id", F.map_values("record.info.label_info").alias("labels")).first()
    if not found or not found["labels"]:
        raise ManifestError(f"no label_info in {path}")
    return found["dataset_id"] or "unknown", [x.asDict(recursive=True) for x in found["labels"]]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, record (null unless a JSON object), is_object; nothing is refused yet."""
    parsed = F.try_parse_json("value")
    kind = F.schema_of_variant(parsed)
    return numbered_lines(spark, path).select(
        "path", "line_no", "value", F.coalesce(kind.startswith("OBJECT"), F.lit(False)).alias("is_object"),
        F.from_json("value", RECORD).alias("record"),
    )


def problems(records: DataFrame, mode: str = "strict") -> DataFrame:
    """One row per refused line: path, line_no, problem (none in mode lenient).

    strict: JSON objects, the header first and once, then samples only. class: the same rules, with
    its own message for a second header. eval: JSON objects; headers and samples anywhere.
    """
    if mode not in MODES:
        raise ManifestError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    if mode == "lenient":
        return records.limit(0).select("path", "line_no", F.lit("").alias("problem"))
    kind = F.coalesce(F.col("record.record_type"), F.lit("sample") if mode == "eval" else F.lit(None).cast("string"))
    wrong = F.when(~F.col("is_object"), "line is not a JSON object")
    if mode != "eval":
        second = "a second dataset_info" if mode == "class" else "record_type must be sample"
        wrong = (
            wrong.when((F.col("line_no") == F.col("first")) & ~F.coalesce(kind == "dataset_info", F.lit(False)), "the first record must be dataset_info")
            .when((F.col("line_no") > F.col("first")) & F.coalesce(kind == "dataset_info", F.lit(False)), second)
        )
    wrong = wrong.when(~F.coalesce(kind.isin("dataset_info", "sample"), F.lit(False)), "unknown record_type")
    if mode in ("strict", "class", "eval"):
        wrong = wrong.when(kind == "sample", sample_problem(F.col("record.sample")))
    firsts = records.groupBy("path").agg(F.min("line_no").alias("first"))
    return records.join(firsts, "path").select("path", "line_no", wrong.alias("problem")).filter("problem is not null")


def _check(records: DataFrame, mode: str) -> None:
    bad = problems(records, mode).orderBy("path", "line_no").first()
    if bad:
        raise ManifestError(f"line {bad['line_no']} of {bad['path']}: {bad['problem']}")


def read_header(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """The header as one row (info.*, schema_version). strict: first record; eval and lenient: the last header anywhere."""
    records = read_records(spark, path)
    if records.isEmpty():
        raise ManifestError(f"empty manifest: {path}")
    if mode in ("strict", "class"):
        first = records.orderBy("line_no").limit(1)
        found = first.filter("record.record_type = 'dataset_info'")
    else:
        found = records.filter("record.record_type = 'dataset_info'").orderBy(F.desc("line_no")).limit(1)
    if found.isEmpty():
        raise ManifestError(f"no dataset_info in {path}")
    return found.select("record.schema_version", "record.info.*")


def label_table(header: DataFrame) -> DataFrame:
    """position, label_id, label_name, description, aliases, parent_label, in the header's order."""
    each = header.select(F.posexplode(F.map_values("label_info")).alias("position", "l")).select("position", "l.*")
    if each.isEmpty():
        raise ManifestError("label_info is empty")
    return each


def read_samples(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """path, line_no, idx from 0, sample.*; mode eval and lenient: of rows that share a sample_id the last one."""
    records = read_records(spark, path)
    _check(records, mode)
    kind = F.coalesce(F.col("record.record_type"), F.lit("sample"))
    rows = records.filter(F.col("is_object") & (kind == "sample"))
    if mode in ("eval", "lenient"):
        rows = rows.groupBy(F.col("record.sample.sample_id").alias("id")).agg(F.max_by(F.struct("path", "line_no", "record"), F.struct("path", "line_no")).alias("r")).select("r.*")
    return numbered(rows.select("path", "line_no", "record"), "line_no", "idx", group=("path",)).select("path", "line_no", "idx", "record.sample.*")


def get_record(samples: DataFrame, idx: int) -> DataFrame:
    """The one sample at a place; an error outside."""
    found = samples.filter(F.col("idx") == idx)
    if found.isEmpty():
        raise IndexError(f"no sample {idx}")
    return found


def annotations(samples: DataFrame, boxed_only: bool = False) -> DataFrame:
    """One row an annotation: sample_id, width, height, idx and the annotation's fields; assets first, then their order."""
    every = F.flatten(F.transform("assets", lambda a: F.coalesce(a["annotations"], F.array())))
    if boxed_only:
        every = F.filter(every, lambda a: a["bbox"].isNotNull())
    rows = samples.select("sample_id", F.get(F.col("assets")[0]["size"], F.lit(0)).alias("width"), F.get(F.col("assets")[0]["size"], F.lit(1)).alias("height"), F.posexplode(every).alias("idx", "a"))
    return rows.select("sample_id", "width", "height", "idx", "a.*")


def label_mismatches(annots: DataFrame, labels: DataFrame) -> DataFrame:
    """Annotations whose label_id does not stand for their label_name; of labels that share an id the first counts."""
    firsts = labels.groupBy("label_id").agg(F.min_by("label_name", "position").alias("known_name"))
    return annots.join(firsts, "label_id", "left").filter(~F.coalesce(F.col("known_name") == F.col("label_name"), F.lit(False)))
