"""Writers of manifests, metric tables and reports."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxloom.operators.stats import numbered


def record_lines(samples: DataFrame, order: str = "line_no", keep_nulls: bool = True, leave_out: tuple[str, ...] = ("path", "idx", "invalid", "entry_id")) -> DataFrame:
    """(n, value): a sample record a row; bookkeeping columns stay out of it."""
    body = [c for c in samples.columns if c not in (order, *leave_out)]
    options = {"ignoreNullFields": "false" if keep_nulls else "true"}
    return samples.select(F.col(order).cast("long").alias("n"), F.to_json(F.struct(F.lit("sample").alias("record_type"), F.struct(*body).alias("sample")), options).alias("value"))


def header_line(header: DataFrame | dict, spark: SparkSession, keep_nulls: bool = True) -> DataFrame:
    """(n, value) of a header given as a mapping, or as read_header gives it."""
    if isinstance(header, dict):
        return spark.createDataFrame([(-1, json.dumps(header, ensure_ascii=False, separators=(",", ":")))], "n long, value string")
    info = [c for c in header.columns if c not in ("schema_version", "record_type")]
    version = [F.col("schema_version")] if "schema_version" in header.columns else []
    whole = F.struct(F.lit("dataset_info").alias("record_type"), *version, F.struct(*info).alias("info"))
    return header.select(F.lit(-1).cast("long").alias("n"), F.to_json(whole, {"ignoreNullFields": "false" if keep_nulls else "true"}).alias("value"))


def _numbered_parts(fs, folder) -> list[tuple[str, int]]:
    """(path, bytes) of the part files of a folder that hold something, in the order of their rows."""
    found = []
    for status in fs.listStatus(folder):
        if (m := re.match(r"part-(\d+)-.*?(?:-c(\d+))?\.txt$", status.getPath().getName())) and status.getLen():
            found.append((int(m[1]), int(m[2] or 0), status.getPath(), status.getLen()))
    return [(p, n) for *_, p, n in sorted(found, key=lambda x: x[:2])]


def _copy_to_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part, target, at in zip(batch["part"], batch["target"], batch["at"]):
            with open(part, "rb") as source, open(target, "r+b") as out:
                out.seek(at)
                shutil.copyfileobj(source, out, 1 << 23)
                yield pd.DataFrame({"copied": [out.tell() - at]})


def _join_in_place(spark: SparkSession, parts: list[tuple], target: str) -> None:
    """Parts of a mounted file system as one file: their sizes give their places, and a task a part copies it there.

    A task that is run again writes the same bytes to the same place.
    """
    rows, at = [], 0
    for part, size in parts:
        rows.append((part.toUri().getPath(), target, at))
        at += size
    with open(target, "wb") as out:
        out.truncate(at)
    places = spark.createDataFrame(rows, "part string, target string, at long").repartition(len(rows), "at")
    copied = places.mapInPandas(_copy_to_places, "copied long").agg(F.sum("copied")).first()[0]
    if copied != at or os.path.getsize(target) != at:
        raise OSError(f"{target}: {copied} of {at} bytes written")


def write_ordered(lines: DataFrame, keys: tuple[str, ...], path: str, parts: int | None = None) -> None:
    """``value`` of lines as the one text file of folder path, in the order of keys, written by many tasks.

    Ranges of keys are written as parts, which are then joined without passing through one task: by the store where
    it can (HDFS), or by a task a part that copies it to its place in the file (mounted file systems). Only on other
    stores, which can neither, one task writes the file. What was at path stays until the file is whole. Rows are
    evaluated twice, as ranges come from a sample; parts is their number (None: the session's, less what AQE merges).
    """
    spark = lines.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    goal = jvm.org.apache.hadoop.fs.Path(path)
    fs = goal.getFileSystem(conf)
    goal = fs.makeQualified(goal)
    work = jvm.org.apache.hadoop.fs.Path(goal.getParent(), f"_{goal.getName()}-{uuid.uuid4().hex}")
    child = lambda folder, name: jvm.org.apache.hadoop.fs.Path(folder, name)
    try:
        ranged = lines.repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*keys)
        ranged.select("value").write.text(work.toString())
        found = _numbered_parts(fs, work)
        whole = found[0][0] if found else child(work, "empty")
        if not found:
            fs.create(whole).close()
        elif len(found) > 1 and fs.getUri().getScheme() == "file":
            whole = child(work, "joined")
            _join_in_place(spark, found, whole.toUri().getPath())
        elif len(found) > 1:
            others = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(found) - 1)
            for k, (part, _) in enumerate(found[1:]):
                others[k] = part
            try:
                fs.concat(whole, others)
            except Py4JJavaError as error:
                if "UnsupportedOperationException" not in str(error.java_exception):
                    raise
                again = child(work, "one")
                lines.repartitionByRange(1, *keys).sortWithinPartitions(*keys).select("value").write.text(again.toString())
                whole = _numbered_parts(fs, again)[0][0]
        fs.delete(goal, True)
        fs.mkdirs(goal)
        if not fs.rename(whole, child(goal, "part-00000.txt")):
            raise OSError(f"{path}: the joined file could not be moved into place")
        fs.create(child(goal, "_SUCCESS")).close()
    finally:
        fs.delete(work, True)


def write_lines(lines: DataFrame, path: str, parts: int | None = None) -> None:
    """Rows (n, value) as one text file in the order of n."""
    write_ordered(lines, ("n",), path, parts)


def write_manifest(header: DataFrame | dict, samples: DataFrame, path: str, order: str = "line_no", keep_nulls: bool = True) -> None:
    """One text file of JSON lines, header first, samples in order; nulls are kept or left out."""
    write_lines(header_line(header, samples.sparkSession, keep_nulls).unionByName(record_lines(samples, order, keep_nulls)), path)


def write_conversion(headers: dict[str, dict], merged: dict, entries: dict[str, DataFrame], path: str) -> None:
    """A manifest an entry, <entry>.canonical.jsonl, and merged.canonical.jsonl with all entries in order."""
    spark = next(iter(entries.values())).sparkSession
    every = header_line(merged, spark).withColumn("e", F.lit(-1))
    for k, (name, records) in enumerate(entries.items()):
        write_manifest(headers[name], records, f"{path}/{name}.canonical.jsonl")
        every = every.unionByName(record_lines(records).withColumn("e", F.lit(k)))
    write_ordered(every, ("e", "n"), f"{path}/merged.canonical.jsonl")


#: The document's frame (fixed values of the format).
COCO_INFO = {"description": "Instance segmentation exported from Label Studio", "url": "", "version": "1.0", "year": 2026, "contributor": "Validation Pipeline", "date_created": "2026-06-04"}


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, info: dict | None = None) -> None:
    """The three tables of coco_tables as one COCO document, a line an object; ids count from 1, categories keep theirs.

    What has no mask gets an empty segmentation.

    No row holds more than a line, and no single task writes the file; see write_ordered.
    """
    spark = images.sparkSession

    def section(rows: DataFrame, no: int, key: str, *more) -> DataFrame:
        row = F.to_json(F.struct(*[F.col(c) for c in rows.columns], *more), {"ignoreNullFields": "false"})
        return rows.select(F.lit(no).alias("s"), F.col(key).cast("long").alias("k"), F.concat(F.when(F.col(key) > 1, F.lit(",")).otherwise(F.lit("")), row).alias("value"))

    blank = [F.lit(0).alias("license"), *[F.lit("").alias(c) for c in ("flickr_url", "coco_url", "date_captured")]]
    cats = categories.withColumn("_k", F.row_number().over(Window.orderBy("id"))).select("_k", F.struct("id", "name", "supercategory").alias("c"))  # a label table
    cat_lines = cats.select(F.lit(6).alias("s"), F.col("_k").cast("long").alias("k"), F.concat(F.when(F.col("_k") > 1, F.lit(",")).otherwise(F.lit("")), F.to_json("c")).alias("value"))
    head = "{" + json.dumps("info") + ":" + json.dumps(COCO_INFO | (info or {})) + ',"licenses":[],"images":['
    frame = spark.createDataFrame([(1, 0, head), (3, 0, '],"annotations":['), (5, 0, '],"categories":['), (7, 0, "]}")], "s int, k long, value string")
    drawn = images.withColumnRenamed("image_id", "id")
    annotations = annotations.withColumn("segmentation", F.parse_json(F.coalesce(F.to_json("segmentation"), F.lit("{}"))))
    lines = frame.unionByName(section(drawn, 2, "id", *blank)).unionByName(section(annotations, 4, "id")).unionByName(cat_lines)
    write_ordered(lines, ("s", "k"), path)


def write_entries(samples: DataFrame, path: str, entry: str = "entry_id") -> None:
    """One folder an entry, and all of them merged in order."""
    lines = samples.select(entry, "line_no", F.to_json(F.struct(*[c for c in samples.columns if c not in (entry, "line_no")]), {"ignoreNullFields": "false"}).alias("value"))
    lines.select(entry, "value").write.mode("overwrite").partitionBy(entry).text(f"{path}/entries")
    lines.repartitionByRange(F.col(entry), F.col("line_no")).sortWithinPartitions(entry, "line_no").select("value").write.mode("overwrite").text(f"{path}/merged")


def write_csv(rows: DataFrame, path: str) -> bool:
    """With a header line, in one file; nothing is written for no rows."""
    if rows.isEmpty():
        return False
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return True


def write_errors(rows: DataFrame, path: str) -> bool:
    """A JSON array of sample_id, error and generated_text of failed answers, only if there are any."""
    if rows.isEmpty():
        return False
    lines = numbered(rows.withColumn("_at", F.monotonically_increasing_id()), "_at", "n", start=1)
    one = F.to_json(F.struct("sample_id", "error", "generated_text"), {"ignoreNullFields": "false"})
    body = lines.select("n", F.concat(F.when(F.col("n") > 1, F.lit(",")).otherwise(F.lit("")), one).alias("value"))
    edges = rows.sparkSession.createDataFrame([(0, "["), (1 << 62, "]")], "n long, value string")
    write_lines(body.unionByName(edges), path)
    return True


def write_statistics(report: DataFrame, path: str) -> None:
    """The one row of dataset_statistics as a JSON document, indented, nulls kept."""
    report.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false", "pretty": "true"}).alias("value")).write.mode("overwrite").text(path)
