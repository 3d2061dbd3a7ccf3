"""Conversion of detection data to one label table and validated boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.errors import DatasetBuildError
from boxloom.functions import geometry as G
from boxloom.functions.text import sanitize_label, sequential_id


def label_table(declared: DataFrame, seen: DataFrame, sanitize: bool = True) -> DataFrame:
    """label_id from 1, label_name, description: declared labels (label, description, ord) first, then seen ones (label, ord).

    Order is that of first appearance; the first description counts, even if it is null. One row a
    label leaves the aggregation, so the numbering's window is as small as the taxonomy.
    """
    rows = declared.select("label", "description", F.struct(F.lit(0).alias("s"), F.col("ord").cast("long").alias("o")).alias("at")).unionByName(
        seen.select("label", F.lit(None).cast("string").alias("description"), F.struct(F.lit(1).alias("s"), F.col("ord").cast("long").alias("o")).alias("at")))
    rows = rows.filter("label is not null")
    if sanitize:
        rows = rows.withColumn("label", sanitize_label(F.col("label")))
    one = rows.groupBy("label").agg(F.min("at").alias("at"), F.min_by(F.struct("description"), "at").alias("d"))
    return one.select(F.row_number().over(Window.orderBy("at", "label")).alias("label_id"), F.col("label").alias("label_name"), F.col("d.description").alias("description"))


def label_collisions(labels: DataFrame, name: str = "label") -> DataFrame:
    """Clean names that several raw names become."""
    return labels.select(name).distinct().groupBy(sanitize_label(F.col(name)).alias("label_name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def convert_boxes(rows: DataFrame, labels: DataFrame, raise_invalid: bool = False, sanitize: bool = True) -> DataFrame:
    """rows (image_id, at, class, bbox array, width, height) with label, pixel box, centre point and verdict.

    A null class or box is invalid whatever the options; a class without a label raises.
    """
    clean = F.when(F.col("class").isNotNull(), sanitize_label(F.col("class")) if sanitize else F.col("class"))
    named = rows.withColumn("label_name", clean).join(labels.select("label_name", "label_id"), "label_name", "left")
    b = lambda k: F.get("bbox", F.lit(k))
    box = F.when(F.size("bbox") == 4, G.xywh_to_xyxy(b(0), b(1), b(2), b(3), F.col("width"), F.col("height")))
    known = F.when(F.col("class").isNotNull() & F.col("label_id").isNull(), F.raise_error(F.concat(F.lit("unknown label: "), F.col("class"))).cast("boolean")).otherwise(F.lit(True))
    valid = known & F.col("class").isNotNull() & G.is_valid(F.col("box"))
    if raise_invalid:
        valid = F.when(F.col("class").isNotNull() & F.col("box").isNotNull() & ~valid, F.raise_error(F.lit("invalid box")).cast("boolean")).otherwise(valid)
    out = named.withColumn("box", box).withColumn("valid", valid)
    return out.withColumn("point", F.when(F.col("valid"), G.center(F.col("box")))).withColumn("instance_id", sequential_id(F.col("at"), "obj_", 5))


#: Images whose annotations one task holds, sorts and joins.
IMAGES_A_TASK = 50_000


def partitions(images: DataFrame) -> int:
    """In how many partitions these images and what is joined to them belong, so that a task's part does not grow with their
    number; 0 where there are few. The images are counted."""
    many = -(-images.count() // IMAGES_A_TASK)
    usual = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(many, usual) if many > images.sparkSession.sparkContext.defaultParallelism else 0


def group_annotations(images: DataFrame, annots: DataFrame, key: str = "image_id", order: str = "at", spread: bool = True) -> DataFrame:
    """images with their annotations as an ordered array, empty where there are none; orphans go.

    Both are partitioned by the number of images, annotations that are so already (spread: False) as they come.
    """
    payload = [c for c in annots.columns if c not in (key, order)]
    if spread and (many := partitions(images)):
        images, annots = images.repartition(many, key), annots.repartition(many, key)
    grouped = annots.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *payload))).alias("annotations"))
    joined = images.join(grouped.hint("merge"), key, "left")  # as many rows as images: never broadcast
    return joined.withColumn("annotations", F.coalesce("annotations", F.array()))


def drop_empty(samples: DataFrame) -> DataFrame:
    return samples.filter(F.size("annotations") > 0)


def keep_categories(annots: DataFrame, categories: DataFrame, wanted: list[int] | None) -> DataFrame:
    """Annotations of the wanted category ids; ids that no category has raise."""
    if wanted is None:
        return annots
    have = {r[0] for r in categories.filter(F.col("category_id").isin(wanted)).select("category_id").distinct().collect()}
    if unknown := sorted(set(wanted) - have):
        raise DatasetBuildError(f"unknown categories: {unknown}")
    return annots.filter(F.col("category_id").isin(wanted))


def conversion_counts(images: DataFrame) -> DataFrame:
    """One row: images, written, empty_seen (before validation), instances, invalid, from images with converted annotations."""
    valid = F.size(F.filter("annotations", lambda a: a["valid"]))
    return images.agg(
        F.count(F.lit(1)).alias("images"), F.count_if(valid > 0).alias("written"), F.count_if(F.size("annotations") == 0).alias("empty_seen"),
        F.coalesce(F.sum(valid), F.lit(0)).alias("instances"), F.coalesce(F.sum(F.size("annotations") - valid), F.lit(0)).alias("invalid"),
    )


def merge_taxonomies(external: DataFrame, inline: DataFrame, override: DataFrame) -> DataFrame:
    """label, description, aliases, parent_label: field by field override, then inline, then external."""
    fields = ("description", "aliases", "parent_label")
    side = lambda df, n: df.select("label", *[F.col(c).alias(f"{c}{n}") for c in fields])
    every = side(external, 0).join(side(inline, 1), "label", "full").join(side(override, 2), "label", "full")
    return every.select("label", *[F.coalesce(f"{c}2", f"{c}1", f"{c}0").alias(c) for c in fields])


def entry_labels(labels: DataFrame, declared: DataFrame, used: DataFrame) -> DataFrame:
    """entry_id and the labels it declares or uses, in the global order."""
    mine = declared.select("entry_id", "label_name").unionByName(used.select("entry_id", "label_name")).distinct()
    return mine.join(labels, "label_name").orderBy("entry_id", "label_id")
