"""Dataset statistics, sampling and splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxloom.errors import DatasetBuildError
from boxloom.functions.text import flatten_messages


#: The percentiles of a distribution; the error of the sketch that brackets them, as one in so many rows; and groups
#: that are told to all tasks.
QUANTILES = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
ACCURACY, MOST_TOLD = 10_000, 10_000


def numeric_stats(df: DataFrame, value: str, by: tuple[str, ...] = (), max_length: float | None = None) -> DataFrame:
    """count, min, mean, population std, median, p90, p95, p99 (exact, interpolated), max; nulls left out, empty: nulls.

    Percentiles are selected, not sorted: a mergeable sketch gives each a narrow range of values that must hold its
    ranks; then what lies below a range is counted, and only values inside ranges, equal ones as one row, are put in
    order. No task holds a group's values, but a thousandth of their distinct ones, or a group of at most ACCURACY rows.
    """
    v = F.col(value).cast("double")
    margin = 5 / ACCURACY
    marks = F.array(*[F.lit(x) for q in QUANTILES.values() for x in (max(0.0, q - margin), min(1.0, q + margin))])
    aggs = [F.count(v).alias("count"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.max(v).alias("max")]
    if max_length is not None:
        aggs.append(F.count_if(v > max_length).alias("num_over_max_length"))
    one = df.groupBy(*by).agg(*aggs, F.percentile_approx(v, marks, ACCURACY).alias("_marks"))
    told = one.limit(MOST_TOLD + 1).collect()
    if len(told) <= MOST_TOLD:  # a short row a group
        one = F.broadcast(df.sparkSession.createDataFrame(told, one.schema))
    ranges = one.filter("count > 0").select(*[F.col(c).alias(f"_{c}") for c in by], F.col("count").alias("_n"), *[
        F.when(F.col("count") <= ACCURACY, F.col(end)).otherwise(F.get("_marks", F.lit(2 * k + high))).alias(f"_{n}{k}") for k in range(len(QUANTILES)) for n, high, end in (("low", 0, "min"), ("high", 1, "max"))])
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = df.select(*by, v.alias("_v")).filter("_v is not null").join(ranges, same)
    groups = [f"_{c}" for c in by]
    below = rows.groupBy(*groups).agg(*[F.count_if(F.col("_v") < F.col(f"_low{k}")).alias(f"_below{k}") for k in range(len(QUANTILES))])
    held = F.filter(F.array(*[F.when(F.col("_v").between(F.col(f"_low{k}"), F.col(f"_high{k}")), k) for k in range(len(QUANTILES))]), lambda k: k.isNotNull())
    inside = rows.select(*groups, "_n", "_v", F.explode(held).alias("_k")).groupBy(*groups, "_n", "_k", "_v").agg(F.count(F.lit(1)).alias("_many"))
    upto = Window.partitionBy(*groups, "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    null_safe = lambda other: [F.col(f"_{c}").eqNullSafe(F.col(f"{other}_{c}")) for c in by] or [F.lit(True)]
    counted = below.select(*[F.col(g).alias(f"b{g}") for g in groups], F.array(*[f"_below{k}" for k in range(len(QUANTILES))]).alias("_below"))
    placed = inside.withColumn("_end", F.sum("_many").over(upto)).join(F.broadcast(counted) if len(told) <= MOST_TOLD else counted, null_safe("b"))
    quantile = F.element_at(F.lit([float(q) for q in QUANTILES.values()]), F.col("_k") + 1)
    rank = quantile * (F.col("_n") - 1)
    end, before = F.col("_end") + F.get("_below", F.col("_k")), F.get("_below", F.col("_k"))
    at = lambda r: F.min(F.when(end > r, F.col("_v")))
    picked = placed.groupBy(*groups, "_k").agg(at(F.floor(rank)).alias("_lower"), at(F.ceil(rank)).alias("_upper"), F.max(rank - F.floor(rank)).alias("_weight"), F.max(before > F.floor(rank)).alias("_missed"))
    sound = ~F.col("_missed") & F.col("_upper").isNotNull()
    between = F.when(F.col("_lower") == F.col("_upper"), F.col("_lower")).otherwise((1 - F.col("_weight")) * F.col("_lower") + F.col("_weight") * F.col("_upper"))
    found = picked.select(*groups, "_k", F.when(sound, between).otherwise(F.raise_error(F.lit("a percentile lies outside its range")).cast("double")).alias("_q"))
    wide = found.groupBy(*groups).agg(*[F.max(F.when(F.col("_k") == k, F.col("_q"))).alias(n) for k, n in enumerate(QUANTILES)])
    joined = one.join(wide, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] or F.lit(True), "left")
    out = joined.select(*by, "count", "min", "mean", "std", "max", *(["num_over_max_length"] if max_length is not None else []), *QUANTILES)
    if max_length is not None:
        out = out.withColumn("ratio_over_max_length", F.when(F.col("count") > 0, F.col("num_over_max_length") / F.col("count")).otherwise(0.0))
    return out


def label_histogram(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def stride_positions(n: Column, most: int | None) -> Column:
    """Uniform stride over 0 .. n - 1: min(floor(i * n / most), n - 1) for i < most; all if most is none, <= 0 or >= n."""
    every = F.sequence(F.lit(0).cast("long"), n - 1)
    if not most or most <= 0:
        return F.when(n > 0, every)
    part = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.least(F.floor(i * n / most), n - 1))
    return F.when(n <= 0, None).when(n <= most, every).otherwise(part)


def is_stride_pick(index: Column, n: Column, most: int | None) -> Column:
    """Whether a row index is among stride_positions, in closed form: no join, nothing collected."""
    if not most or most <= 0:
        return F.lit(True)
    i = F.ceil(index * F.lit(most) / n)
    near = lambda k: (k < most) & (F.least(F.floor(k * n / F.lit(most)), n - 1) == index)
    return (n <= most) | near(i) | near(i - 1) | near(i + 1)


def batch_number(index: Column, size: int) -> Column:
    return F.floor(index / size)


def debug_subset(df: DataFrame, index: str, most: int | None) -> DataFrame:
    """The first ``most`` rows by index; all without a bound or with one that is not positive."""
    return df.filter(F.col(index) < most) if most and most > 0 else df


def plot_series(metrics: DataFrame, value: str) -> DataFrame:
    """model, threshold and value as numbers, rows without one left out, in plotting order."""
    numbers = metrics.select("model", F.col("threshold").try_cast("double").alias("threshold"), F.col(value).try_cast("double").alias(value))
    sound = numbers.filter(~F.isnan(F.coalesce("threshold", F.lit(float("nan")))) & ~F.isnan(F.coalesce(F.col(value), F.lit(float("nan")))))
    return sound.orderBy("model", "threshold")


def by_requested_ids(df: DataFrame, id_col: str, wanted: list[str] | None, most: int) -> tuple[DataFrame, list[str]]:
    """(the rows of the wanted ids, the wanted ids that are missing); without a list the first ``most`` by id."""
    if not wanted:
        return first_by_id(df, id_col, most), []
    kept = df.filter(F.col(id_col).cast("string").isin([str(w) for w in wanted]))
    have = {str(r[0]) for r in kept.select(id_col).distinct().collect()}  # at most as many as were asked for
    return kept, [w for w in wanted if str(w) not in have]


def first_by_id(df: DataFrame, id_col: str, n: int) -> DataFrame:
    return df.orderBy(id_col).limit(n)


def train_val_split(df: DataFrame, id_col: str, val: float = 0.2, seed: int = 42) -> DataFrame:
    """df with ``split``: exactly rint(n * val) rows are val, by the smallest MD5 of id and seed.

    The cut is found on the hash alone: counts of its leading digits tell the digit group the cut
    falls into, and only that group is ranked.
    """
    if not 0 < val < 1:
        raise DatasetBuildError("val must lie between 0 and 1")
    keyed = df.withColumn("_h", F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(seed).cast("string")))).withColumn("_g", F.substring("_h", 1, 3))
    groups = keyed.groupBy("_g").agg(F.count(F.lit(1)).alias("n"))  # 4096 rows at most
    total = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan = groups.select("_g", "n", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.rint(F.sum("n").over(total) * val).cast("long").alias("want"))
    ranked = keyed.join(F.broadcast(plan), "_g")
    edge = (F.col("before") < F.col("want")) & (F.col("before") + F.col("n") > F.col("want"))
    inside = ranked.filter(edge).withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy("_h", id_col)) + F.col("before"))
    outside = ranked.filter(~edge).withColumn("_r", F.col("before") + F.col("n"))
    both = inside.unionByName(outside).withColumn("split", F.when(F.col("_r") <= F.col("want"), "val").otherwise("train"))
    return both.select(*df.columns, "split")


#: Rows counted in one window task of ``numbered``.
BLOCK = 1 << 16


def numbered(df: DataFrame, by: str, name: str, start: int = 0, then: tuple[str, ...] = (), group: tuple[str, ...] = ()) -> DataFrame:
    """df with consecutive numbers in the order of the long column ``by`` (and the columns ``then``), a sequence a group.

    Blocks of values are counted first; a window runs inside a block only, and what a block starts
    with comes from the sums of the blocks before it, one short row each.
    """
    blocked = df.withColumn("_block", F.floor(F.col(by) / BLOCK))
    upto = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocked.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_many"))
    begins = sizes.select(*group, "_block", F.coalesce(F.sum("_many").over(upto), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group, "_block").orderBy(by, *then))
    return blocked.withColumn("_in", inside).join(begins, [*group, "_block"]).withColumn(name, (F.col("_before") + F.col("_in") + (start - 1)).cast("long")).select(*df.columns, name)


def mask_length(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x)


def count_not(values: Column, pad: int) -> Column:
    return F.size(F.filter(values, lambda x: x != pad))


def structure_counts(messages: Column) -> Column:
    """struct(n_messages, n_text, n_image) of array<struct<role, content: array<struct<type, ...>>>>."""
    parts = F.flatten(F.transform(messages, lambda m: m["content"]))
    return F.struct(
        F.size(messages).alias("n_messages"), F.size(F.filter(parts, lambda p: p["type"] == "text")).alias("n_text"),
        F.size(F.filter(parts, lambda p: p["type"].isin("image", "image_url"))).alias("n_image"),
    )


def sample_structure(df: DataFrame) -> Column:
    """struct of a row's counts: messages, text and image parts, images given as a mapping, target instances, their labels.

    Columns messages, images (map) and target (struct with instances: array of struct with label) count where they are there.
    """
    kinds = dict(df.dtypes)
    m = structure_counts(F.col("messages")) if "messages" in kinds else None
    part = lambda n: F.coalesce(m[n], F.lit(0)) if m is not None else F.lit(0)
    images = F.coalesce(F.size("images"), F.lit(0)) if kinds.get("images", "").startswith("map") else F.lit(0)
    has_target = "instances:" in kinds.get("target", "")
    found = F.coalesce(F.transform("target.instances", lambda i: i["label"]), F.array().cast("array<string>")) if has_target else F.array().cast("array<string>")
    return F.struct(
        part("n_messages").alias("num_messages"), part("n_text").alias("num_text_parts"), images.alias("num_image_assets"), part("n_image").alias("num_message_image_parts"),
        F.size(found).alias("num_target_instances"), F.filter(found, lambda x: x.isNotNull()).alias("labels"))


def token_length(text: Column) -> Column:
    """Whitespace tokens, in place of a model's tokenizer; see captured for one of your own."""
    return F.size(F.filter(F.split(text, "\\s+"), lambda t: t != ""))


def captured(function, column: Column) -> Column:
    """struct(value, error) of a Python function of a text, a tokenizer's length say: what it raises is told, not raised."""
    @F.pandas_udf(T.StructType([T.StructField("value", T.LongType()), T.StructField("error", T.StringType())]))
    def each(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            try:
                value = function(text)
                out.append((None if value is None else int(value), None))
            except Exception as e:  # noqa: BLE001  it is part of the report
                out.append((None, repr(e)))
        return pd.DataFrame(out, columns=["value", "error"]).astype({"value": "Int64"})

    return each(column)


#: Distributions of a report and the sample counts among them.
LENGTHS = ("raw_token_length", "collated_input_length", "collated_label_length")
COUNTS = {
    "messages_per_sample": "num_messages", "text_parts_per_sample": "num_text_parts", "image_assets_per_sample": "num_image_assets",
    "message_image_parts_per_sample": "num_message_image_parts", "target_instances_per_sample": "num_target_instances"}
#: Errors that a report tells.
MOST_ERRORS = 20


def dataset_statistics(
    df: DataFrame, split: str, index: str, lengths: dict[str, Column] | None = None, max_length: int | None = None, max_samples: int | None = None,
) -> DataFrame:
    """One row: the report on a dataset of training rows (messages, images, target as sample_structure reads them).

    index numbers the rows from 0; with max_samples only those of a uniform stride are inspected. lengths gives columns
    for raw_token_length (whitespace tokens of the flattened messages otherwise), collated_input_length and
    collated_label_length: numbers, or what captured gives, whose errors go into the report with sample and stage. Nulls
    are no measurement. All distributions are rows of one table, so they share the selection of percentiles.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    chosen = df.filter(is_stride_pick(F.col(index), F.lit(total), max_samples))
    flat = token_length(flatten_messages(F.col("messages"))) if "messages" in df.columns else F.lit(None).cast("long")
    given = {"raw_token_length": flat} | (lengths or {})
    if unknown := sorted(set(given) - set(LENGTHS)):
        raise DatasetBuildError(f"unknown lengths: {', '.join(unknown)}")
    measured = chosen.select(F.col(index).cast("long").alias("i"), sample_structure(df).alias("s"), *[c.alias(n) for n, c in given.items()])
    tells = [n for n, kind in measured.dtypes if n in given and kind.startswith("struct")]
    number = lambda n: (F.col(n)["value"] if n in tells else F.col(n)).cast("double") if n in given else F.lit(None).cast("double")
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), number(n).alias("v")) for n in LENGTHS], *[F.struct(F.lit(n).alias("name"), F.col(f"s.{c}").cast("double").alias("v")) for n, c in COUNTS.items()])
    told = numeric_stats(measured.select(F.explode(pairs).alias("p")).select("p.name", "p.v"), "v", ("name",), max_length).filter("count > 0")
    rows = {r["name"]: r.asDict() for r in told.collect()}  # a row a distribution

    def shown(name: str) -> Column:
        row = rows.get(name, {"count": 0})
        fields = ["count", "min", "mean", "std", "median", "p90", "p95", "p99", "max"]
        if max_length is not None and name in LENGTHS:
            fields += ["num_over_max_length", "ratio_over_max_length"]
        kind = lambda f: "bigint" if f in ("count", "num_over_max_length") else "double"
        return F.struct(*[F.lit(row.get(f)).cast(kind(f)).alias(f) for f in fields]).alias(name)

    labels = measured.select(F.explode("s.labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    spread = labels.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("label_distribution"))  # a label table
    stage = {"raw_token_length": "raw_inspection"}
    wrong = F.filter(F.array(*[F.struct(F.lit(LENGTHS.index(n)).alias("k"), F.lit(stage.get(n, "collator")).alias("stage"), F.col(n)["error"].alias("error")) for n in tells]), lambda e: e["error"].isNotNull()) if tells else F.array().cast("array<struct<k:int,stage:string,error:string>>")
    errors = measured.select("i", F.explode(wrong).alias("e")).select("i", "e.k", "e.stage", "e.error")
    many = errors.agg(F.count(F.lit(1)).alias("num_errors"))
    order = (F.col("stage") != "raw_inspection").cast("int")  # the inspection comes before the collation
    first = errors.orderBy(order, "i", "k").limit(MOST_ERRORS).agg(F.sort_array(F.collect_list(F.struct(order.alias("later"), "i", "k", "stage", "error"))).alias("e"))
    listed = first.select(F.transform("e", lambda e: F.struct(e["i"].alias("sample_index"), e["stage"].alias("stage"), e["error"].alias("error"))).alias("errors"))
    inspected = measured.agg(F.count(F.lit(1)).alias("num_samples_inspected"))
    whole = inspected.join(spread, F.lit(True)).join(many, F.lit(True)).join(listed, F.lit(True))  # of one row each
    return whole.select(
        F.lit(split).alias("split"), F.lit(total).cast("bigint").alias("num_samples_total"), "num_samples_inspected", F.lit(max_length).cast("int").alias("max_length"),
        *[shown(n) for n in (*LENGTHS, *COUNTS)], "label_distribution", "num_errors", "errors")
