"""Paths of configurations, images and samples: on the driver for the few of a run, as columns for the many of a dataset."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.errors import DatasetBuildError
from boxloom.functions.text import REMOTE, basename

URI_MODES = ("absolute", "relative")


def _is_remote(path: str) -> bool:
    return path.startswith(("http://", "https://", "s3://", "gs://"))


def config_path(path: str | None, base_dir: str | None = None) -> str | None:
    """A path of a configuration: home expanded, remote and absolute ones as they are, others under base_dir or here."""
    if path is None:
        return None
    path = os.path.expanduser(str(path))
    if _is_remote(path) or os.path.isabs(path):
        return path
    return os.path.realpath(os.path.join(base_dir, path) if base_dir else path)


def data_path(path: str | None, base_dir: str | None = None) -> str | None:
    """As config_path, but what does not exist stays as it is written, under base_dir if there is one."""
    if path is None:
        return None
    path = os.path.expanduser(str(path))
    if _is_remote(path) or os.path.isabs(path):
        return path
    joined = os.path.normpath(os.path.join(base_dir, path) if base_dir else path)
    return os.path.realpath(joined) if os.path.exists(joined) else joined


def once(value: Column, use) -> Column:
    """use(value), where value is worked out a single time however often it is named; without this every mention costs anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normal(path: Column) -> Column:
    """An absolute path without empty, . and .. segments; .. at the root stays there."""
    step = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    climb = lambda parts: F.when(F.array_contains(parts, ".."), F.aggregate(parts, F.array().cast("array<string>"), step)).otherwise(parts)
    kept = once(F.filter(F.split(path, "/"), lambda s: ~s.isin("", ".")), climb)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def tidy(path: Column) -> Column:
    """A path as it is written, without doubled slashes, . segments and a slash at the end."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    joined = F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))
    return F.when(path.isNotNull(), F.coalesce(F.nullif(joined, F.lit("")), F.lit(".")))


def seen_from(path: Column, base: str) -> Column:
    """A normal absolute path relative to the folder base, with ../ where it lies outside."""
    here = [p for p in os.path.normpath(base).split("/") if p]

    def seen(there: Column) -> Column:
        # how many leading segments are the same: the first that is not, or all
        differs = F.array(*[F.when(~F.get(there, F.lit(k)).eqNullSafe(F.lit(p)), k) for k, p in enumerate(here)], F.lit(len(here)))
        same = F.array_min(differs)
        return once(same, lambda n: F.array_join(F.concat(F.array_repeat(F.lit(".."), F.lit(len(here)) - n), F.slice(there, n + 1, F.size(there))), "/"))

    return once(path, lambda p: F.when(p.isNotNull(), F.coalesce(F.nullif(once(F.split(F.substring(p, F.lit(2), F.length(p)), "/"), seen), F.lit("")), F.lit("."))))


def absolute_image(image: Column, config_dir: str, global_root: str | None = None) -> Column:
    """Remote and absolute paths as they are, others under the global root, without one under the configuration's folder."""
    root = data_path(global_root, config_dir) or config_dir
    return F.when(image.rlike(REMOTE) | image.startswith("/"), image).otherwise(normal(F.concat(F.lit(os.path.realpath(root) + "/"), image)))


def image_uri(image: Column, mode: str, config_dir: str, global_root: str | None = None, common_folder: str | None = None) -> Column:
    """The URI a record stores. absolute: the whole path. relative: seen from the common folder, or as given without one."""
    if mode not in URI_MODES:
        raise DatasetBuildError(f"uri mode {mode!r} is none of {', '.join(URI_MODES)}")
    if mode == "absolute":
        local = absolute_image(image, config_dir, global_root)
    elif common_folder is None:
        local = tidy(image)
    else:
        local = seen_from(normal(absolute_image(image, config_dir, global_root)), config_path(common_folder, config_dir))
    return F.when(image.rlike(REMOTE), image).otherwise(local)


def sample_uri(sample: Column, legacy: Column | None = None) -> Column:
    """The first of a sample's uris that is not empty: its first asset's, the file name its metadata keep, the legacy fields."""
    asset = F.try_element_at(sample["assets"], F.lit(1))
    original = F.try_variant_get(asset["metadata"], "$.original_file_name", "string")
    tries = [asset["uri"], original, *([] if legacy is None else [F.try_variant_get(legacy, p, "string") for p in (
        "$.images.query.path", "$.image_path", "$.image", "$.file_path", "$.metadata.original_file_name")])]
    return F.coalesce(*[F.when(t != "", t) for t in tries])


def find_images(samples: DataFrame, files: DataFrame, folder: str, by_basename: bool = True) -> DataFrame:
    """samples (uri) with ``found``: the first that exists of the uri itself if absolute, it under folder, its last part
    under folder, and any file of that name below folder, by path; null without one.

    files (path) is a listing, say of binaryFile without content; everything is an equi-join with it.
    """
    root = folder.rstrip("/")
    known = files.select(F.col("path").alias("at")).distinct()
    uri = F.col("uri")
    row = samples.withColumn("_row", F.monotonically_increasing_id())
    tries = F.array(F.when(uri.startswith("/"), uri), F.when(~uri.startswith("/"), normal(F.concat(F.lit(root + "/"), uri))), F.concat(F.lit(root + "/"), basename(uri)))
    exact = row.select("_row", F.posexplode(tries).alias("rank", "at")).join(known, "at").groupBy("_row").agg(F.min_by("at", "rank").alias("exact"))
    out = row.join(exact, "_row", "left")
    if by_basename:
        below = known.filter(F.col("at").startswith(root + "/")).groupBy(basename(F.col("at")).alias("_base")).agg(F.min("at").alias("below"))
        out = out.withColumn("_base", basename(uri)).join(below, "_base", "left").withColumn("exact", F.coalesce("exact", "below"))
    return out.select(*samples.columns, F.col("exact").alias("found"))
