"""Training rows from samples: prompts, targets and message structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.errors import DatasetBuildError
from boxloom.functions.geometry import unit_xyxy
from boxloom.functions.text import PROMPT, build_target, class_prompt, fingerprint, flatten_messages, resolve_uri
from boxloom.operators.matching import union_tables

SCHEMAS = ("conversational", "prompt_completion")


def message(role: str, *parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))


def part(kind: str, text: Column | None = None, path: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("type"), (path if path is not None else none).alias("path"), (text if text is not None else none).alias("text"))


def dataset_prompt(labels: list[tuple[str, str | None]], template: str = PROMPT) -> str:
    """One text a dataset, made once on the driver."""
    return template.replace("{labels}", "\n".join(f"{n}: {(d or '').strip()}" for n, d in labels))


def training_rows(samples: DataFrame, labels: list[tuple[str, str | None]], schema: str = "conversational", include_target: bool = True, root: str | None = None, factor=1000, answer_format: str = "tag_bbox_list") -> DataFrame:
    """samples (sample_id, uri, width, height, annotations) -> messages and images, or prompt, completion and images."""
    if schema not in SCHEMAS:
        raise DatasetBuildError(f"unknown schema {schema!r}")
    if answer_format != "tag_bbox_list":
        raise DatasetBuildError(f"unsupported answer format {answer_format!r}")
    image = resolve_uri(F.col("uri"), root)
    user = message("user", part("image", path=image), part("text", F.lit(dataset_prompt(labels))))
    answer = message("assistant", part("text", build_target(F.col("annotations"), F.col("width"), F.col("height"), factor)))
    images = F.array(image).alias("images")
    if schema == "conversational":
        return samples.select("sample_id", (F.array(user, answer) if include_target else F.array(user)).alias("messages"), images)
    done = F.array(answer) if include_target else F.slice(F.array(answer), 1, 0)
    return samples.select("sample_id", F.array(user).alias("prompt"), done.alias("completion"), images)


def build_split(manifests: list[DataFrame], labels: list[list[tuple[str, str | None]]], **options) -> DataFrame:
    """Rows of several manifests in the given order."""
    return union_tables([training_rows(m, l, **options) for m, l in zip(manifests, labels, strict=True)])


def rows_fingerprint(header: DataFrame, schema: str, include_target: bool) -> DataFrame:
    """Header and conversion options as one key, so that no stale rows are taken for these."""
    fields = F.struct(*sorted(header.columns))  # keys in order, on both levels
    return header.select(fingerprint(fields.alias("header"), F.lit(include_target).alias("include_target"), F.lit(schema).alias("schema")).alias("fingerprint"))


def image_path(part: Column, registry: Column | None = None) -> Column:
    """The image a message part names: its own path, else the one its image_id has in the registry (a map); an unknown id names none."""
    by_id = F.try_element_at(registry, part["image_id"]) if registry is not None else F.lit(None).cast("string")
    return F.when(part["type"].isin("image", "image_url"), F.coalesce(part["path"], by_id))


def image_paths(df: DataFrame) -> Column:
    """The distinct image paths of a row, in order: image, images, then those of its messages' parts."""
    kinds, out = dict(df.dtypes), []
    if "image" in kinds:
        out.append(F.when(F.col("image").isNotNull(), F.array("image")))
    if kinds.get("images") == "array<string>":
        out.append(F.col("images"))
    if "messages" in kinds:
        registry = F.col("image_registry") if "image_registry" in kinds else None
        named = "image_id:" in kinds["messages"]
        parts = F.flatten(F.transform("messages", lambda m: m["content"]))
        out.append(F.transform(parts, lambda p: image_path(p, registry) if named else F.when(p["type"].isin("image", "image_url"), p["path"])))
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(*[F.coalesce(c, empty) for c in out], empty), lambda p: p.isNotNull() & ~p.rlike("^https?://")))


def text_of(df: DataFrame) -> Column:
    """A row's text by the first layout the row itself fills: messages; prompt and completion, response or
    answer; instruction, input and output; query and target; the target's text; text."""
    kinds, tries = dict(df.dtypes), []
    flat = lambda c: F.col(c) if kinds[c] == "string" else flatten_messages(F.col(c))
    lines = lambda *cs: F.array_join(F.filter(F.array(*cs), lambda x: x.isNotNull()), "\n")
    if "messages" in kinds:
        tries.append(F.when(F.size("messages") > 0, flatten_messages(F.col("messages"))))
    answers = [flat(a) for a in ("completion", "response", "answer") if a in kinds]
    if "prompt" in kinds and answers:
        tries.append(F.when(F.col("prompt").isNotNull() & F.coalesce(*answers).isNotNull(), lines(flat("prompt"), F.coalesce(*answers))))
    if "instruction" in kinds:
        tries.append(F.when(F.col("instruction").isNotNull(), lines(*[F.col(c) for c in ("instruction", "input", "output") if c in kinds])))
    if "target" in kinds:
        target = F.col("target.text") if kinds["target"].startswith("struct") else F.col("target")
        if "query" in kinds:
            tries.append(F.when(F.col("query").isNotNull() & target.isNotNull(), lines(F.col("query"), target)))
        if kinds["target"].startswith("struct"):
            tries.append(target)
    if "text" in kinds:
        tries.append(F.col("text"))
    return F.coalesce(*tries, F.lit(""))


def manifest_rows(spark, path: str, schema: str = "conversational", include_target: bool = True, root: str | None = None) -> DataFrame:
    """A manifest's training rows: header read once, samples projected."""
    from boxloom.sources import manifest

    _, labels = manifest.first_header(spark, path)
    asset = F.col("assets")[0]
    px = lambda p: F.struct(*[p[a][b].alias(n) for a, b, n in (("tl", "x", "x1"), ("tl", "y", "y1"), ("br", "x", "x2"), ("br", "y", "y2"))])
    boxes = F.transform(asset["annotations"], lambda a: F.struct(a["label_name"].alias("label_name"), F.when(a["bbox"].isNotNull(), px(a["bbox"])).alias("bbox")))
    samples = manifest.read_samples(spark, path).select(
        "sample_id", asset["uri"].alias("uri"), asset["size"][0].alias("width"), asset["size"][1].alias("height"), F.coalesce(boxes, F.array()).alias("annotations"))
    return training_rows(samples, [(x["label_name"], x["description"]) for x in labels], schema, include_target, root)


def legacy_rows(samples: DataFrame, classes: dict[str, list[str]], detailed_ratio: float = 0.5, seed: int = 42, image_root: str | None = None) -> DataFrame:
    """image, prompt, target (and image_root) of samples (image, width, height, annotations: class, bbox xywh).

    target is the JSON text of class and box, 0 to 1 with four places. Which samples get the detailed
    prompt is drawn from a hash of the image and the seed, so reruns agree.
    """
    b = lambda a, k: F.get(a["bbox"], F.lit(k))
    corners = lambda a: unit_xyxy(b(a, 0), b(a, 1), b(a, 2), b(a, 3), F.col("width"), F.col("height"))
    item = lambda a: F.struct(a["class"].alias("class"), F.array(*[corners(a)[c] for c in ("x1", "y1", "x2", "y2")]).alias("box"))
    draw = F.pmod(F.xxhash64("image", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    prompt = F.when(draw < detailed_ratio, class_prompt(classes, True)).otherwise(class_prompt(classes))
    root = [F.lit(image_root).alias("image_root")] if image_root is not None else []
    target = F.to_json(F.transform("annotations", item), {"ignoreNullFields": "false"})
    return samples.select("image", prompt.alias("prompt"), target.alias("target"), *root)
