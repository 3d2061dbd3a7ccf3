"""Hard negatives by a two-dimensional block matrix multiply.

Vectors are cut into blocks of rows and chunks of dimensions. A task multiplies one chunk of a block
of anchors with the same chunk of a block of rows; the partial int64 score tiles of a (anchor block,
row block) cell meet in a shuffle, are added, and only the tile's top rows per anchor, or per anchor
and positive, leave the cell. Blocks hold rows of one bucket of labels: the first pass, for the
positives, multiplies equal buckets only, the second, for the negatives in the windows that the
positives open, the others (and a bucket of several labels with itself). A hot label is many blocks.
Anchors are a stated query set; tiles are never joined by a hot key, since an anchor block is sent
to numbered row blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import staged
from boxloom.llm.vectors import fixed_point

BUCKETS = 64
#: Rows of a block of rows and of a block of anchors: a tile has at most 2 ** 20 scores, 8 MB.
ROWS, ANCHORS = 4096, 256
#: Dimensions of a chunk, and the most chunks: the partial tiles of a cell that meet in one task.
CHUNK, MOST_CHUNKS = 32, 4
SLICE = "bucket int, block long, place int, chunk int, ids binary, labels binary, x binary"
FOUND = "block long, at int, anchor_id long, positive int, id long, score long"


def _cut(size: int, chunk: int, chunks: int, width: int):
    """A function that cuts the rows of a (place, anchor or row) group into blocks, a row per block and chunk."""
    def cut(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "code"], kind="stable")
        out = []
        for k, begin in enumerate(range(0, len(pdf), size)):
            part = pdf.iloc[begin : begin + size]
            x = np.zeros((len(part), chunk * chunks), dtype=np.int32)
            x[:, :width] = np.stack(part["x"].to_numpy())
            ids, codes = part["id"].to_numpy(np.int64).tobytes(), part["code"].to_numpy(np.int64).tobytes()
            for c in range(chunks):
                out.append((int(key[0]), (int(key[1]) << 24) + k, int(key[1]), c, ids, codes, np.ascontiguousarray(x[:, c * chunk : (c + 1) * chunk]).tobytes()))
        return pd.DataFrame(out, columns=["bucket", "block", "place", "chunk", "ids", "labels", "x"])

    return cut


def _multiply(chunk: int):
    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a = np.frombuffer(r.a_x, dtype=np.int32).reshape(-1, chunk)
                b = np.frombuffer(r.x, dtype=np.int32).reshape(-1, chunk)
                most = int(np.abs(a.astype(np.int64)).max(initial=0)) * int(np.abs(b.astype(np.int64)).max(initial=0)) * chunk
                # floating-point products are exact below 2 ** 53, and much faster
                tile = (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T
                first = r.chunk == 0  # what the cell needs beside the scores goes with one of its partial tiles
                yield pd.DataFrame({
                    "block": [r.a_block], "rows": [r.block], "chunk": [r.chunk], "tile": [tile.tobytes()], "windows": [r.windows if first else None],
                    **{n: [getattr(r, n) if first else None] for n in ("a_ids", "a_labels", "ids", "labels")}})

    return multiply


def _top(keys: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of every row, falling."""
    k = min(k, keys.shape[1])
    part = np.argpartition(-keys, k - 1, axis=1)[:, :k] if k < keys.shape[1] else np.tile(np.arange(keys.shape[1]), (len(keys), 1))
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(keys, part, axis=1), axis=1, kind="stable"), axis=1)


def _ranks(scores: np.ndarray) -> np.ndarray:
    """Whole numbers that order every row's scores like (score, smaller column first), all different, from 0."""
    n = scores.shape[1]
    if np.abs(scores).max(initial=0) < 2**62 // max(1, n) - 1:
        ranks = scores * n + (n - 1 - np.arange(n))
        return ranks - ranks.min(initial=0)
    order = np.argsort(-scores, axis=1, kind="stable")
    out = np.empty_like(scores)
    np.put_along_axis(out, order, np.arange(n - 1, -1, -1)[None, :].repeat(len(scores), axis=0), axis=1)
    return out


def _reduce(best: int):
    """Adds the partial tiles of a cell and keeps the best rows: of the anchor's label, or of other labels within its windows."""
    def reduce(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["chunk"] == 0].iloc[0]
        a_ids, a_labels, ids, labels = (np.frombuffer(head[n], dtype=np.int64) for n in ("a_ids", "a_labels", "ids", "labels"))
        scores = np.zeros((len(a_ids), len(ids)), dtype=np.int64)
        for tile in pdf["tile"]:
            scores += np.frombuffer(tile, dtype=np.int64).reshape(scores.shape)
        ranks, same = _ranks(scores), a_labels[:, None] == labels[None, :]
        found = []

        def take(rows: np.ndarray, allowed: np.ndarray, positive: int) -> None:
            masked = np.where(allowed, ranks[rows], -1)
            columns = _top(masked, best)
            at, rank = np.nonzero(np.take_along_axis(masked, columns, axis=1) >= 0)
            column = columns[at, rank]
            found.append(pd.DataFrame({"at": rows[at].astype(np.int32), "anchor_id": a_ids[rows[at]], "positive": np.int32(positive), "id": ids[column], "score": scores[rows[at], column]}))

        if head["windows"] is None:
            take(np.arange(len(a_ids)), same & (a_ids[:, None] != ids[None, :]), -1)
        else:
            windows = np.frombuffer(head["windows"], dtype=np.int64).reshape(len(a_ids), -1, 3)  # there, low, high
            for k in range(windows.shape[1]):
                there = np.flatnonzero(windows[:, k, 0])
                low, high = windows[there, k, 1:2], windows[there, k, 2:3]
                take(there, ~same[there] & (scores[there] >= low) & (scores[there] <= high), k)
        out = pd.concat(found) if found else pd.DataFrame({"at": [], "anchor_id": [], "positive": [], "id": [], "score": []})
        out.insert(0, "block", int(key[0]))
        return out

    return reduce


def _scored(anchors: DataFrame, rows: DataFrame, places: Column, chunk: int, best: int) -> DataFrame:
    """FOUND rows of the cells that ``places`` (an array of the row blocks' places) gives each anchor block."""
    sent = anchors.select(
        F.col("block").alias("a_block"), F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("x").alias("a_x"), "windows", "chunk", F.explode(places).alias("place"))
    kind = "block long, rows long, chunk int, tile binary, windows binary, a_ids binary, a_labels binary, ids binary, labels binary"
    tiles = sent.join(rows, ["place", "chunk"]).mapInPandas(_multiply(chunk), kind)
    return tiles.groupBy("block", "rows").applyInPandas(_reduce(best), FOUND)


def _ranked(found: DataFrame, by: tuple[str, ...], best: int) -> DataFrame:
    """The best of what the cells kept; Spark limits before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def mine(
    rows: DataFrame, is_anchor: Column, vector: str = "x", id_col: str = "vec_id", label: str = "label", width: int | None = None,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows has long ids, labels and vectors of whole numbers (array<bigint>, shorter ones followed by zeros).
    A row's score is its inner product with the anchor; higher scores come first, ties by smaller id.
    For each anchor and each of its first ``positives`` other rows of the same label, the first
    ``negatives`` rows of other labels with low * positive <= 100 * score <= high * positive, ranked
    from 1. Rows with a null id, label or vector take no part. Rows of the anchor's own id are not
    "other rows". Repeated rows count as often as they are there, repeated anchors give repeated
    results. Entries saturate where an inner product could pass 62 bits. Anchors without a positive, or
    without a negative in the window, give no rows; an empty table gives none.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    keyed = rows.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(label).alias("code"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("x"))
    keyed = keyed.withColumn("bucket", F.pmod("code", F.lit(BUCKETS)).cast("int"))
    told = keyed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("x")).alias("width"), (F.min("code") < F.max("code")).alias("mixed")).orderBy("bucket").collect()  # BUCKETS rows
    width = width if width is not None else max([0, *(r["width"] for r in told)])
    if not width or not any(r["anchors"] for r in told):
        return spark.createDataFrame([], schema)
    chunks = min(MOST_CHUNKS, -(-width // CHUNK))
    chunk = -(-width // chunks)
    limit = min(2**31 - 1, int((2**62 // width) ** 0.5))
    keyed = keyed.withColumn("x", fixed_point("x", 1, 0, width, limit))

    def blocks(df: DataFrame, count: str, size: int) -> tuple[DataFrame, Column, Column, int]:
        """Blocks of about ``size`` rows, in numbered places of one bucket; first and last place of a bucket; number of places."""
        first, last, at = [], [], 0
        for r in told:
            many = max(1, -(-r[count] // size))
            first += [F.lit(r["bucket"]), F.lit(at)]
            last += [F.lit(r["bucket"]), F.lit(at + many - 1)]
            at += many
        first, last = (F.element_at(F.create_map(*m), F.col("bucket")) for m in (first, last))
        spread = F.pmod(F.xxhash64("id", F.spark_partition_id()), last - first + 1).cast("int")  # repeats of one id are spread too
        cut = _cut(size, chunk, chunks, width)
        return staged(df.select("bucket", (first + spread).alias("place"), "id", "code", "x").groupBy("bucket", "place").applyInPandas(cut, SLICE)), first, last, at

    all_rows, first, last, total = blocks(keyed, "n", ROWS)
    anchors, *_ = blocks(keyed.filter("anchor"), "anchors", ANCHORS)
    every = F.sequence(F.lit(0), F.lit(total - 1))
    mixed = F.col("bucket").isin([r["bucket"] for r in told if r["mixed"]])  # such a bucket meets itself again
    rest = F.when(mixed, every).otherwise(F.filter(every, lambda p: (p < first) | (p > last)))

    near = staged(_ranked(_scored(anchors.withColumn("windows", F.lit(None).cast("binary")), all_rows, F.sequence(first, last), chunk, positives).drop("positive"), ("block", "at"), positives))

    def open_windows(pdf: pd.DataFrame) -> pd.DataFrame:
        """A block's windows, int64 (anchor, positive, (there, low, high)); at and rank say whose they are."""
        size = int(pdf["size"].iloc[0])
        out = np.zeros((size, positives, 3), dtype=np.int64)
        for at, rank, score in zip(pdf["at"], pdf["rank"], pdf["score"]):
            out[at, rank - 1] = 1, -(-low * int(score) // 100), high * int(score) // 100
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "windows": [out.tobytes()]})

    sizes = anchors.filter("chunk = 0").select("block", (F.length("ids") / 8).cast("int").alias("size"))
    opened = near.join(sizes, "block").groupBy("block").applyInPandas(open_windows, "block long, windows binary")
    far = _ranked(_scored(anchors.join(opened, "block"), all_rows, rest, chunk, negatives), ("block", "at", "positive"), negatives)
    who = near.select("block", "at", (F.col("rank") - 1).alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(who, ["block", "at", "positive"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
