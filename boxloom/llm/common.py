"""Shared pieces: table access, shared-folder staging, size-checked broadcast, id filters, components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII blanks.
WORD = "[^\\x20\\x09-\\x0D]+"
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Bits of one bitmap of Spark's bitmap functions, and the most bits of a filter (16 MB).
BITMAP_BITS = 32768
MAX_FILTER_BITS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a private one only where that is unset on a local master (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return sc.getCheckpointDir()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """Python workers get texts in batches of at most so many rows meanwhile, which bounds their memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and rereads it.

    A lost executor costs nothing then: the files belong to no executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of tables from ``staged`` that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hints a broadcast only if a count proves at most max_rows rows; beyond that the planner shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def drop_listed(docs: DataFrame, listed: DataFrame, digest: Column, max_rows: int = 250_000) -> DataFrame:
    """docs without the rows that listed (doc_id, digest, kept) names; where it says kept, one of the rows it names stays.

    digest is that of docs' rows. Rows are named by id and digest, so an id that unlike rows share harms none of
    them. Only repeated rows that stay once are shuffled, unless the list is too long to broadcast.
    """
    def named(rows: DataFrame):
        rows = broadcast_if_small(rows.select(F.col("doc_id").alias("of"), F.col("digest").alias("of_digest")), max_rows)
        return rows, docs.doc_id.cast("long").eqNullSafe(rows["of"]) & digest.eqNullSafe(rows["of_digest"])

    left = docs.join(*named(listed), "left_anti")
    if listed.filter("kept").isEmpty():
        return left
    again = docs.join(*named(listed.filter("kept")), "left_semi")
    keys = F.col("doc_id"), F.coalesce("text", F.lit(""))
    picked = again.groupBy(*[k.alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.first(F.struct(*docs.columns)).alias("_row"))
    return left.unionByName(picked.select(*[F.col("_row")[c].alias(c) for c in docs.columns]))


def id_filter(ids: DataFrame, column: str, count: int) -> np.ndarray:
    """Bytes of a bitmap over the non-null ids, about eight bits an id up to MAX_FILTER_BITS; see may_hold."""
    buckets = max(1, min(MAX_FILTER_BITS, 8 * count) // BITMAP_BITS + 1)
    slot = F.pmod(F.col(column), F.lit(buckets * BITMAP_BITS))
    maps = ids.filter(F.col(column).isNotNull()).groupBy(F.floor(slot / BITMAP_BITS).alias("bucket")).agg(
        F.bitmap_construct_agg(slot % BITMAP_BITS).alias("bits")).collect()
    out = np.zeros((buckets, BITMAP_BITS // 8), dtype=np.uint8)
    for r in maps:
        out[r["bucket"]] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out.ravel()


def as_text(column: str) -> Column:
    """A column of ids for Python workers: a batch with nulls would take long ids for floats and lose digits."""
    return F.col(column).cast("long").cast("string").alias(column)


def may_hold(bits: np.ndarray, ids) -> np.ndarray:
    """For a pandas column of ids as text: false proves that an id was not given to id_filter; null always may be."""
    at = ids.fillna("0").astype(np.int64).to_numpy() % (len(bits) * 8)
    return (((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1) == 1) | ids.isna().to_numpy()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) edges -> (node, root) for every node of an edge; root is equal within a component.

    Star contraction: every node moves to the smallest node within two steps, edges are relabelled,
    loops and repeats go, until no edge is left; then the moves are composed backwards. Node ids
    should be hashes, which makes the expected number of rounds logarithmic. Each round pre-aggregates
    before its shuffle, so a node with very many neighbours is no hot group; staging cuts the lineage.
    """
    edges = staged(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    )
    moves = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")).select("b", F.least("b", "m").alias("m"))
        move = staged(both.join(near, "b").groupBy(F.col("a").alias("node")).agg(F.min("m").alias("root")))
        moves.append(move)
        to_a = move.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = move.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        past, edges = edges, staged(
            edges.join(to_a, "a").join(to_b, "b")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .filter("a <> b").distinct()
        )
        discard(past)
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = moves.pop()
    for move in reversed(moves):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("later"))
        past, found = found, staged(move.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root")))
        discard(past, move)
    return found
