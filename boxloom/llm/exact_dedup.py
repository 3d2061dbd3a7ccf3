"""Exact duplicates by a log-structured merge index (DataFrame operations only).

Documents are dealt to memtables; each flushes one run of (digest, surviving id, count), sorted by
digest, with a bitmap filter of its own. An entry goes into compaction only if it was repeated within
its run or another run's filter may hold its digest. Compaction merges ``fan_in`` runs at a time,
keeping one id per digest, until a single run is left. A filter over that run's repeated digests
tells, without a shuffle, which documents can have a copy; only those hits carry their text onward,
and grouping by the text's own bytes verifies them, so a digest collision can never merge two texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import BITMAP_BITS, MAX_FILTER_BITS, broadcast_if_small, discard, drop_listed, staged

#: A group that holds more than one part in HEAVY of all copies is joined by broadcast: its documents
#: would meet in one task otherwise, and there are fewer than HEAVY such groups at any size.
HEAVY = 2000
MAX_BUCKETS = MAX_FILTER_BITS // BITMAP_BITS


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _smallest_or_largest(keep: str):
    return {"max": F.max, "min": F.min}[keep]


def flush(entries: DataFrame, memtables: int, keep: str) -> DataFrame:
    """(digest, doc_id) -> the level-0 runs (run, digest, keep_id, n); map-side combined, so no digest is hot."""
    best = _smallest_or_largest(keep)
    return staged(
        entries.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(memtables)).alias("run"), "digest")
        .agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        .sortWithinPartitions("run", "digest")
    )


def _slot(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets * BITMAP_BITS))


def _bit(bits: Column, pos: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (pos % 8).cast("int")) == 1, F.lit(False))


def run_filters(runs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, runs: array of struct(run, bits)): ``buckets`` bitmaps a run."""
    slot = _slot(buckets)
    each = runs.groupBy("run", F.floor(slot / BITMAP_BITS).alias("bucket")).agg(F.bitmap_construct_agg(slot % BITMAP_BITS).alias("bits"))
    return each.groupBy("bucket").agg(F.collect_list(F.struct("run", "bits")).alias("runs"))


def maybe_repeated(runs: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The entries that are repeated within their run, or whose digest another run's filter may hold."""
    slot = _slot(buckets)
    own, pos = F.col("run"), slot % BITMAP_BITS
    elsewhere = F.exists(F.col("runs"), lambda x: (x["run"] != own) & _bit(x["bits"], pos))
    # at most memtables * buckets bitmaps, MAX_BUCKETS in all
    return runs.withColumn("bucket", F.floor(slot / BITMAP_BITS)).join(F.broadcast(filters), "bucket").filter((F.col("n") > 1) | elsewhere).drop("bucket", "runs")


def compact(runs: DataFrame, memtables: int, fan_in: int, keep: str) -> DataFrame:
    """Merges fan_in runs into one, level by level, until one run (digest, keep_id, n) is left."""
    best = _smallest_or_largest(keep)
    left = memtables
    while left > 1:
        left = -(-left // fan_in)
        runs = staged(
            runs.groupBy(F.floor(F.col("run") / fan_in).alias("run"), "digest")
            .agg(best("keep_id").alias("keep_id"), F.sum("n").alias("n"))
            .sortWithinPartitions("run", "digest")
        )
    return runs.drop("run")


def build_filter(run: DataFrame, buckets: int) -> DataFrame:
    """(bucket, bits): at most ``buckets`` rows of 4 KB, whatever the number of digests."""
    slot = _slot(buckets)
    return (
        run.groupBy(F.floor(slot / BITMAP_BITS).alias("bucket"))
        .agg(F.bitmap_construct_agg(slot % BITMAP_BITS).alias("bits"))
    )


def filter_hits(docs: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """docs with a column ``hit``: false proves that the digest is not in the filtered run."""
    slot = _slot(buckets)
    return (
        docs.withColumn("bucket", F.floor(slot / BITMAP_BITS))
        .join(F.broadcast(filters), "bucket", "left")  # at most max_buckets rows of 4 KB
        .withColumn("hit", _bit(F.col("bits"), slot % BITMAP_BITS)).drop("bucket", "bits")
    )


def exact_groups(
    docs: DataFrame, keep: str = "max", memtables: int = 16, fan_in: int = 4, max_buckets: int = MAX_BUCKETS, digest=sha256_digest,
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. ``keep``: the row with the
    largest ("max") or smallest ("min") doc_id of a group stays. A null doc_id loses against any
    other; a group of only null ids has keep_id null and kept true. Rows that repeat both doc_id and
    text are one document: each says the same. An empty table gives an empty result; further columns
    of docs are ignored. Filters have a bit per 1/8 of a digest up to max_buckets bitmaps (16 MB);
    beyond that they let more documents through, never fewer.
    """
    best = _smallest_or_largest(keep)
    text = F.coalesce("text", F.lit(""))
    runs = flush(docs.select("doc_id", digest(text).alias("digest")), memtables, keep)
    per_run = max(1, min(max_buckets // memtables, -(-8 * runs.count() // (memtables * BITMAP_BITS))))
    open_ = maybe_repeated(runs, run_filters(runs, per_run), per_run)
    run = staged(compact(open_, memtables, fan_in, keep).filter("n > 1"))
    discard(runs)
    buckets = max(1, min(max_buckets, -(-8 * run.count() // BITMAP_BITS)))
    filters = build_filter(run, buckets)

    full = docs.select("doc_id", text.alias("text"), digest(text).alias("digest"), F.sha2(text, 256).alias("sha"))
    hits = filter_hits(full.select("doc_id", "text", "digest"), filters, buckets).filter("hit")
    groups = staged(  # the texts themselves are the key: byte verification, combined before the shuffle
        hits.groupBy("digest", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        .select("digest", "keep_id", "n", F.col("text").alias("only"))
    )
    shared = groups.groupBy("digest").count().filter("count > 1").select("digest")  # digests of several texts; as good as always empty
    shared = broadcast_if_small(staged(shared), max_buckets)
    plain = groups.join(shared, "digest", "left_anti").filter("n > 1").select("digest", "keep_id", "n")
    index = staged(plain)
    # groups of more than 1 / HEAVY of all copies: fewer than HEAVY rows
    copies = index.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(index.filter(F.col("n") > copies / HEAVY))
    light = index.filter(F.col("n") <= copies / HEAVY)

    said = ("doc_id", F.when(F.col("n").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), "sha")
    marked = filter_hits(full, filters, buckets)
    alone = marked.filter("not hit").withColumn("n", F.lit(None).cast("long")).withColumn("keep_id", F.lit(None).cast(dict(full.dtypes)["doc_id"])).select(*said)
    hit = marked.filter("hit")
    twice = hit.join(shared, "digest", "left_semi")
    hit = hit.join(shared, "digest", "left_anti").select("doc_id", "digest", "sha")  # no text: its digest stands for it
    many = hit.join(heavy, "digest").select(*said)
    few = hit.join(heavy, "digest", "left_anti").join(light, "digest", "left").select(*said)
    by_text = groups.join(shared, "digest", "left_semi").select("digest", F.col("only").alias("text"), "keep_id", "n")
    told = twice.join(by_text, ["digest", "text"], "left").select(*said)
    return alone.unionByName(many).unionByName(few).unionByName(told).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, each document once, with the columns of docs.

    What goes is listed by doc_id and digest; texts are not moved for it, but for repeated rows that stay once.
    """
    found = exact_groups(docs, **options).groupBy("doc_id", F.col("text_sha256").alias("digest"), "kept").agg(F.count(F.lit(1)).alias("times"))
    listed = staged(found.filter("not kept or times > 1").select("doc_id", "digest", "kept"))
    return drop_listed(docs, listed, F.sha2(F.coalesce(docs.text, F.lit("")), 256))
