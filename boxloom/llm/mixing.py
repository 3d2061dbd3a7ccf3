"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame operations only).

Every source gets a word budget; whole epochs of the source come first, the rest of the budget is a
weighted sample without replacement: key u ** (1 / w) per document, u from a hash of its id and w its
quality weight, largest keys first, sizes prefix-summed up to the budget. The prefix sum is split:
keys fall into bins, bins are summed before the shuffle, and only the documents of the one bin in
which the budget ends are sorted, after a second, finer binning; so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import WORD, broadcast_if_small, staged

#: Characters that mark junk; documents full of them weigh less.
JUNK = "[!#$%&*|]"
BINS = 1024
#: The least weight a document can have. Keys to this power lie evenly enough for equal bins, whatever the weights.
LEAST_WEIGHT = 0.1
#: Plans of up to so many sources are broadcast (about 10 MB); larger ones are joined by a shuffle.
MAX_BROADCAST = 100_000
#: Before every id in the order of ties.
NO_ID = -(2**63)


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """Between 0.1 and 1: one less four times the share of junk characters; 1 for a null or empty text."""
    share = F.regexp_count(F.col(text), F.lit(JUNK)) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(LEAST_WEIGHT), F.lit(1.0) - F.lit(4.0) * share), F.lit(1.0))


def uniform(doc_id: str, text: str, seed: int) -> Column:
    """In (0, 1), from 48 bits of an MD5, which other engines can compute as well; without an id, of the text."""
    name = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(F.col(text), F.lit(""))))), F.lit(f"/{seed}"))
    return (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size) -> with target: share of all words by weight, at most ``most`` times its size.

    The excess of capped sources goes to the others by weight until none is above, which is water
    filling: with sources in order of cap / weight, the first level that stays below its own cap
    holds for it and all that follow. The windows below run over one short row per source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    caps = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left / (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    open_ = level <= F.col("cap") / F.col("weight")
    all_rows = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = caps.withColumn("level", F.when(open_, level))
    return leveled.withColumn("first", F.first("level", ignorenulls=True).over(all_rows)).select(
        "source", "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("first") * F.col("weight"), F.col("cap").cast("double"))).alias("target"),
    )


def _cuts(pool: DataFrame, plan: DataFrame, depth: int) -> DataFrame:
    """pool (sid, key, tie, size) and plan (sid, left, cut_key, cut_tie) -> the next plan.

    Of the documents after the last cut that are no larger than left, by key downward, the longest
    run with sizes summing to left at most is taken; the new cut is its last document, and left goes
    down by its sum. Only the documents of the bin in which left ends meet in one task.
    """
    after = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("tie") > F.col("cut_tie")))
    open_ = pool.join(broadcast_if_small(plan, MAX_BROADCAST), "sid").filter((F.col("size") <= F.col("left")) & after)
    open_ = open_.select("sid", "key", "tie", "size", F.col("left").alias("rest"), F.lit(0.0).alias("lo"))
    width = 1.0
    for _ in range(depth):
        width /= BINS
        place = F.pow("key", F.lit(LEAST_WEIGHT)) - F.col("lo")
        binned = open_.withColumn("bin", F.least(F.floor(place / width), F.lit(BINS - 1)))
        down = Window.partitionBy("sid").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
        ends = (  # the bin in which rest ends; no row for a source that fits as a whole
            binned.groupBy("sid", "bin", "rest").agg(F.sum("size").alias("inside"))
            .withColumn("before", F.coalesce(F.sum("inside").over(down), F.lit(0)))
            .filter("before <= rest and before + inside > rest")
            .select("sid", "bin", (F.col("rest") - F.col("before")).alias("end_rest"))
        )
        open_ = binned.join(broadcast_if_small(staged(ends), MAX_BROADCAST), ["sid", "bin"]).select(
            "sid", "key", "tie", "size", F.col("end_rest").alias("rest"), (F.col("lo") + F.col("bin") * width).alias("lo")
        )
    ties = open_.groupBy("sid", "key", "tie").agg(F.sum("size").alias("size"), F.max("rest").alias("rest"))  # equal rows go together
    seen = ties.withColumn("upto", F.sum("size").over(Window.partitionBy("sid").orderBy(F.col("key").desc(), "tie")))
    last = seen.groupBy("sid").agg(
        F.max("rest").alias("rest"), F.max("key").alias("top"),
        F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("upto", "tie", "key"))).alias("last"),
    )
    nxt = plan.join(last, "sid", "left").select(
        "sid",
        F.when(F.col("rest").isNull(), F.lit(0)).otherwise(F.col("rest") - F.coalesce("last.upto", F.lit(0))).cast("long").alias("left"),
        # nothing in the last bin fits: the cut is before its first document
        F.when(F.col("rest").isNull(), F.lit(-1.0)).otherwise(F.coalesce("last.key", "top")).alias("cut_key"),
        F.coalesce("last.tie", F.lit(NO_ID)).alias("cut_tie"),
    )
    return staged(nxt)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 17,
    rounds: int = 3, weight: Column | None = None, depth: int = 2, extra: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (and the columns in extra).

    size: words of the text, null counts 0. Sources weigh 1, 2, 3, 1, ... by code point, null last
    (a null source is a source). taken: words the mix takes, a multiple of size: target // source_size
    whole epochs, and one copy more where the document is in the weighted sample of the rest. The
    first document that does not fit ends a round; further rounds fill what is left with later,
    smaller ones. Wordless documents and sources take 0. Rows equal in id and text tie and are taken
    or left together; a null id counts as the smallest. An empty table gives no rows.
    """
    quality = quality_weight() if weight is None else weight
    sid = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sized = docs.select("doc_id", "source", "text", *extra).select(
        "doc_id", "source", words().alias("size"), sid.alias("sid"),
        F.pow(uniform("doc_id", "text", seed), F.lit(1.0) / quality).alias("key"),
        F.coalesce("doc_id", F.lit(NO_ID + 1)).alias("tie"), *extra,
    )
    pool = staged(sized.drop("text", *extra))
    sizes = pool.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = staged(source_targets(sizes, weights, share, most).withColumn("sid", sid).withColumn("epochs", whole))
    cut = staged(plan.select(
        "sid", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long").alias("left"),
        F.lit(2.0).alias("cut_key"), F.lit(NO_ID).alias("cut_tie"),
    ))
    picked = F.lit(False)
    for k in range(rounds):
        nxt = _cuts(pool.filter("size > 0"), cut, depth)
        before = F.col("key") > F.col(f"key{k}")
        picked = picked | (F.col("size") <= F.col(f"left{k}")) & (before | (F.col("key") == F.col(f"key{k}")) & (F.col("tie") <= F.col(f"tie{k}")))
        plan = plan.join(cut.select("sid", F.col("left").alias(f"left{k}")), "sid").join(
            nxt.select("sid", F.col("cut_key").alias(f"key{k}"), F.col("cut_tie").alias(f"tie{k}")), "sid"
        )
        cut = nxt
    plan = broadcast_if_small(staged(plan.drop("source")), MAX_BROADCAST)
    return (sized if extra else pool).join(plan, "sid").select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * (F.col("epochs") + picked.cast("long"))).alias("taken"), *extra,
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of docs taken / size times, with the columns of docs and ``copy``, the repetition's number.

    Wordless documents weigh nothing in a mix and stay once. Where docs has a column copy, the new one gets underscores before it.
    """
    number = "copy"
    while number in docs.columns:
        number = "_" + number
    packed = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise((F.col("taken") / F.col("size")).cast("int"))
    mixed = mix(packed, extra=("row",), **options).withColumn("times", times).filter("times > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias(number)).select(
        *[F.col("row")[c].alias(c) for c in docs.columns], F.col(number)
    )
