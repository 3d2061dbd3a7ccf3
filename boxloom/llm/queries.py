"""Driver queries of this subpackage and their SQL."""

from __future__ import annotations

from boxloom.llm import (
    decontaminate, exact_dedup, hard_negatives, jaccard_join, lm_score, mixing, near_vectors, pii, quality, secret_scan, url_rules, vectors, warc_revisit, whitening,
)
from pyspark.sql import functions as F

from boxloom.llm.common import table


def op1_decontaminate(spark, sf_dir):
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_rules(spark, sf_dir):
    """The miner's labels are those of the documents that the URLs name by number."""
    pages = table(spark, sf_dir, "pages")
    return url_rules.judge_urls(pages, url_rules.labels_of_documents(pages, table(spark, sf_dir, "labels")))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_warc_revisit(spark, sf_dir):
    """merged as one string of name=value, sorted by name, so that the rows can be hashed."""
    done = warc_revisit.resolve(warc_revisit.captures(table(spark, sf_dir, "pages")))
    pairs = F.array_sort(F.transform(F.map_entries("merged"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return done.withColumn("merged", F.array_join(pairs, "; "))


def op3_pii(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark, sf_dir):
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, quality.table_ratings(spark, sf_dir)))
    return scored.withColumn("kept", F.col("tail_good") >= quality.LEAST_TAIL)


def op8_jaccard_join(spark, sf_dir):
    return jaccard_join.similarity_classes(table(spark, sf_dir, "documents"))


def op10_lm_score(spark, sf_dir):
    return lm_score.score(table(spark, sf_dir, "documents"))


def _longest(rows):
    return rows.agg(F.max(F.size("embedding"))).first()[0] or 0


def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").filter(vectors.usable("embedding") & F.col("label").isNotNull())
    width, turned = _longest(rows), F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    x = vectors.fixed_point("embedding", 256, 0, width, 2**31 - 1)
    return hard_negatives.mine(rows.select("vec_id", turned.alias("label"), x.alias("x")), F.col("vec_id") % 100 == 0, width=width)


def op12_whitening(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").filter(vectors.usable("embedding"))
    width = _longest(rows)
    return whitening.whiten(rows.select("vec_id", vectors.fixed_point("embedding", 1024, 100_000, width, 2**40).alias("x")), "x", width)


def op13_near_vectors(spark, sf_dir):
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql():
    from boxloom.llm.oracle import ORACLE

    return dict(ORACLE)
