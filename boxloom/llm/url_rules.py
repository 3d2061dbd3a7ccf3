"""URL filtering by base rules and by mined association rules (DataFrame operations only).

A base list of (host, path) rules judges first, the longest fitting rule wins. FP-growth then mines
token combinations from labelled URLs; rules pruned by support and confidence are matched through an
inverted index (a rule is posted under its rarest token) and judge the URLs no base rule fits. Where
the labels are the base list's own verdicts, the tokens that such a rule is made of are left out of
the transactions: what they tell is the list itself, and says nothing about other URLs.
"""

from __future__ import annotations

import re

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import broadcast_if_small, staged

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with its path.
BASE_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ALLOW, BLOCK = "=allow", "=block"
MAX_RULES = 20_000


def host_of(url: str = "url") -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str = "url") -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def base_rule(host: Column, path: Column, rules=BASE_RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule (host and path together), null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: str = "url") -> Column:
    """Distinct typed tokens: host labels (h:), path segments (p:, digits as #), query keys (q:), file ending (e:)."""
    clean = lambda part, kind: F.transform(
        F.filter(part, lambda t: t != ""), lambda t: F.concat(F.lit(kind), F.regexp_replace(t, "[0-9]+", "#"))
    )
    path = path_of(url)
    query = F.coalesce(F.regexp_extract(url, "(?s)^[^?#]*\\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda t: F.regexp_extract(t, "^[^=]*", 0))
    ending = F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1)
    return F.array_distinct(F.concat(
        clean(F.split(host_of(url), "\\."), "h:"), clean(F.split(path, "/"), "p:"), clean(keys, "q:"),
        clean(F.array(ending), "e:"),
    ))


def tokens_of_rule(rule: tuple[str, str, str]) -> list[str]:
    """Host labels and path segments of a base rule, as url_tokens writes them."""
    host, path, _ = rule
    digits = lambda x: re.sub("[0-9]+", "#", x)
    return ["h:" + digits(x) for x in host.split(".") if x] + ["p:" + digits(x) for x in path.split("/") if x]


def undecided(tokens: Column, rules=BASE_RULES) -> Column:
    """tokens without those that any base rule is made of."""
    known = sorted({x for r in rules for x in tokens_of_rule(r)})
    return F.array_except(tokens, F.array(*map(F.lit, known))) if known else tokens


def mine_rules(labelled: DataFrame, support: float, confidence: float, lift: float, max_length: int) -> DataFrame:
    """labelled (tokens, bad boolean), one row a transaction -> (antecedent, verdict, confidence, support).

    FP-growth runs over the labelled transactions with the label as an item; equal ones meet in its
    trees as counts. Rules have the label alone as consequent. The support bounds the number of
    rules, not their match.
    """
    label = F.when(F.col("bad"), BLOCK).otherwise(ALLOW)
    if labelled.isEmpty():
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double")
    items = labelled.select(F.concat("tokens", F.array(label)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    return staged(
        model.associationRules
        .filter(F.element_at("consequent", 1).isin(ALLOW, BLOCK))
        .filter(~F.arrays_overlap("antecedent", F.array(F.lit(ALLOW), F.lit(BLOCK))))
        .filter((F.col("lift") >= lift) & (F.size("antecedent") <= max_length))
        .select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.element_at("consequent", 1), 2, 9).alias("verdict"), "confidence", "support")
    )


def precision(held: DataFrame, rules: DataFrame) -> DataFrame:
    """held (tokens, bad) that no rule was mined from -> (verdict, judged, right) of the mined rules."""
    rows = held.select(F.monotonically_increasing_id().alias("url"), "tokens", "bad")
    rows = staged(rows)
    return match_rules(rows, rules).join(rows.select("url", "bad"), "url").groupBy("verdict").agg(
        F.count(F.lit(1)).alias("judged"), F.count_if(F.col("bad") == (F.col("verdict") == "block")).alias("right"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, tokens) distinct -> (url, verdict, confidence) of the best rule each matches.

    Best: highest confidence, then support, then block before allow. Inverted index: a rule is
    posted under the token of its antecedent that fewest rules have.
    """
    of_rule = rules.withColumn("rule", F.monotonically_increasing_id())
    of_rule = staged(of_rule)
    token_use = of_rule.select(F.explode("antecedent").alias("token")).groupBy("token").count()
    posted = (
        of_rule.select("rule", F.explode("antecedent").alias("token")).join(token_use, "token")
        .groupBy("rule").agg(F.min(F.struct("count", "token"))["token"].alias("token"))
    )
    index = of_rule.join(posted, "rule").drop("rule")
    index = broadcast_if_small(staged(index), MAX_RULES)
    return (
        urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
        .filter(F.size(F.array_except("antecedent", "tokens")) == 0)
        .groupBy("url")
        .agg(F.max(F.struct("confidence", "support", "verdict")).alias("best"))
        .select("url", F.col("best.verdict").alias("verdict"), F.col("best.confidence").alias("confidence"))
    )


def transactions(pages: DataFrame, rules=BASE_RULES) -> DataFrame:
    """(tokens, bad, held): a row per distinct URL that a base rule fits, labelled with the rule's verdict.

    One URL in ten, by hash, is held out: rules are mined from the others.
    """
    judged = pages.filter("url is not null").select("url").distinct().withColumn("base", base_rule(host_of(), path_of(), rules))
    return judged.filter("base is not null").select(
        undecided(url_tokens(), rules).alias("tokens"), (F.col("base.verdict") == "block").alias("bad"), (F.pmod(F.xxhash64("url"), F.lit(10)) == 0).alias("held"))


def labels_of_documents(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (doc_id, quality, toxic) as (url, bad): a URL whose path ends in a document's number has its label.

    bad: poor quality or toxic; a document with several labels is bad if one says so, and one without a
    known quality is no label.
    """
    rated = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    numbered = pages.filter("url is not null").select("url", F.regexp_extract(path_of(), "/([0-9]{1,18})/?$", 1).try_cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    return numbered.join(rated, "doc_id").select("url", "bad")


def judge_urls(
    pages: DataFrame, labels: DataFrame | None = None, support: float = 0.01, confidence: float = 0.8,
    lift: float = 1.1, max_length: int = 4, rules=BASE_RULES,
) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, mined_confidence.

    labels (url, bad boolean) trains the miner; without it, the distinct URLs that a base rule fits
    are the labelled ones, the rule's verdict is their label, and they lack the tokens of base rules.
    URLs that neither a base nor a mined rule fits are allowed. A null url, or one without ://, has
    empty host and path and no tokens of them. Repeated rows are judged alike, each once, and are one
    transaction; an empty table gives no rows; null labels are left out.
    """
    judged = pages.select("page_id", "url", host_of().alias("host"), path_of().alias("path"))
    judged = judged.withColumn("base", base_rule(F.col("host"), F.col("path"), rules))
    if labels is None:
        known = transactions(pages, rules).filter("not held").select("tokens", "bad")
    else:
        known = labels.filter("url is not null and bad is not null").select("url", "bad").distinct().select(url_tokens().alias("tokens"), "bad")
    mined = mine_rules(staged(known), support, confidence, lift, max_length)
    unknown = judged.filter("base is null and url is not null").select("url").distinct().withColumn("tokens", url_tokens())
    matched = match_rules(unknown, mined).select("url", F.col("verdict").alias("mined"), F.col("confidence").alias("mined_confidence"))
    return judged.join(matched, "url", "left").select(
        "page_id", "host", "path", F.col("base.rule").alias("rule"),
        F.coalesce("base.verdict", "mined", F.lit("allow")).alias("verdict"), "mined_confidence",
    )
