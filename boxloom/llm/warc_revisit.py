"""Resolution of not-modified revisits in web archives.

A revisit (status 304) stands for the payload of an earlier full response. It is resolved by an
as-of join: the latest full response before it under the same canonical URL. The validators are
checked and the headers a 304 may update are merged over the stored ones. The as-of join is split
by time: within a (URL, time slice) a window carries the latest response forward, and what a slice
starts with comes from a window over one pre-aggregated row per slice; a URL with very many
captures is spread over its slices. Payloads are never moved, only their record ids. Revisits of the
other kind, that state their payload's digest, are resolved by the record they refer to or by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Headers that describe the stored payload; a 304 does not change them.
FIXED_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding", "trailer")
#: Query keys that do not select a resource.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host lower-cased without www. and default port, no scheme or fragment, tracking keys dropped,
    the other query parts sorted, no / or index.html at the end. Null for null; without :// the
    whole is taken as host and path."""
    rest = F.regexp_replace(F.regexp_replace(url, "(?s)#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "(?s)^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_extract(rest, "(?s)^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "/index\\.html?$", "/"), "/+$", "")
    query = F.split(F.regexp_extract(rest, "(?s)\\?(.*)$", 1), "&")
    parts = F.array_sort(F.filter(query, lambda t: (t != "") & ~F.coalesce(t.rlike(TRACKING), F.lit(False))))
    return F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(F.lit("")))


def as_of_latest(rows: DataFrame, key: str, order: tuple[str, str], payload: str, slice_of: Column) -> DataFrame:
    """rows with ``payload`` replaced by the latest non-null payload of an earlier row of the same key.

    Rows are ordered by the two columns ``order``; slice_of maps them to a slice without changing their order.
    """
    rows = rows.withColumn("slice", slice_of)
    at = F.when(F.col(payload).isNotNull(), F.struct(*order))
    ends = rows.groupBy(key, "slice").agg(F.max_by(payload, at).alias("end"))
    carried = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(key, "slice", F.last("end", ignorenulls=True).over(carried).alias("start"))
    inside = Window.partitionBy(key, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn(payload, F.last(payload, ignorenulls=True).over(inside))
        .join(starts, [key, "slice"], "left")
        .withColumn(payload, F.coalesce(payload, "start")).drop("slice", "start")
    )


def _folded(entries: Column) -> Column:
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    joined = lambda k: F.array_join(F.array_sort(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == k), lambda e: e["value"])), ", ")
    return F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("key"), joined(k).alias("value"))))


def folded_headers(headers: Column) -> Column:
    """Names lower-cased; values of names that are then equal are joined by a comma, as HTTP reads them, sorted, as a map has no order."""
    return _folded(F.map_entries(headers))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of WARC 1.x files as resolve takes them: record_id, url, ts, status, etag, last_modified, headers,
    payload_sha256, warc_type, profile, refers_to.

    Records are cut at their version line, which splits uncompressed files like any text. A file that ends in .gz, a
    member a record or one in all, is read by one task. What has no WARC-Type after such a line is a payload's own
    text and is left out. payload_sha256 is the digest the record states, in the form it states it; payloads
    themselves are not read.
    """
    raw = spark.read.text(path, lineSep="WARC/1.").filter(F.col("value").rlike("^[0-9]+\r?\n"))
    head = F.substring_index("value", "\r\n\r\n", 1)
    block = F.substring("value", F.length(head) + 5, F.length("value"))
    cut = raw.select(head.alias("head"), F.substring_index(block, "\r\n\r\n", 1).alias("http"))
    field = lambda of, name: F.regexp_extract(of, f"(?im)^{name}:[ \\t]*(.*?)[ \\t]*\\r?$", 1)
    some = lambda c: F.when(c != "", c)
    lines = F.filter(F.slice(F.split("http", "\r\n"), F.lit(2), F.size(F.split("http", "\r\n"))), lambda x: x.rlike("^[^:\\s]+:"))
    entries = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "^([^:]+):", 1).alias("key"), F.regexp_extract(x, "^[^:]+:[ \\t]*(.*?)[ \\t]*$", 1).alias("value")))
    kept = cut.withColumn("warc_type", F.lower(field("head", "WARC-Type"))).filter(F.col("warc_type").isin("response", "revisit"))
    return kept.select(
        some(field("head", "WARC-Record-ID")).alias("record_id"), some(field("head", "WARC-Target-URI")).alias("url"), F.try_to_timestamp(field("head", "WARC-Date")).alias("ts"),
        F.regexp_extract("http", "^HTTP/[0-9.]+ ([0-9]{3})", 1).try_cast("int").alias("status"), some(field("http", "ETag")).alias("etag"),
        some(field("http", "Last-Modified")).alias("last_modified"), _folded(entries).alias("headers"), some(field("head", "WARC-Payload-Digest")).alias("payload_sha256"),
        "warc_type", some(field("head", "WARC-Profile")).alias("profile"), some(field("head", "WARC-Refers-To")).alias("refers_to"))


def _slice(rows: DataFrame, seconds: int) -> Column:
    """Of a row: its time's slice; rows without a time have one and the same, and are split by record id, in which they are ordered."""
    text = rows.schema["record_id"].dataType.typeName() == "string"
    part = F.left("record_id", F.lit(16)) if text else F.floor(F.col("record_id") / 65_536)
    return F.struct(F.floor(F.coalesce(F.unix_seconds("ts"), F.lit(-(2**40))) / seconds).alias("time"), F.when(F.col("ts").isNull(), part).alias("id"))


def resolve_copies(copies: DataFrame, responses: DataFrame, slice_seconds: int) -> DataFrame:
    """Revisits that state their payload's digest, with the full response they stand for as ``base`` (null if there is none).

    That is the response they refer to, or else the latest earlier one of the same digest under any URL.
    """
    known = responses.join(copies.select(F.col("refers_to").alias("record_id")).distinct(), "record_id", "left_semi")
    known = known.groupBy(F.col("record_id").alias("refers_to")).agg(F.max_by("base", F.struct(F.col("ts").isNotNull(), "ts")).alias("base"))
    told = copies.drop("base").join(known, "refers_to", "left").select(*copies.columns)  # a response with very many copies: AQE splits their side
    open_ = told.filter("base is null")
    by_digest = responses.withColumn("copy", F.lit(False)).unionByName(open_.withColumn("copy", F.lit(True))).filter("payload_sha256 is not null")
    found = as_of_latest(by_digest, "payload_sha256", ("ts", "record_id"), "base", _slice(by_digest, slice_seconds)).filter("copy").drop("copy")
    return told.filter("base is not null").unionByName(found).unionByName(open_.filter("payload_sha256 is null"))


def resolve(records: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """records (record_id, url, ts, status, etag, last_modified, headers map, payload_sha256, and if known warc_type, profile,
    refers_to) -> one row each.

    Adds canonical, base_id, outcome, resolved_sha256 and merged (header names lower-cased). outcome:
    "full" (status 200 and not a revisit; its own base), "resolved" (304 whose validators agree with the
    base's), "changed" (a validator or a digest differs), "unchecked" (neither side shares a validator: not
    resolved), "duplicate" (a revisit of the profile identical-payload-digest, whatever its URL and status, whose
    payload is that of the base it refers to or, without one, of the latest earlier full response of its
    digest; its own headers stand over the base's), "no_base" (no such full response, or a null url),
    "other" (any other status or none). Rows with equal time are ordered by record id; a null time comes
    first. Repeated rows are resolved alike, and never by their own repetition, since only a full response is a base.
    """
    stated = [F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in ("warc_type", "profile", "refers_to")]
    rows = records.select(
        "record_id", "url", "ts", "status", "etag", "last_modified", "payload_sha256", *stated,
        folded_headers(F.col("headers")).alias("headers"), canonical_url(F.col("url")).alias("canonical"),
    )
    revisit = F.coalesce(F.lower("warc_type") == "revisit", F.lit(False))
    copy = revisit & F.coalesce(F.lower("profile").rlike("identical-payload-digest/?$"), F.lit(False))
    full = F.coalesce(F.col("status") == 200, F.lit(False)) & ~revisit
    rows = rows.withColumn("base", F.when(full, F.struct("record_id", "etag", "last_modified", "headers", "payload_sha256")))
    plain = rows.filter(~copy)
    dated = plain.filter("canonical is not null")
    known = as_of_latest(dated, "canonical", ("ts", "record_id"), "base", _slice(dated, slice_seconds))
    rest = plain.filter("canonical is null").withColumn("base", F.when(F.lit(False), F.col("base")))
    found = known.unionByName(rest)
    if {"warc_type", "profile"} <= set(records.columns):
        found = found.unionByName(resolve_copies(rows.filter(copy), rows.filter(full), slice_seconds))
    by_etag = F.col("etag").isNotNull() & F.col("base.etag").isNotNull()
    by_time = F.col("last_modified").isNotNull() & F.col("base.last_modified").isNotNull()
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    outcome = (
        F.when(full, "full")
        .when(copy, F.when(F.col("base").isNull(), "no_base").when(F.col("payload_sha256") != F.col("base.payload_sha256"), "changed").otherwise("duplicate"))
        .when(F.coalesce(F.col("status") != 304, F.lit(True)), "other")
        .when(F.col("base").isNull(), "no_base")
        .when(by_etag, F.when(weak(F.col("etag")) == weak(F.col("base.etag")), "resolved").otherwise("changed"))
        .when(by_time, F.when(F.col("last_modified") == F.col("base.last_modified"), "resolved").otherwise("changed"))
        .otherwise("unchecked")
    )
    updates = F.when(copy, F.col("headers")).otherwise(F.map_filter("headers", lambda k, _: ~k.isin(*FIXED_HEADERS)))
    kept = F.map_filter("base.headers", lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(updates), k), F.lit(False)))
    done = found.withColumn("outcome", outcome)
    resolved = F.col("outcome").isin("resolved", "duplicate")
    return done.select(
        "record_id", "canonical", "outcome",
        F.when(full, F.col("record_id")).when(resolved, F.col("base.record_id")).alias("base_id"),
        F.when(full, F.col("payload_sha256")).when(resolved, F.coalesce("base.payload_sha256", F.when(copy, F.col("payload_sha256")))).alias("resolved_sha256"),
        F.when(full, F.col("headers")).when(resolved, F.map_concat(kept, updates)).alias("merged"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """pages seen as captures: the page id is the record id and, in minutes, the time.

    By a digest of the id three captures in eight are revisits without payload. A site's entity tag
    and date change every 2**14 minutes; half the captures carry a tag, half a date.
    """
    nibble = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 1), 16, 10).cast("int")
    version = F.floor(F.col("page_id") / 16384).cast("string")
    site = canonical_url(F.col("url"))
    etag = F.when(nibble % 4 != 3, F.concat(F.lit('"'), F.substring(F.md5(F.concat(site, version)), 1, 8), F.lit('"')))
    modified = F.when(nibble % 4 != 1, F.concat(F.lit("version "), version))
    status = F.when(nibble < 6, 304).otherwise(200)
    present = F.filter(F.array(
        F.struct(F.lit("ETag").alias("k"), etag.alias("v")),
        F.struct(F.lit("Last-Modified").alias("k"), modified.alias("v")),
        F.struct(F.lit("Date").alias("k"), F.col("page_id").cast("string").alias("v")),
        F.struct(F.lit("Content-Length").alias("k"), F.when(status == 200, F.length("html")).otherwise(0).cast("string").alias("v")),
    ), lambda e: e["v"].isNotNull())
    return pages.select(
        F.col("page_id").alias("record_id"), "url", F.timestamp_seconds(F.col("page_id") * 60).alias("ts"),
        status.alias("status"), etag.alias("etag"), modified.alias("last_modified"),
        F.map_from_entries(present).alias("headers"), F.when(status == 200, F.sha2("html", 256)).alias("payload_sha256"),
    )
