"""Benchmark decontamination by templates (DataFrame operations only).

Numbers, names and units become typed slots that keep their value; what is hashed is the template.
Items and documents give a window of WINDOW words at every word, so alignment does not matter; the items' side
is the small one and is broadcast. What counts as a name depends on case and on what stands before it, so a window
with names is hashed a second time with them as plain words. Windows are
joined by hash; hits of one document and item at one offset belong together, and their slots must
map the item's values to the document's one to one: the same question with other parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import BLANKS, broadcast_if_small, drop_listed, staged

WINDOW = 5
#: Windows, none overlapping another, that must agree at one offset; of an item too short for so many, all must.
LEAST_HITS = 2
MAX_BROADCAST = 500_000
#: Private characters that open a slot: name, number, unit.
NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"
#: Unit words (fixed values).
UNITS = ("mm", "cm", "km", "mg", "kg", "ml", "percent", "dollars", "euros", "miles", "meters", "metres", "grams", "liters",
         "litres", "minutes", "hours", "days", "weeks", "months", "years", "degrees", "pounds", "inches")
#: Number words (fixed values).
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen",
                "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "dozen", "half", "twice")


def templated(text: Column) -> Column:
    """The text as single-spaced words without case and punctuation; slots are a mark and the value."""
    named = F.regexp_replace(text, "(?<=[\\p{L},;] )\\p{Lu}\\p{Ll}+(?![\\p{L}])", NAME + "$0")
    # the letters that number words begin with rule out most words before the alternatives are tried
    words = "(?<!\\p{L})(?=[" + "".join(sorted({w[0] for w in NUMBER_WORDS})) + "])(?:" + "|".join(NUMBER_WORDS) + ")(?!\\p{L})"
    numbered = F.regexp_replace(F.lower(named), "\\p{Sc}?[0-9][0-9\\p{L}.,:/%-]*|" + words, NUMBER + "$0")
    united = F.regexp_replace(numbered, "(?<![\\p{L}])(?:" + "|".join(UNITS) + ")(?![\\p{L}])", UNIT + "$0")
    bare = F.regexp_replace(united, "[^\\p{L}\\p{N}\ue001-\ue003\\x20\\x09-\\x0D]+", "")
    return F.regexp_replace(bare, BLANKS, " ")


def without_values(window: Column, size: int) -> Column:
    """The template; a window with one plain word at most says nothing without its values, and keeps them."""
    slots = F.length(window) - F.length(F.translate(window, NAME + NUMBER + UNIT, ""))
    has = window.contains(NAME) | window.contains(NUMBER) | window.contains(UNIT)
    return F.when(has, F.when(slots < size - 1, F.regexp_replace(window, "([\ue001-\ue003])[^ ]*", "$1")).otherwise(window)).otherwise(window)


def _with_plain(window: str) -> Column:
    """The window and, where it has names, its copy that takes them for plain words."""
    w = F.col(window)
    return F.explode(F.when(w.contains(NAME), F.array(w, F.translate(w, NAME, ""))).otherwise(F.array(w)))


def _slots(window: str) -> Column:
    return F.regexp_extract_all(F.col(window), F.lit("[\ue001-\ue003][^ ]*"), F.lit(0))


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    words = benchmark.select("item_id", F.filter(F.split(templated(F.col("text")), " "), lambda w: w != "").alias("words"))
    words = words.withColumn("n_words", F.size("words")).filter(F.col("n_words") >= size)
    return words.select(
        "item_id", "n_words",
        F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n_words") - size + 1), lambda i: F.array_join(F.slice("words", i, size), " "))).alias("at", "item_window"),
    ).withColumn("item_window", _with_plain("item_window")).withColumn("template", without_values(F.col("item_window"), size)).withColumn("h", F.xxhash64("template"))


def document_windows(docs: DataFrame, size: int) -> DataFrame:
    pieces = F.regexp_extract_all(templated(F.col("text")), F.lit(f"(?<![^ ])(?=([^ ]+(?: [^ ]+){{{size - 1}}}))"), F.lit(1))
    rows = docs.filter("text is not null").select("doc_id", F.posexplode(pieces).alias("no", "window"))
    return rows.withColumn("window", _with_plain("window")).withColumn("template", without_values(F.col("window"), size)).select(
        "doc_id", F.col("no").alias("doc_at"), "window", F.col("template").alias("doc_template"), F.xxhash64("template").alias("h")
    )


def _apart(places: Column, size: int) -> Column:
    """How many of the windows that begin at these places fit side by side."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
    take = lambda a, x: F.when(x >= a["last"] + size, F.struct((a["n"] + 1).alias("n"), x.alias("last"))).otherwise(a)
    return F.aggregate(F.array_sort(places), start, take, lambda a: a["n"])


def find_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, least_hits: int = LEAST_HITS) -> DataFrame:
    """One row per document and benchmark item it holds: doc_id, item_id, n_windows, n_slots, changed_slots, kind.

    Found for certain: every run of least_hits * size words of an item, and every whole item from ``size``
    words on, wherever it stands, whatever its case, punctuation and the values of its slots. An offset does not count where a value
    of the item stands for two values of the document, or two for one. kind: "verbatim" or
    "reparameterised". Null texts hold nothing; items of fewer than ``size`` words, null texts among
    them, are in no document. Items with equal text are all reported. Rows that repeat a doc_id,
    null included, are one document. An empty table on either side gives no rows.
    """
    items = broadcast_if_small(staged(item_windows(benchmark, size)), MAX_BROADCAST)
    hits = document_windows(docs, size).join(items, "h").filter("doc_template = template")
    pairs = F.arrays_zip(_slots("item_window").alias("item"), _slots("window").alias("doc"))
    hits = hits.select(
        "doc_id", "item_id", "n_words", (F.col("doc_at") - F.col("at")).alias("offset"), "at",
        F.when(F.col("window").rlike("[\ue001-\ue003]"), pairs).alias("pairs"),
    )
    aligned = hits.groupBy("doc_id", "item_id", "offset").agg(
        F.collect_set("at").alias("places"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    ).withColumn("n_windows", F.size("places").cast("long"))
    whole = F.col("n_windows") == F.col("n_words") - size + 1
    aligned = aligned.filter((_apart(F.col("places"), size) >= least_hits) | (whole & (F.col("n_words") < least_hits * size)))
    different = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    aligned = aligned.withColumn("values", different("item"))
    consistent = aligned.filter((F.col("values") == F.size("pairs")) & (different("doc") == F.size("pairs")))
    changed = F.size(F.filter("pairs", lambda p: p["item"] != p["doc"]))
    best = consistent.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("n_windows", F.col("values").alias("n_slots"), (-changed).alias("same"))).alias("best")
    )
    return best.select(
        "doc_id", "item_id", "best.n_windows", F.col("best.n_slots").cast("long").alias("n_slots"),
        (-F.col("best.same")).cast("long").alias("changed_slots"),
        F.when(F.col("best.same") == 0, "verbatim").otherwise("reparameterised").alias("kind"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no benchmark item. Rows count by id and text: a clean row stays, whatever shares its id."""
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest")).alias("doc_id"), "text")
    found = find_contaminated(rows, benchmark, **options).select("doc_id.doc_id", "doc_id.digest").distinct()
    return drop_listed(docs, staged(found.withColumn("kept", F.lit(False))), F.md5(docs.text))
