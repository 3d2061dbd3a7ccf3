"""Personal data by weak supervision (DataFrame operations only).

Four fixed kinds (email, ip, card, phone) are found by pattern and always stay. Further candidate
spans (person names, numbers with the shape of an identifier, handles) are put to labelers: a
pattern, a gazetteer, the words before and the words after, each voting yes, no or nothing.
Expectation-maximisation over the counts of vote patterns estimates every labeler's reliability; its
posteriors are the soft labels from which the final classifier of spans (naive Bayes over shape and
context features) is trained, and that classifier alone decides about candidates.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import staged

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. A run of local-part characters is entered at its start or where the last match
#: ended, and never given back, so that a very long run costs linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Without one of these there is no match; they only save time.
GUARDS = {
    "email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]",
}
NAME = r"\b\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){1,2}\b"
NUMBER = r"\b[0-9]++(?:[ .-][0-9]++){2,}+\b"
HANDLE = r"(?<![\w@.])@[A-Za-z0-9_]{3,}\b"
CANDIDATE = f"{NAME}|{NUMBER}|{HANDLE}"
#: Gazetteers and cue words (fixed values).
FIRST_NAMES = (
    "james", "mary", "john", "anna", "robert", "linda", "michael", "maria", "david", "sarah", "peter", "laura", "thomas", "julia", "paul", "sophie", "hans", "klaus", "jean", "pierre",
    "marie", "jose", "juan", "carmen", "william", "elizabeth", "richard", "jennifer", "joseph", "susan", "charles", "jessica", "daniel", "karen", "matthew", "nancy", "anthony", "lisa",
    "mark", "betty", "steven", "margaret", "andrew", "sandra", "kevin", "ashley", "brian", "emily", "george", "donna", "edward", "michelle", "ronald", "carol", "timothy", "amanda",
    "jason", "melissa", "jeffrey", "deborah", "ryan", "stephanie", "jacob", "rebecca", "gary", "sharon", "nicholas", "cynthia", "eric", "kathleen", "jonathan", "amy", "stephen",
    "angela", "larry", "helen", "justin", "brenda", "scott", "pamela", "frank", "emma", "benjamin", "nicole", "samuel", "samantha", "gregory", "katherine", "alexander", "christine",
    "wolfgang", "jürgen", "ursula", "monika", "petra", "sabine", "stefan", "andreas", "heike", "françois", "isabelle", "nathalie", "philippe", "michel", "catherine", "alain", "luis",
    "carlos", "ana", "lucia", "miguel", "antonio", "francisco", "elena", "pablo", "javier", "rosa", "pedro", "isabel",
)
COMMON_WORDS = ("the", "and", "of", "to", "in", "is", "that", "for", "it", "was", "on", "with", "as", "at", "by", "this",
                "le", "la", "les", "de", "des", "du", "et", "der", "die", "das", "und", "el", "los", "que", "en", "un")
CUES_BEFORE = ("name", "mr", "mrs", "ms", "dr", "contact", "call", "tel", "phone", "mobile", "fax", "ssn", "passport",
               "patient", "customer", "account", "signed", "user", "born", "dob")
CUES_AGAINST = ("page", "version", "chapter", "figure", "table", "section", "year", "price", "total", "item", "model", "isbn")
UNITS_AFTER = ("km", "kg", "mm", "cm", "percent", "pages", "euro", "dollars", "years", "items", "points")
LABELERS = ("pattern", "gazetteer", "before", "after")
FEATURE_BUCKETS = 1024
ACCEPT = 0.9


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once a row: inside a lambda an outer expression is worked out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: str, guard: str | None = None) -> Column:
    """array<struct<m, before, after, start, stop>> of the matches, leftmost and non-overlapping.

    start and stop count code points, stop exclusive: the pieces between matches have the offsets.
    before and after are the 30 characters around.
    """
    kind = "array<struct<m:string,before:string,after:string,start:int,stop:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def add(acc, x):
        start = acc["at"] + F.length(x["before"])
        one = F.struct(
            x["m"].alias("m"), F.right(x["before"], F.lit(30)).alias("before"), F.left(x["after"], F.lit(30)).alias("after"),
            start.alias("start"), (start + F.length(x["m"])).alias("stop"),
        )
        return F.struct((start + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def chain(acc, part):
        moved = F.transform(part["out"], lambda x: F.struct(
            x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"), (x["start"] + acc["at"]).alias("start"), (x["stop"] + acc["at"]).alias("stop")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], moved).alias("out"))

    def offsets(items):
        # appending copies the list, so it is done in parts of about the root of their number
        root = F.greatest(F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int"), F.lit(1))
        begins = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), root)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(F.transform(begins, lambda b: F.aggregate(F.slice(items, b, root), zero, add)), zero, chain, lambda acc: acc["out"])

    pieces = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("between"))
    items = _once(pieces, lambda p: F.transform(p["m"], lambda m, i: F.struct(
        m.alias("m"), F.get(p["between"], i).alias("before"), F.get(p["between"], i + 1).alias("after"))))
    return F.when(F.coalesce(text.rlike(guard or pattern), F.lit(False)), _once(items, offsets)).otherwise(F.array().cast(kind))


def _digits(m: Column) -> Column:
    return F.translate(m, " -().+", "")


def luhn(digits: Column) -> Column:
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, "\\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(13, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.transform(
        F.filter(located(text, PATTERNS[kind], GUARDS[kind]), lambda x: _valid(kind, x["m"])),
        lambda x: F.struct(F.lit(KINDS.index(kind)).alias("no"), x["start"].alias("start"), x["stop"].alias("stop")),
    )


def _has_word(text: Column, words) -> Column:
    """Whether a run of letters of the text is one of the words: a look-up a run."""
    return F.exists(F.split(F.lower(text), "[^\\p{L}]+"), lambda w: w.isin(*words))


def votes(x: Column) -> Column:
    """One digit per labeler: 2 yes, 0 no, 1 no vote."""
    m, before, after = x["m"], x["before"], x["after"]
    number = m.rlike("[0-9]")
    ballot = {
        "pattern": F.when(m.rlike("^([0-9]{3}-[0-9]{2}-[0-9]{4}|@.*)$"), "2").when(m.rlike("^[0-9]{1,2}[.-][0-9]{1,2}[.-]([0-9]{2}){1,2}$"), "0"),
        "gazetteer": F.when(_has_word(m, FIRST_NAMES), "2").when(~number & _has_word(m, COMMON_WORDS), "0"),
        "before": F.when(before.rlike("(?i)(?<![\\p{L}])(?:" + "|".join(CUES_BEFORE) + ")[^\\p{L}\\n]{0,4}(?:is |no )?$"), "2")
        .when(before.rlike("(?i)(?<![\\p{L}])(?:" + "|".join(CUES_AGAINST) + ")[^\\p{L}\\n]{0,4}$"), "0")
        .when(~number & before.rlike("(^|[.!?\\n])[^\\p{L}]*$"), "0"),
        "after": F.when(after.rlike("^ ?(?:" + "|".join(UNITS_AFTER) + "|%)"), "0").when(after.rlike("^,? (?i:born|lives|said|wrote|ext)"), "2"),
    }
    return F.concat(*[F.coalesce(ballot[name], F.lit("1")) for name in LABELERS])


def features(x: Column) -> Column:
    """Distinct hashed features: collapsed shape, length, the last word before, the first word after."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(x["m"], "\\p{Lu}\\p{Ll}+", "A"), "[0-9]", "9"), "\\p{Ll}+", "a")
    word = lambda c, at: F.lower(F.regexp_extract(c, at, 1))
    named = F.array(
        F.concat(F.lit("s:"), shape), F.concat(F.lit("n:"), F.least(F.length(x["m"]), F.lit(40)).cast("string")),
        F.concat(F.lit("b:"), word(x["before"], "([\\p{L}]+)[^\\p{L}]*$")), F.concat(F.lit("a:"), word(x["after"], "^[^\\p{L}]*([\\p{L}]+)")),
        F.concat(F.lit("e:"), F.regexp_extract(x["before"], "([.!?\\n]?)[^.!?\\n\\p{L}]*$", 1)),
        F.concat(F.lit("g:"), _has_word(x["m"], FIRST_NAMES).cast("string")),
        F.concat(F.lit("c:"), x["before"].rlike("(?i)(?<![\\p{L}])(?:" + "|".join(CUES_BEFORE) + ")[^\\p{L}\\n]{0,4}(?:is |no )?$").cast("string")),
    )
    return F.array_distinct(F.transform(named, lambda f: F.pmod(F.xxhash64(f), F.lit(FEATURE_BUCKETS)).cast("int")))


def estimate(patterns: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """EM over vote patterns with counts (at most 3 ** labelers of them) -> pattern: probability of yes.

    Labelers are independent given the truth, each with its own chances of every vote; the start
    trusts majorities. Patterns without any vote get the prior and cannot move a reliability.
    """
    lead = {p: sum(int(v) - 1 for v in p) for p in patterns}
    belief = {p: 0.9 if lead[p] > 0 else 0.1 if lead[p] < 0 else 0.2 for p in patterns}
    for _ in range(rounds):
        yes, total = sum(patterns[p] * belief[p] for p in patterns), sum(patterns.values())
        prior = (yes + 1) / (total + 5)
        rate = {}
        for k in range(len(LABELERS)):
            for v in "012":
                of = [p for p in patterns if p[k] == v]
                a, b = sum(patterns[p] * belief[p] for p in of), sum(patterns[p] * (1 - belief[p]) for p in of)
                # the smoothing says that a vote is more often right than wrong
                rate[k, v] = math.log((a + (2 if v == "2" else 1)) / (yes + 4)) - math.log((b + (2 if v == "0" else 1)) / (total - yes + 4))
        odds = {p: math.log(prior / (1 - prior)) + sum(rate[k, v] for k, v in enumerate(p) if v != "1") for p in patterns}
        belief = {p: 1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for p, o in odds.items()}
    return belief


def train(spans: DataFrame) -> tuple[dict[str, float], dict[int, float], float]:
    """spans (votes, features) -> (belief by vote pattern, log-odds by feature, prior log-odds).

    spans is read twice. What reaches the driver is bounded: 81 patterns, FEATURE_BUCKETS features.
    """
    counts = {r["votes"]: r["n"] for r in spans.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    belief = estimate(counts)
    if not counts:
        return {}, {}, -30.0
    chance = F.create_map(*[F.lit(x) for kv in sorted(belief.items()) for x in kv])
    soft = spans.filter("votes <> '" + "1" * len(LABELERS) + "'").withColumn("p", F.element_at(chance, F.col("votes")))
    sums = soft.select("p", F.explode("features").alias("f")).groupBy("f").agg(
        F.round(F.sum("p"), 6).alias("yes"), F.round(F.sum(1 - F.col("p")), 6).alias("no")).collect()
    told = {p: n for p, n in counts.items() if set(p) != {"1"}}
    yes, no = sum(n * belief[p] for p, n in told.items()), sum(n * (1 - belief[p]) for p, n in told.items())
    weights = {r["f"]: math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1)) for r in sums}
    return belief, weights, math.log((yes + 0.5) / (no + 2))


def find_pii(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more.

    Spans are kind:start:end in code points, end exclusive. Base spans come by kind, then start, and
    stay whatever the classifier says; accepted candidates that overlap none follow as kind "more".
    A null text counts as empty: no spans, empty strings. Repeated rows and null ids are judged by
    their text alone; an empty table gives no rows, and so trains nothing.
    """
    text = F.coalesce("text", F.lit(""))
    based = docs.select("doc_id", *[base_spans(text, k).alias(k) for k in KINDS], located(text, CANDIDATE).alias("maybe"))
    based = based.withColumn("base", F.concat(*KINDS))
    free = F.filter("maybe", lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    judged = F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), votes(x).alias("votes"), features(x).alias("features")))
    # texts are read once: what both the training and the decision need of them is a few numbers a candidate
    found = staged(based.select("doc_id", *KINDS, "base", judged.alias("open")))
    _, weights, prior = train(found.select(F.explode("open").alias("x")).select("x.votes", "x.features"))
    limit = math.log(accept / (1 - accept))
    if weights:
        table = F.lit([float(weights.get(k, 0.0)) for k in range(FEATURE_BUCKETS)])
        score = lambda x: F.aggregate(x["features"], F.lit(prior), lambda a, f: a + F.element_at(table, f + 1))
        more = F.transform(F.filter("open", lambda x: score(x) >= limit), lambda x: F.struct(F.lit(len(KINDS)).alias("no"), x["start"].alias("start"), x["stop"].alias("stop")))
    else:
        more = F.array().cast("array<struct<no:int,start:int,stop:int>>")
    names = F.array(*[F.lit(k) for k in (*KINDS, "more")])
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["no"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return found.withColumn("extra", more).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.concat("base", "extra")).alias("spans"),
        F.size("extra").cast("long").alias("n_more"),
    )
