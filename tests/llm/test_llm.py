"""The ten operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxloom.llm import (
    decontaminate, exact_dedup, hashing, jaccard_join, lm_score, mixing, pii, quality, secret_scan, url_rules, warc_revisit,
)
from boxloom.llm.common import connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long, digest string, n long, row string, size long, sid string"
WORDS = [f"w{k}" for k in range(400)]


def documents(spark, texts, sources=None):
    """Columns that operators use internally are there too, as clashing extras."""
    rows = [(i, t, None, (sources or ["a"] * len(texts))[k], None, "d", 1, "r", 5, "s") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 120))) for _ in range(n)]
    for t in texts[:15]:
        words = t.split()
        for _ in range(2):
            w = list(words)
            w[rng.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), "", " \n\t", None, None, "one", "One", "x y", " ".join(rng.choices(WORDS, k=9000))]
    return list(enumerate(texts))


EDGE = [*corpus(), (3, corpus()[3][1]), (None, "one"), (None, None)]


def sets_of(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def components(texts, n, percent):
    sets = [sets_of(t, n) for _, t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    low = {}
    for k, (i, _) in enumerate(texts):
        low.setdefault(top(k), []).append(i)
    first = {k: min((i for i in v if i is not None), default=None) for k, v in low.items()}
    return [(texts[k][0], len(sets[k]), first[top(k)] if sets[k] else texts[k][0]) for k in range(len(texts))]


key = lambda r: tuple((x is not None, str(x)) for x in r)


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (2, 50)])
def test_jaccard_brute_force(spark, n, percent):
    got = [tuple(r) for r in jaccard_join.similarity_classes(documents(spark, EDGE), n, percent, unit=8, max_hot=3).collect()]
    assert sorted(got, key=key) == sorted(components(EDGE, n, percent), key=key)


def test_jaccard_large_group_in_blocks(spark):
    rng = random.Random(4)
    base = rng.choices(WORDS, k=60)
    texts = []
    for k in range(120):
        w = list(base[: rng.randint(40, 60)])
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(6)}"
        texts.append((k, " ".join(w)))
    got = [tuple(r) for r in jaccard_join.similarity_classes(documents(spark, texts), unit=8).collect()]
    assert sorted(got) == sorted(components(texts, 4, 85))


def test_jaccard_keep_one_and_empty(spark):
    docs = documents(spark, corpus())
    want = {c for _, _, c in components(corpus(), 5, 80)}
    assert {r["doc_id"] for r in jaccard_join.keep_one(docs, ngram=5, percent=80).collect()} == want
    assert jaccard_join.similarity_classes(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    up = list(range(2000))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[top(a)] = top(b)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n for e in edges if e[0] != e[1] for n in e} == set(got)
    assert len({(top(n), r) for n, r in got.items()}) == len({top(n) for n in got}) == len(set(got.values()))


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(spark, weak, keep):
    digest = (lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2))) if weak else exact_dedup.sha256_digest  # collisions
    got = [tuple(r) for r in exact_dedup.exact_groups(documents(spark, EDGE), keep=keep, digest=digest, memtables=5, fan_in=2).collect()]
    groups = collections.defaultdict(list)
    for i, t in EDGE:
        groups[t or ""].append(i)
    best = {t: {"max": max, "min": min}[keep]((i for i in v if i is not None), default=None) for t, v in groups.items()}
    want = [(i, best[t or ""], len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in EDGE]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_exact_dedup_stage(spark):
    docs = documents(spark, EDGE)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(kept.toPandas()["text"].fillna("")) == sorted({t or "" for _, t in EDGE})
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_mix(spark):
    rng = random.Random(3)
    texts = [(k, " ".join(rng.choices(WORDS, k=rng.randint(0, 40))) or None) for k in range(600)]
    sources = [rng.choice(["a", "b", "c", None, "é"]) if k % 3 else "a" for k in range(600)]
    docs = documents(spark, texts, sources)
    rows = [r.asDict() for r in mixing.mix(docs).collect()]
    assert rows == [r.asDict() for r in mixing.mix(docs).collect()] or sorted(map(str, rows)) == sorted(str(r.asDict()) for r in mixing.mix(docs).collect())
    size = {k: len((t or "").split()) for k, t in texts}
    by = collections.defaultdict(list)
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        by[sources[r["doc_id"]]].append(r)
    total = sum(size.values())
    weight = dict(zip(sorted([s for s in by if s is not None]) + [None], [1, 2, 3, 1, 2]))
    cap = {s: 3 * sum(r["size"] for r in v) for s, v in by.items()}
    target, free, left = {}, set(by), total
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s], left = cap[s], left - cap[s]
        free -= over
    for s, v in by.items():
        assert v[0]["target"] == pytest.approx(target[s]) and abs(sum(r["taken"] for r in v) - target[s]) <= max(r["size"] for r in v)
        epochs = int(target[s] // v[0]["source_size"])
        assert {r["taken"] // r["size"] for r in v if r["size"]} <= {epochs, epochs + 1}
    mixed = mixing.apply_mix(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in mixed} == {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 1 for r in rows if r["taken"] or not r["size"]}
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(documents(spark, EDGE)).count() == len(EDGE)


def test_mix_weights_prefer_clean(spark):
    texts = [(k, " ".join(["word"] * 10)) for k in range(400)] + [(k, " ".join(["w#$%&"] * 10)) for k in range(400, 800)]
    rows = mixing.mix(documents(spark, texts, ["a"] * 800), share=0.3).collect()
    assert sum(r["taken"] > 0 for r in rows if r["doc_id"] < 400) > 1.5 * sum(r["taken"] > 0 for r in rows if r["doc_id"] >= 400)


def test_decontaminate(spark):
    item = "In 1999 Alice said, Bob walked 12 km and then Carol walked 12 km home before the bell rang twice again"
    other = "in 2005 alice SAID Bob walked 7 km and then Carol walked 7 km home before the bell rang twice again"
    broken = other.replace("walked 7 km home", "walked 8 km home")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    texts = [(1, "before it all " + item + " and after"), (2, "x y " + other), (3, broken), (4, "clean words only here and there"), (5, None), (6, ""), (None, item), (7, item + "\n" + other)]
    got = {r["doc_id"]: r for r in decontaminate.find_contaminated(documents(spark, texts), bench).collect()}
    assert set(got) == {1, 2, None, 7} and got[1]["kind"] == "verbatim" and got[2]["kind"] == "reparameterised" and all(r["item_id"] == 1 for r in got.values())
    left = decontaminate.drop_contaminated(documents(spark, texts), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6]
    assert decontaminate.find_contaminated(documents(spark, texts).limit(0), bench).count() == 0
    assert decontaminate.find_contaminated(documents(spark, texts), bench.limit(0)).count() == 0


def test_decontaminate_every_offset(spark):
    rng = random.Random(6)
    items = [(k, " ".join(rng.choices([f"v{j}" for j in "abcdefghijklmnopqrstuvwxyz"], k=14)).replace("v", "word")) for k in range(20)]
    texts = [(100 * k + s, " ".join(["pre"] * s + [t] + ["post"] * 3)) for k, t in items for s in range(5)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contaminated(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i // 100) for i, _ in texts}


def test_decontaminate_short_items_and_runs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("bcdfghjklm", k=7))
    items = [(n, " ".join(word() for _ in range(n))) for n in (5, 6, 7, 9, 10, 12, 13, 30)]
    cut = {n: t if n < 30 else " ".join(t.split()[8:18]) for n, t in items}
    texts = [(100 * n + s, " ".join(["pre"] * s + [t] + ["post"] * 3)) for n, t in cut.items() for s in range(5)]
    parts = [(10_000 + n, "pre " + t.rsplit(" ", 1)[0] + " post") for n, t in cut.items() if 5 < n <= 10 or n == 30]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contaminated(documents(spark, texts + parts), bench).collect()}
    assert got == {(i, i // 100) for i, _ in texts}


def test_decontaminate_names_in_any_case(spark):
    item = "Yesterday young Peter met Paul and Mary near the old bridge while Simon watched Andrew and Judith leave town"
    texts = [(1, item), (2, item.lower()), (3, item.upper()), (4, "and then Yesterday" + item[9:]), (5, item.replace("Paul", "Otto").replace("Simon", "Jakob")), (6, item.title())]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_windows"], r["kind"]) for r in decontaminate.find_contaminated(documents(spark, texts), bench).collect()}
    assert got == {k: (15, "reparameterised" if k == 5 else "verbatim") for k, _ in texts}


def test_url_rules(spark):
    urls = ["https://x.com/a", "http://www.EXAMPLE.com/en/1?q#f", "http://b.www.example.com/en/", "http://example.com/en/x", "http://a.net/es/1", "http://a.net/fr/1", "http://a.net/de/1", "no scheme", None, "", "http://xcom/", "ftp://net/es/?/"]
    rows = [(k, u) for k, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("tokens", F.lit(1)).withColumn("host", F.lit("h"))
    got = collections.defaultdict(list)
    for r in url_rules.judge_urls(pages).collect():
        got[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert all(len(v) == 2 and v[0] == v[1] for v in got.values())
    assert got[0][0] == ("x.com", "/a", "com/", "allow") and got[1][0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2][0][2:] == ("www.example.com/en/", "allow") and got[3][0][2:] == ("example.com/en/", "block") and got[4][0][2:] == ("net/es/", "block")
    assert got[6][0][2] is None and got[7][0][:3] == ("", "", None) and got[8][0] == ("", "", None, "allow") and got[10][0][2] is None and got[11][0][2] == "net/es/"
    assert url_rules.judge_urls(pages.limit(0)).count() == 0


def test_mined_rules_brute_force(spark):
    rng = random.Random(8)
    rows = [({"h:" + rng.choice("ab"), "p:" + rng.choice("xyz"), "q:" + rng.choice("mn")}, None) for _ in range(200)]
    rows = [(sorted(t), "h:a" in t and "p:x" in t) for t, _ in rows]
    labelled = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    rules = url_rules.mine_rules(labelled, 0.02, 0.9, 1.1, 4)
    for r in rules.collect():
        having = [b for t, b in rows if set(r["antecedent"]) <= set(t)]
        right = sum(b == (r["verdict"] == "block") for b in having)
        assert r["confidence"] == pytest.approx(right / len(having)) and r["support"] == pytest.approx(right / len(rows))
    assert ["h:a", "p:x"] in [r["antecedent"] for r in rules.collect()]
    urls = spark.createDataFrame([("u1", ["h:a", "p:x", "q:z"]), ("u2", ["h:b", "p:q"])], "url string, tokens array<string>")
    assert {r["url"]: r["verdict"] for r in url_rules.match_rules(urls, rules).collect()}["u1"] == "block"


TEXTS = ["mail a.b+c@x-y.co.uk, _q@a.b.c! x@y", "a@b.com_x@y.org", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 0255.1.1.1", "card 4111 1111 1111 1111, 4111-1111-1111-1112 12", "+1 (714) 555-9345 é😀 +12 +1234567890123456",
         None, "", "a" * 30000, "1" * 5000, "😀 a@b.cc 1.1.1.1", "password = 'abcdef12' Api-Key TOKEN:x token=abc1234", "AKIA" + "A1" * 10 + " AKIAB " + "ab12" * 8, "secret : deadbeefdeadbeefdeadbeefdead"]


def pii_brute(t):
    t, out = t or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(d))) % 10 == 0
    for kind, pattern, fits in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ):
        source = [] if kind == "email" and len(t) > 20000 else re.finditer(pattern, t)
        out += [f"{kind}:{m.start()}:{m.end()}" for m in source if fits(m[0])]
    return out


def test_pii(spark):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[0])]
    got = pii.find_pii(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        base = pii_brute(TEXTS[r["doc_id"] or 0])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and r["spans"].split(",")[: len(base)] == (base or r["spans"].split(",")[:0])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
    assert pii.find_pii(documents(spark, rows).limit(0)).count() == 0


def test_pii_learns_spans(spark):
    rng = random.Random(1)
    good = [(k, f"x; contact name: {n.title()} {s}, lives here") for k, (n, s) in enumerate((rng.choice(pii.FIRST_NAMES), rng.choice(["Stone", "Field"])) for _ in range(60))]
    bad = [(100 + k, f"see the table. The {rng.choice(['House', 'River'])} of page 12-34-56 items") for k in range(60)]
    got = {r["doc_id"]: r["n_more"] for r in pii.find_pii(documents(spark, good + bad)).collect()}
    assert sum(got[k] > 0 for k, _ in good) > 50 and not any(got[k] for k, _ in bad)


def test_secrets(spark):
    rng = random.Random(2)
    prose = " ".join(rng.choices(["international", "responsibility", "configuration_manager", "the", "snake_case", "identifier_value", "snake_case_identifier2024_value"], k=3000))
    key_ = "x9Kq7ZtR2vLmP4sWfB8nYdHc3J"
    rows = [*enumerate(TEXTS), (50, prose), (51, f"some words {key_} and on")]
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(documents(spark, rows)).collect()}
    assign = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for i, t in rows:
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t or "") if len(m[1]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        shown = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base))
        assert got[i]["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest() and [got[i][f"n_{k}"] for k in secret_scan.KINDS] == [sum(b[1] == j for b in base) for j in range(3)]
    assert got[51]["spans"] == "random:11:37" and got[50]["n_more"] == 0
    assert secret_scan.find_secrets(documents(spark, rows).limit(0)).count() == 0


def test_secrets_long_or_without_digits():
    rng = random.Random(8)
    words = " ".join("".join(rng.choices(["ba", "ne", "tor", "li", "sum", "ka"], k=4)) for _ in range(5000))
    model = secret_scan.log_model(secret_scan.transitions(secret_scan.drawn_samples()).astype(float)) - secret_scan.log_model(secret_scan.transitions(words.encode()).astype(float))
    letters, every = secret_scan.ALPHABET[:52], secret_scan.ALPHABET[:62]
    for run in ("".join(rng.choices(every, k=201)), "".join(rng.choices(every, k=3000)), "".join(rng.choices(letters, k=40))):
        assert secret_scan.scan(f"see {run} there", model, secret_scan.LEAST_RATIO)[1] == [(4, 4 + len(run))]
    plain = "".join(rng.choices(["ba", "ne", "tor", "li", "sum", "ka"], k=100))
    assert secret_scan.scan(f"see {plain} and {plain[:30]} there", model, secret_scan.LEAST_RATIO) == ([], [])


def test_secret_model_held_out():
    rng = random.Random(9)
    counts = secret_scan.transitions(" ".join(rng.choices(["responsibility", "configuration", "interface", "manager", "snake_case"], k=5000)).encode())
    model = secret_scan.log_model(secret_scan.transitions(secret_scan.drawn_samples())) - secret_scan.log_model(counts)
    fresh = secret_scan.drawn_samples(300, seed=77).decode().split()
    assert sum(secret_scan.ratio(s, model) >= secret_scan.LEAST_RATIO for s in fresh) > 280
    assert secret_scan.ratio("configuration_manager_interface", model) < secret_scan.LEAST_RATIO


def test_quality_held_out(spark):
    rng = random.Random(5)
    rows, grades = [], []
    for k in range(600):
        g = k % 3
        w = rng.choices(WORDS, k=rng.randint(20, 80))
        if g == 0:
            w = [x.upper() + "!!" for x in w]
        if g == 1:
            w[3:3] = ["idiot"] * 2
        rows.append((k, " ".join(w)))
        grades.append((k, g))
    docs = documents(spark, rows)
    model = quality.train(docs, spark.createDataFrame(grades[:400], "doc_id long, grade int"))
    assert model[-2] < model[-1]
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    right = sum((got[k]["tail_good"] >= 0.5) == (g == 2) for k, g in grades[400:])
    assert right >= 190
    mean = [np.mean([got[k]["expected_grade"] for k, g in grades[400:] if g == x]) for x in range(3)]
    assert mean[0] < mean[1] < mean[2]
    none = quality.train(docs, spark.createDataFrame([(1, None), (None, 2)], "doc_id long, grade int"))
    assert none is None and quality.select_good(docs, spark.createDataFrame([], "doc_id long, grade int")).count() == 600
    assert quality.score(documents(spark, EDGE), model).count() == len(EDGE) and quality.score(docs.limit(0), model).count() == 0


def test_revisits(spark):
    schema = "record_id long, url string, ts timestamp, status int, etag string, last_modified string, headers map<string,string>, payload_sha256 string, base string"
    import datetime as dt

    rng = random.Random(7)
    rows = []
    for k in range(300):
        full = rng.random() < 0.5
        rows.append((k, rng.choice(["http://WWW.a.com/x/?utm_source=1", "https://a.com/x#f", "http://b.org/?b=1&a=2", None]), dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randrange(200)),
                     200 if full else rng.choice([304, 304, 304, 404, None]), rng.choice(["e1", "W/e1", "e2", None]), rng.choice(["m1", "m2", None]),
                     {"ETag": "x", "Content-Length": str(k), "Date": str(k)}, f"p{k}" if full else None, "clash"))
    got = {r["record_id"]: r for r in warc_revisit.resolve(spark.createDataFrame(rows, schema), 36_000).collect()}
    canon = {rows[0][1]: 0}
    name = lambda u: None if u is None else "b" if "b.org" in u else "a"
    assert len(got) == 300 and got[0] and canon
    for r in rows:
        base = max(((x[2], x[0], x) for x in rows if x[3] == 200 and name(x[1]) == name(r[1]) is not None and (x[2], x[0]) < (r[2], r[0])), default=None) if name(r[1]) else None
        base = base and base[2]
        weak = lambda e: e.removeprefix("W/")
        if r[3] == 200:
            want = "full"
        elif r[3] != 304:
            want = "other"
        elif not base:
            want = "no_base"
        elif r[4] and base[4]:
            want = "resolved" if weak(r[4]) == weak(base[4]) else "changed"
        elif r[5] and base[5]:
            want = "resolved" if r[5] == base[5] else "changed"
        else:
            want = "unchecked"
        assert got[r[0]]["outcome"] == want
        if want == "resolved":
            assert got[r[0]]["base_id"] == base[0] and got[r[0]]["resolved_sha256"] == base[7]
            assert got[r[0]]["merged"] == {"etag": "x", "content-length": base[6]["Content-Length"], "date": r[6]["Date"]}
    assert warc_revisit.resolve(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("frequent", [3, 1000])
def test_lm_base(spark, frequent):
    import math
    import zlib

    got = lm_score.score(documents(spark, EDGE), frequent=frequent).collect()
    toks = lambda t: [w.lower() for w in (t or "").split()] + [""]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    c = collections.Counter(w for i, t in EDGE if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = [(i, held(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in toks(t)), 6)) for i, t in EDGE]
    assert sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got], key=key) == sorted(want, key=key)
    assert all(r["score"] < 0 for r in got) and lm_score.score(documents(spark, EDGE).limit(0)).count() == 0


def test_lm_learns_context(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(f"{a}{rng.choice('pqrs')}{a}" for a in rng.choice(["abcabc", "xyzxyz"]) * 10)) for k in range(400)]
    got = [r for r in lm_score.score(documents(spark, rows)).collect() if r["held_out"]]
    assert len(got) > 20 and sum(r["score"] > r["base_score"] for r in got) > 0.9 * len(got)


def lm_arrays(texts, like=None):
    token, shared, size = lm_score.tokens_of(texts)
    own = lm_score.own_leaves(*np.unique(lm_score.tokens_of(like or texts)[0], return_counts=True))
    leaf = lm_score.leaves_of(token, shared, own)
    return lm_score.features(token, leaf, size), leaf, size


def test_lm_learns_two_words_together():
    """The third word of each triple is told by the two before together, by neither alone, nor by their leaves."""
    rng = random.Random(4)

    def arrays(count):
        pairs = [(rng.choice("pq"), rng.choice("pq")) for _ in range(count)]
        return lm_arrays([" ".join(w for a, b in pairs for w in (a + "word", b + "word", "yes" if a == b else "no"))], ["pword qword pword qword pword qword yes no yes no"])

    model = lm_score.new_model()
    for m in model:
        m.begin()
    hashed, leaf, _ = arrays(3000)
    lm_score.learn(model, hashed, leaf, 0.3)
    hashed, leaf, _ = arrays(300)
    assert leaf[2:-1:3].min() != leaf[2:-1:3].max() and np.exp(lm_score.leaf_logp(model, hashed, leaf)[2:-1:3]).mean() > 0.9


def test_lm_probabilities_sum_to_one():
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=50)) for _ in range(40)]
    hashed, leaf, _ = lm_arrays(texts)
    model = lm_score.new_model()
    for m in model:
        m.begin()
    lm_score.learn(model, hashed, leaf, 0.3)
    some = tuple(h[:30] for h in hashed)
    total = sum(np.exp(lm_score.leaf_logp(model, some, np.full(30, k))) for k in range(lm_score.LEAVES))
    assert np.allclose(total, 1, atol=1e-4)
    # within a leaf: the seen words and one share for unseen ones
    token, shared, _ = lm_score.tokens_of(texts)
    code, c = np.unique(token, return_counts=True)
    at = lm_score.leaves_of(code, np.zeros(len(code), dtype=np.int64) + lm_score.OWN, lm_score.own_leaves(code, c))
    for k in np.unique(at):
        n, v = c[at == k].sum(), (at == k).sum()
        assert np.isclose(((c[at == k] + 0.1) / (n + 0.1 * (v + 1))).sum() + 0.1 / (n + 0.1 * (v + 1)), 1)


def test_word_codes_are_the_words():
    texts = ["", None, "One two\tTHREE one", " x\x0by\x1cz \u00c4 \u00e4", "a" * 5000 + " " + "a" * 4999 + "b", "\ufeffb \u2028", "  "]
    codes, count = hashing.word_codes(texts)
    words = [hashing.words_of(t) for t in texts]
    assert count.tolist() == [len(w) for w in words]
    by_word = {}
    for w, c in zip([w for ws in words for w in ws], codes.tolist()):
        assert by_word.setdefault(w, c) == c
    assert len(set(by_word.values())) == len(by_word) and hashing.word_codes([])[1].size == 0


def test_jaccard_long_runs_in_batches():
    """Runs that cross batches, short and long: the same pairs whatever the cut."""
    import pandas as pd

    rng = random.Random(2)
    rows = pd.DataFrame(sorted((rng.choice([1, 2, 3, 4, 4, 4, 4, 4, 9]), rng.randint(90, 110), k) for k in range(200)), columns=["gram", "n", "rid"])
    def pairs(cuts):
        edges = [0, *cuts, len(rows)]
        got = pd.concat(list(jaccard_join.near_runs(85)(iter([rows[a:b] for a, b in zip(edges, edges[1:])]))))
        return sorted(map(tuple, got.to_numpy().tolist()))
    whole = pairs([])
    for size in (1, 3, 7, 50):
        assert pairs(range(size, len(rows), size)) == whole
    assert any(need == 0 for *_, need in whole)


def test_rows_not_ids_are_dropped(spark):
    """Unlike rows under a shared or null id stay; equal rows stay once."""
    rng = random.Random(12)
    plain = ["".join(rng.choices("bcdfghjklm", k=6)) for _ in range(400)]
    a, b, c = (" ".join(rng.choices(plain, k=60)) for _ in range(3))
    near = a.rsplit(" ", 1)[0] + " other"
    docs = documents(spark, [(1, a), (3, near), (3, b), (None, near), (None, c), (None, c), (5, b)]).withColumns({"own": F.lit(1), "copy": F.lit(2), "kept": F.lit(3), "of": F.lit(4)})
    left = jaccard_join.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == sorted([("1", a), ("3", b), ("None", c)])
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == sorted([("1", a), ("3", near), ("None", c), ("5", b)])
    bench = spark.createDataFrame([(1, b)], "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, bench)
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == sorted([("1", a), ("3", near), ("None", near), ("None", c), ("None", c)])
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == [*docs.columns, "_copy"] and mixed.count() > 0


def test_slots_are_one_to_one(spark):
    item = "first take 12 apples then 15 pears and give 12 apples back to all of the old friends there"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [(1, item.replace("12", "3").replace("15", "4")), (2, item.replace("12", "3").replace("15", "3"))]
    assert [r["doc_id"] for r in decontaminate.find_contaminated(documents(spark, texts), bench).collect()] == [1]
    # windows of slots match by their values only
    rng = random.Random(3)
    figures = lambda: " ".join(str(rng.randrange(10_000, 99_999)) for _ in range(40))
    item = figures()
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.find_contaminated(documents(spark, [(1, item), (2, figures())]), bench).collect()] == [1]


def test_revisit_header_names_in_any_case(spark):
    rows = [(1, "http://a.com/", 200, {"ETag": "x", "etag": "y", "Set-Cookie": "a"}), (2, "http://a.com/", 304, {"ETAG": "z"})]
    schema = "record_id long, url string, status int, headers map<string,string>"
    df = spark.createDataFrame(rows, schema).withColumns({"ts": F.timestamp_seconds("record_id"), "etag": F.lit("e"), "last_modified": F.lit(None).cast("string"), "payload_sha256": F.lit("p")})
    got = {r["record_id"]: r["merged"] for r in warc_revisit.resolve(df).collect()}
    assert got == {1: {"etag": "x, y", "set-cookie": "a"}, 2: {"etag": "z", "set-cookie": "a"}}


def test_pii_many_names(spark):
    texts = [(1, "Anna Stone, " * 9000), (2, " ".join(f"+1 714 555 {k:04d}" for k in range(3000)))]
    got = {r["doc_id"]: r for r in pii.find_pii(documents(spark, texts)).collect()}
    assert got[2]["base_sha256"] == hashlib.sha256(",".join(pii_brute(texts[1][1])).encode()).hexdigest()


def test_url_verdicts_by_brute_force(spark):
    """Without labels the base list's own tokens teach nothing: a .net page is not blocked for being .net."""
    urls = [f"http://h{k % 7}.net/{lang}/{seg}{'?ad=1' if seg == 'promo' else ''}" for k in range(40) for lang, seg in (("es", "promo"), ("fr", "promo"), ("es", "news"))]
    urls += [f"http://shop{k}.com/{seg}" for k in range(60) for seg in ("news", "blog")] + ["http://x.net/de/news", "http://y.org/en/promo?ad=1", "http://z.org/blog"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    known = [(set(r["tokens"]), r["bad"]) for r in url_rules.transactions(pages).filter("not held").collect()]
    assert not any(t & {"h:net", "h:com", "p:es", "p:fr"} for t, _ in known)
    share = sum(b for _, b in known) / len(known)

    def verdict(tokens):
        import itertools

        best = None
        for k in range(1, 5):
            for rule in itertools.combinations(sorted(tokens), k):
                having = [b for t, b in known if set(rule) <= t]
                for bad in (True, False):
                    hit = sum(b == bad for b in having)
                    if hit >= 0.01 * len(known) and hit / len(having) >= 0.8 and hit / len(having) >= 1.1 * (share if bad else 1 - share):
                        one = (hit / len(having), hit / len(known), "block" if bad else "allow")
                        best = max(best or one, one)
        return best[2] if best else "allow"

    rows = url_rules.judge_urls(pages).join(pages, "page_id").withColumn("tokens", url_rules.url_tokens()).filter("rule is null").collect()
    assert len(rows) == 3 and all(r["verdict"] == verdict(r["tokens"]) for r in rows)
    got = {r["url"]: r["verdict"] for r in rows}
    assert got["http://x.net/de/news"] == "allow" and got["http://y.org/en/promo?ad=1"] == "block"


def test_warc_files(spark, tmp_path):
    def record(kind, no, date, http, digest=None, body=""):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{no}>", "WARC-Target-URI: http://a.com/x", f"WARC-Date: 2020-01-0{date}T00:00:00Z", *([f"WARC-Payload-Digest: sha256:{digest}"] if digest else [])]
        return "WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n" + http + "\r\n\r\n" + body + "\r\n\r\n"

    text = record("warcinfo", 0, 1, "software: x") + record("response", 1, 1, 'HTTP/1.1 200 OK\r\nETag: "e"\r\nSet-Cookie: a\r\nset-cookie: b\r\nContent-Length: 5', "d1", "hello WARC/1.0\r\nnot a record")
    text += record("revisit", 2, 2, 'HTTP/1.1 304 Not Modified\r\nETag: W/"e"\r\nDate: now') + record("revisit", 3, 3, 'HTTP/1.1 304 Not Modified\r\nETag: "f"')
    (tmp_path / "a.warc").write_bytes(text.encode())
    got = {r["record_id"]: r for r in warc_revisit.resolve(warc_revisit.read_warc(spark, str(tmp_path / "a.warc"))).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {"<urn:1>": "full", "<urn:2>": "resolved", "<urn:3>": "changed"}
    assert got["<urn:2>"]["base_id"] == "<urn:1>" and got["<urn:2>"]["resolved_sha256"] == "sha256:d1"
    assert got["<urn:2>"]["merged"] == {"etag": 'W/"e"', "set-cookie": "a, b", "content-length": "5", "date": "now"}


def test_revisits_without_times(spark):
    """Rows without a time are one moment, ordered by record id over many slices."""
    n = 300_000
    df = spark.range(n).select(
        F.col("id").alias("record_id"), F.lit("http://a.com/").alias("url"), F.lit(None).cast("timestamp").alias("ts"), F.when(F.col("id") % 100_000 == 5, 200).otherwise(304).alias("status"),
        F.lit("e").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.create_map(F.lit("a"), F.lit("b")).alias("headers"), F.lit("p").alias("payload_sha256"))
    done = warc_revisit.resolve(df).filter("outcome <> 'full'")
    want = F.when(F.col("record_id") > 5, F.floor((F.col("record_id") - 6) / 100_000) * 100_000 + 5)
    assert done.filter(~F.col("base_id").eqNullSafe(want)).isEmpty() and done.count() == n - 3


def test_decontaminate_by_brute_force(spark):
    """Items of 1 to 30 words from a small vocabulary, whole or cut, at all offsets: exactly what the rule says is reported."""
    rng = random.Random(31)
    word = ["bab", "cac", "dad", "faf", "gag", "hah", "jaj"]
    items = [(k, " ".join(rng.choices(word, k=rng.randint(1, 30)))) for k in range(25)]
    texts = []
    for k in range(120):
        w = rng.choices(word, k=rng.randint(0, 12))
        if k % 3:
            part = rng.choice(items)[1].split()
            a = rng.randrange(len(part))
            part = part if k % 3 == 1 else part[a : a + rng.randint(1, 14)]
            at = rng.randint(0, len(w))
            w[at:at] = part
        texts.append((k, " ".join(w)))

    def holds(doc, item, size=5, least=2):
        d, i = doc.split(), item.split()
        places = {}
        for x in range(len(d) - size + 1):
            for y in range(len(i) - size + 1):
                if d[x : x + size] == i[y : y + size]:
                    places.setdefault(x - y, []).append(y)
        for ys in places.values():
            side_by_side, last = 0, -size
            for y in sorted(ys):
                if y >= last + size:
                    side_by_side, last = side_by_side + 1, y
            if side_by_side >= least or (len(ys) == len(i) - size + 1 and len(i) < least * size):
                return True
        return False

    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contaminated(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, t in texts for i, s in items if holds(t, s)} and len(got) > 20


def test_url_labels_of_documents(spark):
    pages = spark.createDataFrame([(0, "http://a.com/en/7?x"), (1, "http://b.com/8/"), (2, "http://c.com/x9"), (3, None), (4, "http://d.com/en/7?x"), (5, "http://e.com/5"), (6, "http://f.com/" + "9" * 30)], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (8, 1, 1), (9, 0, 0), (5, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = {(r["url"], r["bad"]) for r in url_rules.labels_of_documents(pages, labels).collect()}
    assert got == {("http://a.com/en/7?x", True), ("http://d.com/en/7?x", True), ("http://b.com/8/", True)}
    verdicts = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(pages, url_rules.labels_of_documents(pages, labels)).collect()}
    assert len(verdicts) == 7


def test_pii_offsets_in_long_texts(spark):
    """Every candidate of a long text has its place in code points; the text's length costs no second look per match."""
    text = "".join(f"so Anna Smith{'é' * (k % 3)} \U0001f600 and @user_{k} met, " for k in range(6000))
    got = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string").select(
        "doc_id", pii.located(F.col("text"), pii.CANDIDATE).alias("x")).collect()
    want = [(m[0], m.start(), m.end()) for m in re.finditer(r"\bAnna Smithé*|(?<![\w@.])@\w{3,}", text)]
    assert [(x["m"], x["start"], x["stop"]) for x in got[0]["x"]] == want and len(want) == 12_000
    assert all(text[x["stop"]:][:30] == x["after"][:30] or len(x["after"]) < 30 for x in got[0]["x"])
    assert got[1]["x"] == [] and got[2]["x"] == []
    found = pii.find_pii(spark.createDataFrame([(1, text + " a@b.cd"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_email"] for r in found] == [1, 0]
    at = len(text) + 1
    assert found[0]["base_sha256"] == hashlib.sha256(f"email:{at}:{at + 6}".encode()).hexdigest()


def _warc_record(kind, no, url, second, http="", *more, version="1.0"):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{no}>", f"WARC-Target-URI: {url}", f"WARC-Date: 2020-01-01T00:00:{second:02d}Z", *more]
    return (f"WARC/{version}\r\n" + "\r\n".join(head) + "\r\n\r\n" + http + "\r\n\r\nbody\r\n\r\n").encode()


def test_warc_copies_are_no_bases(spark, tmp_path):
    import gzip

    profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    ok, e = "HTTP/1.1 200 OK\r\nX: {}\r\nETag: \"e\"", "HTTP/1.1 304 Not Modified\r\nETag: \"e\"\r\nX: new"
    records = [
        _warc_record("response", 1, "http://a.com/x", 1, ok.format(1), "WARC-Payload-Digest: sha256:d1"),
        _warc_record("revisit", 2, "http://a.com/x", 2, ok.format(2), profile, "WARC-Payload-Digest: sha256:d1", version="1.1"),
        _warc_record("revisit", 3, "http://a.com/x", 3, e, version="1.1"),
        _warc_record("revisit", 4, "http://b.com/y", 4, ok.format(4), profile, "WARC-Payload-Digest: sha256:d1", "WARC-Refers-To: <urn:1>", version="1.1"),
        _warc_record("revisit", 5, "http://b.com/y", 5, ok.format(5), profile, "WARC-Payload-Digest: sha256:d9", "WARC-Refers-To: <urn:1>"),
        _warc_record("revisit", 6, "http://b.com/y", 6, ok.format(6), profile, "WARC-Payload-Digest: sha256:d9"),
        _warc_record("revisit", 7, "http://b.com/y", 7, ok.format(7), profile),
        _warc_record("revisit", 8, "http://a.com/x", 0, ok.format(8), profile, "WARC-Payload-Digest: sha256:d1"),
        _warc_record("revisit", 9, "http://b.com/y", 9, ok.format(9), profile, "WARC-Payload-Digest: sha256:d1", "WARC-Refers-To: <urn:77>"),
    ]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    want = {
        1: ("full", 1, "d1", "1"), 2: ("duplicate", 1, "d1", "2"), 3: ("resolved", 1, "d1", "new"), 4: ("duplicate", 1, "d1", "4"), 5: ("changed", None, None, None),
        6: ("no_base", None, None, None), 7: ("no_base", None, None, None), 8: ("no_base", None, None, None), 9: ("duplicate", 1, "d1", "9"),
    }
    for name in ("plain.warc", "members.warc.gz"):
        got = warc_revisit.resolve(warc_revisit.read_warc(spark, str(tmp_path / name))).collect()
        assert {int(r["record_id"][5:-1]): (
            r["outcome"], r["base_id"] and int(r["base_id"][5:-1]), r["resolved_sha256"] and r["resolved_sha256"][7:], r["merged"] and r["merged"]["x"]) for r in got} == want and len(got) == 9


def test_warc_text_ids_without_times(spark):
    """Text ids are ordered as text, digits too, and split by what they begin with."""
    schema = "record_id string, url string, ts timestamp, status int, etag string, last_modified string, headers map<string,string>, payload_sha256 string"
    ids = ["10", "9", "100", "<urn:uuid:0001-aaaa>", "<urn:uuid:0001-bbbb>", "<urn:uuid:ffff-aaaa>", None]
    rows = [(i, "http://a.com/", None, 200 if i and i[-1] in "0b>" and "bbbb" not in i and i != "100" else 304, "e", None, {}, f"p{i}") for i in ids]
    got = {r["record_id"]: r["base_id"] for r in warc_revisit.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert got == {None: None, "10": "10", "100": "10", "9": "10", "<urn:uuid:0001-aaaa>": "<urn:uuid:0001-aaaa>", "<urn:uuid:0001-bbbb>": "<urn:uuid:0001-aaaa>", "<urn:uuid:ffff-aaaa>": "<urn:uuid:ffff-aaaa>"}
