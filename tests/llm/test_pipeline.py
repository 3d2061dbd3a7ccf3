"""The pipeline's stages in turn on small data, and the registered queries against their SQL."""

import os

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(p.STAGES):
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns[: len(p.COLUMNS)] == list(p.COLUMNS) and (docs.columns == list(p.COLUMNS) or k == len(p.STAGES) - 1)
        assert docs.select("doc_id").join(before, "doc_id", "left_anti").isEmpty() and not docs.isEmpty()
    assert sorted(map(str, p.run(spark, SF).select("doc_id", "copy").collect())) == sorted(map(str, docs.select("doc_id", "copy").collect()))


def test_stages_by_brute_force(spark):
    """Every stage but the first against its rule worked out anew, on rows with nulls, repeats and shared ids."""
    import random

    import corpus_pipeline as p
    from test_llm import components

    rng = random.Random(21)
    word = ["".join(rng.choices("bcdfghjklm", k=6)) for _ in range(300)]
    texts = [" ".join(rng.choices(word, k=rng.randint(30, 90))) for _ in range(40)]
    texts += [t.rsplit(" ", 2)[0] + " extra" for t in texts[:8]] + texts[:5] + [None, "", " ", "one"]
    ids = [*range(len(texts) - 3), None, None, 3]
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t or "")) for i, t in zip(ids, texts)]
    item = " ".join(texts[30].split()[4:24])
    docs = spark.createDataFrame([*rows, rows[2]], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(p.STAGES)
    got = stage["exact dedup"](spark, docs, SF).collect()
    assert sorted(r["text"] or "" for r in got) == sorted({r["text"] or "" for r in docs.collect()})
    got = stage["n-gram Jaccard join"](spark, docs, SF).collect()
    numbered = list(enumerate(r["text"] for r in docs.collect()))
    found = components(numbered, 5, 80)
    assert len(got) == len({c for _, n, c in found if n}) + sum(n == 0 for _, n, _ in found)
    from boxloom.llm import decontaminate

    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    want = sorted(r["text"] or "" for r in docs.collect() if item not in (r["text"] or ""))
    assert sorted(r["text"] or "" for r in decontaminate.drop_contaminated(docs, bench).collect()) == want
    mixed = stage["mixing sources to target weights"](spark, docs, SF)
    assert set(r["text"] for r in mixed.collect()) <= set(texts)
    for name, one in p.STAGES:
        assert one(spark, docs.limit(0), SF).count() == 0, name


def test_sql(spark):
    from boxloom.llm import queries

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(sql).df()
        show = lambda v: "" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)
        rows = lambda d: sorted(tuple(show(x) for x in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
        assert rows(got) == rows(want), name
