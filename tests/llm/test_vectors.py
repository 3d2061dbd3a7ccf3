"""Operators on vectors against brute force, with nulls, odd entries, ties, repeats, hot groups, empty tables and clashing columns."""

import math
import random

import numpy as np
import pytest

from boxloom.llm import hard_negatives, near_vectors, queries, vectors, whitening

TABLE = "vec_id long, embedding array<float>, label int, row long, cell int, x string, id string, kept int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, c, 1, 2, "x", "i", 3) for i, v, c in rows], TABLE)


def saved(spark, folder, rows):
    table(spark, rows).repartition(3).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def odd_rows(width, start=90_000):
    """Rows that no operator may trip over."""
    nan, inf = float("nan"), float("inf")
    return [(start, None, 1), (start + 1, [None] * width, 1), (start + 2, [nan] * width, 1), (start + 3, [1.0] * (width - 1) + [inf], 2), (start + 4, [0.0] * width, None)]


def sound(rows):
    return [(i, np.array(v, dtype=np.float32).astype(float), c) for i, v, c in rows if v is not None and None not in v and np.isfinite(v).all()]


def vectors_of(seed, n, width, spread=0.3):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, width)) * spread).astype(np.float32).tolist()


def mined(rows):
    rows = [(i, np.floor(256 * v).astype(int), (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in sound(rows) if c is not None]
    out = []
    for a, x, c in rows:
        if a % 100 == 0:
            scored = sorted((-int(x @ y), i, d) for i, y, d in rows if i != a)
            for s, p, _ in [t for t in scored if t[2] == c][:5]:
                fits = [(t, i) for t, i, d in scored if d != c and 30 * -s <= 100 * -t <= 90 * -s][:10]
                out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("width, rows, anchors", [(6, 64, 4), (70, 4096, 256), (150, 30, 2)])
def test_hard_negatives(spark, tmp_path, monkeypatch, width, rows, anchors):
    """One label has a third of all rows, equal vectors tie, and blocks are small enough to be many."""
    monkeypatch.setattr(hard_negatives, "ROWS", rows)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    v = vectors_of(width, 400, width)
    v[11:20] = [v[10]] * 9
    data = [(i, x, 3 if i % 3 == 0 else i % 10) for i, x in enumerate(v)] + odd_rows(width)
    got = queries.op11_hard_negatives(spark, saved(spark, tmp_path, data)).collect()
    assert sorted(map(tuple, got)) == mined(data) and got


def test_hard_negatives_at_the_edges(spark, tmp_path):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    empty = queries.op11_hard_negatives(spark, saved(spark, tmp_path / "a", []))
    assert empty.columns == names and empty.count() == 0
    # buckets of several labels, texts as labels, ragged vectors, large entries whose products need whole numbers
    big = 1 << 26
    data = [(100, [big, 1], "a"), (1, [big, 1, 0], "a"), (2, [big // 2, 1], "b"), (3, [big // 2, 3], "c"), (3, [big // 2, 3], "c"), (None, [big, 1], "a"), (4, [big], None), (5, None, "b")]
    rows = spark.createDataFrame(data, "vec_id long, x array<long>, label string")
    got = sorted(map(tuple, hard_negatives.mine(rows, rows.vec_id % 100 == 0).collect()))
    half = big * big // 2
    assert got == [(100, 1, 1, 3, big * big + 1, half + 3), (100, 1, 2, 3, big * big + 1, half + 3), (100, 1, 3, 2, big * big + 1, half + 1)]
    # without a negative in the window, or without a positive, there is nothing
    assert hard_negatives.mine(rows.filter("label = 'a'"), rows.vec_id % 100 == 0).count() == 0
    assert hard_negatives.mine(rows.filter("vec_id > 1"), rows.vec_id % 100 == 0).count() == 0


def whitened(rows, got, width):
    x = np.array([np.floor(1024 * np.pad(v, (0, width - len(v)))) + 100_000 for _, v, _ in sound(rows)])
    n, s = len(x), x.sum(axis=0).astype(int)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:8], v[:, ::-1][:, :8]
    assert len(got) == n * len(e)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    total = np.linalg.eigvalsh(c.T @ c / n).sum()
    for (i, _, _), row, centred in zip(sound(rows), x.astype(int), c):
        for k, r in by[i].items():
            assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s))
            assert abs(r["explained"] / (e[k - 1] / total) - 1) < 1e-9 and r["identity_error"] < 1e-9
            assert abs(abs(r["whitened"]) - abs(centred @ v[:, k - 1] / math.sqrt(e[k - 1]))) < 1e-6
    for k in range(len(e)):  # one sign a component for all rows
        assert len({by[i][k + 1]["whitened"] * (d @ v[:, k]) > 0 for (i, _, _), d in zip(sound(rows), c) if abs(d @ v[:, k]) > 1}) == 1


@pytest.mark.parametrize("width, n", [(13, 300), (3, 50), (64, 120)])
def test_whitening(spark, tmp_path, width, n):
    scale = 10.0 ** -np.linspace(0, 2, width)
    data = [(i, (np.array(v) * scale).tolist(), i % 3) for i, v in enumerate(vectors_of(n, n, width))]
    data[5] = (5, data[5][1][: width - 1], 0)  # as if a zero followed
    data += odd_rows(width)[:4]
    whitened(data, queries.op12_whitening(spark, saved(spark, tmp_path, data)).collect(), width)


def test_whitening_at_the_edges(spark, tmp_path):
    assert queries.op12_whitening(spark, saved(spark, tmp_path / "a", [])).count() == 0
    assert queries.op12_whitening(spark, saved(spark, tmp_path / "b", [(1, [0.5, 0.25], 0)] * 4)).count() == 0  # no variance
    two = queries.op12_whitening(spark, saved(spark, tmp_path / "c", [(1, [0.5, 0.25], 0), (1, [0.5, 0.5], 0), (None, [0.5, 0.5], 0)])).collect()
    assert len(two) == 3 and {r["component"] for r in two} == {1} and {r["n"] for r in two} == {3}
    huge = whitening.whiten(spark.createDataFrame([(1, [2**39]), (2, [-(2**39)])], "vec_id long, x array<long>"), "x", 1).collect()
    assert {r["deviation"] for r in huge} == {None} and {round(abs(r["whitened"]), 9) for r in huge} == {1.0}


def test_jacobi_keeps_small_values():
    rng = np.random.default_rng(3)
    for d in (1, 2, 7, 32):
        q, _ = np.linalg.qr(rng.standard_normal((d, d)))
        want = 10.0 ** -np.linspace(0, 9, d)
        sigma, v = whitening.jacobi_svd(rng.permutation(np.eye(d)) @ np.diag(want) @ q.T if d > 1 else np.diag(want))
        assert np.allclose(sigma / want, 1, rtol=1e-10) and np.allclose(v.T @ v, np.eye(d), atol=1e-12)
    assert np.allclose(whitening.jacobi_svd(np.zeros((4, 3)))[0], 0)


def linked(rows, level=0.95):
    """(id, n_links, component, kept) of every row, by all pairs."""
    width = max(2, max([0, *(len(v) for _, v, _ in sound(rows))]))
    x = [None if v is None or None in v or not np.isfinite(v).all() or not np.any(v) else np.pad(np.array(v, dtype=np.float32).astype(float), (0, width - len(v))) for _, v, _ in rows]
    at = [k for k, v in enumerate(x) if v is not None]
    links, up = np.zeros(len(rows), dtype=int), list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    if at:
        m = np.array([x[k] / np.linalg.norm(x[k]) for k in at])
        for i, j in zip(*np.nonzero(np.triu(m @ m.T >= level, 1))):
            links[at[i]] += 1
            links[at[j]] += 1
            a, b = top(at[i]), top(at[j])
            up[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, int(links[k]), least.get(top(k)), i == least.get(top(k))) for k, (i, _, _) in enumerate(rows)), key=str)


def around(rng, base, noise, n):
    v = base + rng.standard_normal((n, len(base))) * noise * np.linalg.norm(base) / math.sqrt(len(base))
    return v.astype(np.float32).tolist()


def near_data(seed=5, width=48, n=500):
    """Single vectors, a tight group with a third of all rows, a loose one, a chain, exact and scaled copies."""
    rng = np.random.default_rng(seed)
    v = vectors_of(seed, n, width)
    v += around(rng, np.array(v[0]), 0.09, 400) + around(rng, np.array(v[1]), 0.19, 150) + around(rng, np.array(v[2]), 0.24, 60)
    step, side = np.array(v[3]) / np.linalg.norm(v[3]), rng.standard_normal(width)
    side -= (side @ step) * step
    side /= np.linalg.norm(side)
    v += [(math.cos(0.2 * k) * step + math.sin(0.2 * k) * side).astype(np.float32).tolist() for k in range(12)]
    v += [v[4]] * 5 + [[2 * c for c in v[5]], [4 * c for c in v[5]]]
    order = list(range(len(v)))
    random.Random(seed).shuffle(order)
    return [(i, v[k], i % 10) for i, k in enumerate(order)] + odd_rows(width)


@pytest.mark.parametrize("part, real", [(2048, "float"), (64, "double")])
def test_near_vectors(spark, monkeypatch, part, real):
    """Small parts: the tight group's cell is cut, its balls meet again, and places are split."""
    monkeypatch.setattr(near_vectors, "LARGE", 4 if part < 100 else near_vectors.LARGE)
    monkeypatch.setattr(near_vectors, "FAN", 3)
    data = near_data()
    rows = table(spark, data).repartition(4)
    got = near_vectors.near_duplicates(rows.withColumn("embedding", rows.embedding.cast(f"array<{real}>")), part=part)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got, want = sorted(map(tuple, got.collect()), key=str), linked(data)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))  # no pair below the level
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    assert sum(g[2:] == w[2:] for g, w in zip(got, want)) >= 0.99 * len(want)


def test_near_vectors_at_the_edges(spark, tmp_path):
    assert queries.op13_near_vectors(spark, saved(spark, tmp_path / "a", [])).count() == 0
    nothing = odd_rows(4)
    assert sorted(map(tuple, queries.op13_near_vectors(spark, saved(spark, tmp_path / "b", nothing)).collect()), key=str) == linked(nothing)
    # repeats of an id, rows without one, vectors of unlike length, a single entry
    few = [(7, [1.0, 2.0], 1), (7, [1.0, 2.0], 1), (7, [-3.0, 1.0], 1), (None, [2.0, 4.0], 1), (3, [1.0, 2.0, 0.0], 1), (None, [0.0, 0.0, 5.0], 1), (9, [], 1), (4, [-2.0], 1)]
    got = sorted(map(tuple, queries.op13_near_vectors(spark, saved(spark, tmp_path / "c", few)).collect()), key=str)
    assert got == [(a, b, c, a is None and c is None or d) for a, b, c, d in linked(few)]


def test_ball_members_are_linked():
    rng = np.random.default_rng(2)
    v = vectors.unit(np.array(around(rng, rng.standard_normal(40), 0.12, 300) + vectors_of(9, 100, 40)))
    found = near_vectors.balls(v, 0.95, np.float32)
    assert found and all((v[m] @ v[m].T >= 0.95).all() for m, _, _ in found)
    assert len(np.concatenate([m for m, _, _ in found])) == len(set(np.concatenate([m for m, _, _ in found]).tolist())) >= 290
