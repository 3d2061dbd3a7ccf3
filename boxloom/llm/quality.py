"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w . x - t_k) with one weight vector over hashed text features and ordered
thresholds t_1 < t_2. The expected grade is the sum of these tails; selection goes by the tail
probability of the best grade. The fit uses a bounded sample of rated documents (the SAMPLE with the
smallest hashed ids), in one task; scoring reads all documents in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import table
from boxloom.llm.hashing import WordHash, words_of

BITS = 16
#: Bound of the fitting sample, in documents. Of a longer document the fit reads all words too.
SAMPLE = 6000
GRADES = 3
LEAST_TAIL = 0.5
WORD_SCALE = 0.3
#: Features below this number are marks of shape, the others words.
MARKS = 1024
#: Features of fewer sampled documents get no weight; they would only be learned by heart.
LEAST_DOCUMENTS = 8
_HASH = WordHash()


def featurise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct feature numbers, values): words, their punctuation, case and repetition.

    Words count by the logarithm of their number, whatever the length: one word can tell. Marks of
    shape are shares of words, so that they mean the same in documents of every length.
    """
    raw = text.encode("utf-8", "surrogatepass").split() if text else []
    low = [w.lower() for w in raw]
    n = len(raw)
    if not n:
        return np.array([1], dtype=np.int64), np.array([1.0])
    size = 1 << BITS
    ids = np.fromiter((_HASH[w.strip(b".,;:!?\"'()")] for w in low), dtype=np.int64, count=n) % (size - MARKS) + MARKS
    at, count = np.unique(ids, return_counts=True)
    value = np.log1p(count) * WORD_SCALE
    ends = [w[len(w.rstrip(b"!#$%&*|.,;:?")):] for w in low]
    marks: dict[bytes, int] = {}
    for e in ends:
        if e:
            marks[e] = marks.get(e, 0) + 1
    shares = {b"\x00end:" + e: c / n for e, c in marks.items()}
    shares[b"\x00upper"] = sum(w.isupper() and len(w) > 1 for w in raw) / n
    shares[b"\x00repeat"] = sum(a == b for a, b in zip(low, low[1:])) / n
    shares[b"\x00distinct"] = len(set(low)) / n
    shares[b"\x00bar"] = sum(w == b"|" for w in low) / n
    shares[b"\x00one"] = 0.5
    more = np.fromiter((_HASH[k] % MARKS for k in shares), dtype=np.int64, count=len(shares))
    return np.concatenate([at, more]), np.concatenate([value, np.fromiter(shares.values(), float, len(shares)) * 2])


def fit(texts: list[str | None], grades: np.ndarray, steps: int = 1800, batch: int = 64, rate: float = 0.3, l1: float = 0.0003, l2: float = 1e-6, seed: int = 3) -> np.ndarray:
    """Weights and thresholds as one vector (2 ** BITS + GRADES - 1), by AdaGrad on the likelihood."""
    size = 1 << BITS
    rows = [featurise(t) for t in texts]
    having = np.bincount(np.concatenate([r[0] for r in rows]), minlength=size)
    # words of nearly every document say little, but would add up over a long one
    scale = np.log((len(rows) + 1) / (having + 1.0))
    scale[:MARKS] = 1.0
    scale[having < min(LEAST_DOCUMENTS, len(rows))] = 0.0
    rows = [(at[scale[at] > 0], (value * scale[at])[scale[at] > 0]) for at, value in rows]
    rng = np.random.default_rng(seed)
    w, cut = np.zeros(size), np.array([0.0, np.log(0.5)])  # t_1, log(t_2 - t_1)
    seen, seen_cut = np.full(size, 1e-8), np.full(2, 1e-8)
    for _ in range(-(-steps // -(-len(rows) // batch))):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            at = np.concatenate([rows[i][0] for i in part])
            val = np.concatenate([rows[i][1] for i in part])
            own = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            z = np.bincount(own, w[at] * val, len(part))
            t = np.array([cut[0], cut[0] + np.exp(cut[1])])
            y = grades[part]
            p = 1 / (1 + np.exp(-np.clip(z[:, None] - t, -30, 30)))
            # likelihood of grade k: tail k less tail k + 1
            tails = np.concatenate([np.ones((len(part), 1)), p, np.zeros((len(part), 1))], 1)
            hi, lo = tails[np.arange(len(part)), y], tails[np.arange(len(part)), y + 1]
            like = np.maximum(hi - lo, 1e-9)
            dhi, dlo = hi * (1 - hi) / like, lo * (1 - lo) / like
            dz = (dlo - dhi) / len(part)
            dt = np.zeros(2)
            for k in range(2):
                dt[k] = (np.where(y == k + 1, dhi, 0) - np.where(y == k, dlo, 0)).sum() / len(part)
            g = np.bincount(at, dz[own] * val, size) + l2 * w
            gc = np.array([dt[0] + dt[1], dt[1] * np.exp(cut[1])])
            for x, gr, past in ((w, g, seen), (cut, gc, seen_cut)):
                past += gr * gr
                x -= rate * gr / np.sqrt(past)
            # proximal step: words without steady evidence go back to zero, which labels given in error call for
            w[MARKS:] = np.sign(w[MARKS:]) * np.maximum(np.abs(w[MARKS:]) - rate * l1 / np.sqrt(seen[MARKS:]), 0)
    return np.concatenate([w * scale, [cut[0], cut[0] + np.exp(cut[1])]])


def tails(text: str | None, model: np.ndarray) -> tuple[float, float]:
    at, value = featurise(text)
    z = float((model[at] * value).sum())
    return tuple(1 / (1 + np.exp(-np.clip(z - t, -30, 30))) for t in model[1 << BITS :])


def grade_of(quality: Column, toxic: Column) -> Column:
    """0: poor, 1: good but toxic, 2: good; null where the quality is unknown (unknown toxicity is none)."""
    return F.when(quality == 0, 0).when((quality == 1) & (F.coalesce(toxic, F.lit(0)) == 1), 1).when(quality == 1, 2)


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """ratings (doc_id, grade). None without a rated document; a null grade or id is no rating.

    Of several ratings of a document the smallest counts. The ids chosen are at most ``sample``, so
    the small side of the join is bounded, and so is what the one fitting task gets by an exchange of its own.
    """
    rated = ratings.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    found = docs.select("doc_id", "text").join(F.broadcast(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)), "doc_id")

    def fit_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if sum(map(len, rows)):
            every = pd.concat(rows)  # one row per id, in an order that no schedule of tasks changes
            every = every.assign(known=every["text"].fillna("")).sort_values(["doc_id", "known"]).drop_duplicates("doc_id")
            yield pd.DataFrame({"w": [fit(list(every["text"]), every["grade"].to_numpy(dtype=np.int64)).tobytes()]})

    got = found.repartition(1).mapInPandas(fit_all, "w binary").collect()
    return np.frombuffer(got[0]["w"]) if got else None


def score(docs: DataFrame, model: np.ndarray | None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns of docs, expected_grade, tail_good: one row per row of docs; without a model all pass as best.

    A null text counts as empty. Rows are scored by their text alone.
    """
    if model is None:
        return docs.select(*columns, F.lit(GRADES - 1.0).alias("expected_grade"), F.lit(1.0).alias("tail_good"))
    shared = docs.sparkSession.sparkContext.broadcast(model.astype(np.float64))  # half a megabyte

    @F.pandas_udf("expected_grade double, tail_good double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        got = [tails(t, shared.value) for t in texts]
        return pd.DataFrame({"expected_grade": [a + b for a, b in got], "tail_good": [b for _, b in got]})

    scored = docs.select(*columns, judged("text").alias("judged"))
    return scored.select(*columns, "judged.expected_grade", "judged.tail_good")


def table_ratings(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))


def select_good(docs: DataFrame, ratings: DataFrame, least_tail: float = LEAST_TAIL) -> DataFrame:
    """The rows of docs whose tail probability of the best grade is least_tail or more."""
    names = tuple(docs.columns)
    packed = docs.select("doc_id", "text", F.struct(*names).alias("row"))
    kept = score(packed, train(packed, ratings), ("row",)).filter(F.col("tail_good") >= least_tail)
    return kept.select(*[F.col("row")[c].alias(c) for c in names])
