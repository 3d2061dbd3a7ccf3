"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) * P(leaf | class, history) * P(word | leaf). The first two
factors are softmaxes over WIDTH outcomes with hashed features of the history: the word before, the
word before that alone (a skip feature), both together, and the leaves of both; within a class the
features are hashed together with the class. The OWN most frequent words are leaves of their own, so
histories tell them apart to the last; all others share leaves by their ending, unseen words too, and
within such a leaf a word has its smoothed share of the leaf's counts. Training is one epoch of
distributed gradient updates: every task runs AdaGrad on its documents from the same start, and
parameters are averaged, weighted by how often each was updated, in the order of the tasks. Words are
64-bit hashes throughout. Exact counts of frequent words are broadcast (a bounded number); all other
words of the texts get theirs by a join.

Counts grow with the input, the softmaxes' tables do not: every task trains a copy of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import as_text, small_batches, staged
from boxloom.llm.hashing import codes_of, mix64, pieces, split_words

#: Classes, and leaves of a class.
WIDTH = 16
LEAVES = WIDTH * WIDTH
#: Words with a leaf of their own; the other leaves are shared.
OWN = LEAVES // 2
#: Rows of the hashed table of either softmax: 2 ** FEATURE_BITS.
FEATURE_BITS = 16
#: So many words at most have their counts broadcast.
FREQUENT = 200_000
CHUNKS = 256
#: Characters hashed together, and tokens counted together.
BATCH_CHARS, COUNT_TOKENS = 1 << 17, 1 << 22
#: A softmax whose logits stay within this bound needs no shift by its largest.
SAFE_LOGIT = 60.0
END = np.uint64(1)
_MASK = np.uint64((1 << FEATURE_BITS) - 1)
_OF_CLASS = (mix64(np.arange(1, WIDTH + 1, dtype=np.uint64)) & _MASK)


def held_out(docs: DataFrame) -> DataFrame:
    """docs with held_out: crc32 of the id as text, mod 10, is 0; a null id counts as empty text, which is held out."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select(as_text("doc_id"), "text", (crc % 10 == 0).alias("held_out"))


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the tokens, shared leaf of each by its last two bytes, number of tokens by text); the end is a token."""
    joined, start, length, count = split_words(texts)
    data = np.frombuffer(joined, dtype=np.uint8).astype(np.uint64)
    last = start + length - 1
    tail = data[last] * np.uint64(256) + np.where(length > 1, data[np.maximum(last - 1, 0)], np.uint64(0))
    shared = (mix64(tail) % np.uint64(LEAVES - OWN)).astype(np.int64) + OWN
    size = count + 1
    ends = np.cumsum(size) - 1
    is_word = np.ones(int(size.sum()), dtype=bool)
    is_word[ends] = False
    token, leaf = np.full(len(is_word), END), np.full(len(is_word), OWN)
    token[is_word], leaf[is_word] = codes_of(joined, start, length), shared
    return token, leaf, size


def word_counts(docs: DataFrame) -> DataFrame:
    """(code, shared leaf, c) of the tokens of the training documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out() -> pd.DataFrame:
            token, at, many = np.unique(np.concatenate([p[0] for p in held]), return_index=True, return_counts=True)
            return pd.DataFrame({"code": token.view(np.int64), "leaf": np.concatenate([p[1] for p in held])[at], "c": many})

        held, size = [], 0
        for batch in batches:
            for run in pieces(batch["text"], BATCH_CHARS * 8):
                held.append(tokens_of(run)[:2])
                size += len(held[-1][0])
                if size >= COUNT_TOKENS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    rows = docs.filter("not held_out").select("text").mapInPandas(count, "code long, leaf int, c long")
    return staged(rows.groupBy("code").agg(F.max("leaf").alias("leaf"), F.sum("c").alias("c")))


def frequent_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of at most ``most`` words, sorted by hash: all with a count above one found from a histogram.

    The histogram has eight cells a doubling, and the words that pass it are bounded before they are collected.
    """
    cell = F.floor(F.log2(F.col("c")) * 8)
    cells = sorted(((r["cell"], r["words"]) for r in counts.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    least, total = None, 0
    for at, words in cells:
        total += words
        if total > most:
            break
        least = at
    rows = counts.filter(cell >= least).select("code", "c").collect() if least is not None else []
    code, c = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(2))
    order = np.argsort(code.view(np.uint64))
    return code.view(np.uint64)[order], c[order]


def own_leaves(code: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted; leaf of each) of the OWN words of the largest counts, WIDTH words of like count a class."""
    top = np.lexsort((code, -c))[:OWN]
    rank = np.arange(len(top))
    order = np.argsort(code[top])
    return code[top][order], rank[order]


def look_up(token: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted array, whether the token is there)."""
    if not len(among):
        return np.zeros(len(token), dtype=np.int64), np.zeros(len(token), dtype=bool)
    at = np.minimum(np.searchsorted(among, token), len(among) - 1)
    return at, among[at] == token


def leaves_of(token: np.ndarray, shared: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    at, is_own = look_up(token, own[0])
    return np.where(is_own, own[1][at], shared) if len(own[0]) else shared


def features(token: np.ndarray, leaf: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the four features of every token's history; what lies before a document's first token is an edge."""
    first = np.repeat(np.cumsum(size) - size, size)
    place = np.arange(len(token)) - first
    edge = np.uint64(0)
    one = np.where(place >= 1, np.roll(token, 1), edge)
    two = np.where(place >= 2, np.roll(token, 2), edge)
    l1 = np.where(place >= 1, np.roll(leaf, 1), LEAVES).astype(np.uint64)
    l2 = np.where(place >= 2, np.roll(leaf, 2), LEAVES).astype(np.uint64)
    hashed = lambda x, salt: mix64(x + np.uint64(salt))
    return hashed(one, 1), hashed(two, 2), hashed(one * np.uint64(31) + mix64(two), 3), hashed(l1 * np.uint64(LEAVES + 1) + l2, 4)


def class_slots(hashed: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    return tuple((h & _MASK).astype(np.uint16) for h in hashed)


def leaf_slots(hashed: tuple[np.ndarray, ...], cls: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple((((h >> np.uint64(20)) & _MASK) ^ _OF_CLASS[cls]).astype(np.uint16) for h in hashed)


class Softmax:
    """Weights of hashed features and of a bias row per group, for WIDTH outcomes."""

    def __init__(self, groups: int, theta: np.ndarray | None = None):
        self.rows = (1 << FEATURE_BITS) + groups
        self.theta = np.zeros((self.rows, WIDTH), dtype=np.float32) if theta is None else theta
        self.table, self.bias = self.theta[:-groups], self.theta[-groups:]

    def logits(self, slots: tuple[np.ndarray, ...], group: np.ndarray) -> np.ndarray:
        """Up to a shift of each row; of a size that exp() can take."""
        z = self.bias.take(group, axis=0)
        for s in slots:
            z += self.table.take(s, axis=0)
        if max(z.max(initial=0), -z.min(initial=0)) > SAFE_LOGIT:
            z -= z.max(1, keepdims=True)
        return z

    def logp(self, slots: tuple[np.ndarray, ...], group: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        z = self.logits(slots, group)
        own = z[np.arange(len(outcome)), outcome]
        return own - np.log(np.exp(z, out=z) @ np.ones(WIDTH, dtype=z.dtype))

    def begin(self) -> None:
        self.past, self.used = np.zeros_like(self.theta), np.zeros(self.rows)

    def descend(self, slots: tuple[np.ndarray, ...], group: np.ndarray, outcome: np.ndarray, rate: float) -> None:
        """One AdaGrad step: a row moves by the gradient of the tokens that have it."""
        g = self.logits(slots, group)
        np.exp(g, out=g)
        g /= (g @ np.ones(WIDTH, dtype=g.dtype))[:, None]
        g[np.arange(len(g)), outcome] -= 1
        for s, base in (*((s, 0) for s in slots), (group.astype(np.uint16), 1 << FEATURE_BITS)):
            order = np.argsort(s, kind="stable")  # a radix sort of 16-bit numbers
            in_order = s[order]
            begin = np.flatnonzero(np.diff(in_order.astype(np.int32), prepend=-1))
            at, many = in_order[begin].astype(np.int64) + base, np.diff(begin, append=len(s))
            mean = np.add.reduceat(g.take(order, axis=0), begin, axis=0)
            mean /= np.sqrt(many).astype(np.float32)[:, None]
            seen = self.past.take(at, axis=0)
            seen += mean * mean
            self.past[at] = seen
            seen += 1e-3
            mean *= rate
            mean /= np.sqrt(seen, out=seen)
            self.theta[at] -= mean
            self.used[at] += many


def new_model() -> tuple[Softmax, Softmax]:
    """The softmax of classes and that of the leaves of a class."""
    return Softmax(1), Softmax(WIDTH)


def leaf_logp(model: tuple[Softmax, Softmax], hashed: tuple[np.ndarray, ...], leaf: np.ndarray) -> np.ndarray:
    """Natural logarithm of the first two factors."""
    cls, inner = leaf // WIDTH, leaf % WIDTH
    return model[0].logp(class_slots(hashed), np.zeros(len(leaf), dtype=np.int64), cls) + model[1].logp(leaf_slots(hashed, cls), cls, inner)


def learn(model: tuple[Softmax, Softmax], hashed: tuple[np.ndarray, ...], leaf: np.ndarray, rate: float) -> None:
    """Small steps at first and larger ones later."""
    cls, inner = leaf // WIDTH, leaf % WIDTH
    slots = class_slots(hashed), leaf_slots(hashed, cls)
    piece = 256 if model[0].used[-1] < 50_000 else 4096
    for a in range(0, len(leaf), piece):
        b = a + piece
        model[0].descend(tuple(s[a:b] for s in slots[0]), np.zeros(len(leaf[a:b]), dtype=np.int64), cls[a:b], rate)
        model[1].descend(tuple(s[a:b] for s in slots[1]), cls[a:b], inner[a:b], rate)


def train(docs: DataFrame, own: tuple[np.ndarray, np.ndarray], rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """The weights of both softmaxes: what reaches the driver is one such pair."""
    rows = [m.rows for m in new_model()]
    span = -(-sum(rows) // CHUNKS)

    def epoch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = new_model()
        for m in model:
            m.begin()
        for batch in batches:
            for run in pieces(batch["text"], BATCH_CHARS):
                token, shared, size = tokens_of(run)
                leaf = leaves_of(token, shared, own)
                learn(model, features(token, leaf, size), leaf, rate)
        if model[0].used.any():
            weight = np.sqrt(np.concatenate([m.used for m in model]))[:, None]
            both = np.concatenate([np.concatenate([m.theta for m in model]), weight], 1).astype(np.float16)
            part = TaskContext.get().partitionId()
            yield pd.DataFrame({"chunk": range(CHUNKS), "part": part, "sums": [both[k * span : (k + 1) * span].tobytes() for k in range(CHUNKS)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by chunk and task: the mean does not depend on what arrives first."""
        chunk, total = None, None

        def out() -> pd.DataFrame:
            mean = total[:, :WIDTH] / np.maximum(total[:, WIDTH:], 1e-9)
            return pd.DataFrame({"chunk": [chunk], "mean": [mean.astype(np.float32).tobytes()]})

        for batch in batches:
            for k, data in zip(batch["chunk"], batch["sums"]):
                got = np.frombuffer(data, dtype=np.float16).reshape(-1, WIDTH + 1).astype(np.float64)
                got[:, :WIDTH] *= got[:, WIDTH:]
                if k != chunk:
                    if chunk is not None:
                        yield out()
                    chunk, total = k, got
                else:
                    total += got
        if chunk is not None:
            yield out()

    parts = docs.filter("not held_out").select("text").mapInPandas(epoch, "chunk int, part int, sums binary")
    with small_batches(docs.sparkSession):
        got = parts.repartition(CHUNKS // 4, "chunk").sortWithinPartitions("chunk", "part").mapInPandas(add, "chunk int, mean binary").collect()
    if not got:
        return tuple(m.theta for m in new_model())
    both = np.concatenate([np.frombuffer(bytes(r["mean"]), dtype=np.float32) for r in sorted(got, key=lambda r: r["chunk"])]).reshape(-1, WIDTH)
    return both[: rows[0]], both[rows[0] :]


def score(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (A-Z lower-cased, split at ASCII blanks) and one end. base_score: the sum of
    log10((c + 0.1) / (N + 0.1 * (V + 1))) with exact counts over all training documents. score: the
    model's log10 probability, in which each leaf keeps one smoothed share for unseen words. A null
    text counts as empty: its only token is the end. Repeated rows and ids score alike. Without
    training documents N and V are 0; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = held_out(docs)
    counts = word_counts(docs)
    known = frequent_words(counts, frequent)
    own = own_leaves(*known)
    of_own = spark.createDataFrame([(int(c), int(k)) for c, k in zip(own[0].view(np.int64), own[1])], "code long, own int")  # OWN rows at most
    leaf = F.coalesce("own", "leaf")
    by_leaf = {r["leaf"]: r for r in counts.join(F.broadcast(of_own), "code", "left").groupBy(leaf.alias("leaf")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    n_leaf, v_leaf = (np.array([by_leaf[k][x] if k in by_leaf else 0 for k in range(LEAVES)], dtype=np.float64) for x in "nv")
    total, vocabulary = int(n_leaf.sum()), int(v_leaf.sum())
    in_leaf = np.log10(n_leaf + 0.1 * (v_leaf + 1))
    shared = spark.sparkContext.broadcast((train(docs, own), own, known, in_leaf))  # 8 MB of weights, 16 bytes a frequent word

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, own, (codes, counted), norm = shared.value
        model = Softmax(1, weights[0]), Softmax(WIDTH, weights[1])
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            made = []
            for run in pieces(batch["text"], BATCH_CHARS):
                token, of_end, size = tokens_of(run)
                leaf = leaves_of(token, of_end, own)
                logp = leaf_logp(model, features(token, leaf, size), leaf) / np.log(10) - norm[leaf]
                at, is_known = look_up(token, codes)
                c = np.where(is_known, counted[at], 0) if len(codes) else np.zeros(len(token), dtype=np.int64)
                begin = np.cumsum(size) - size
                sums = [np.add.reduceat(x, begin) for x in (logp, np.where(c > 0, np.log10(c + 0.1), 0.0), (c > 0).astype(np.int64))]
                rest = np.flatnonzero(c == 0)
                cuts = np.searchsorted(rest, np.cumsum(size)[:-1])
                made.append(pd.DataFrame({"n_tokens": size, "logp": sums[0], "logc": sums[1], "known": sums[2], "rare": np.split(token.view(np.int64)[rest], cuts)}))
            if made:
                out = pd.concat(made, ignore_index=True)
                out.insert(0, "row", np.arange(row, row + len(out)))
                row += len(out)
                yield out.assign(doc_id=batch["doc_id"].array, held_out=batch["held_out"].array)

    schema = "row long, n_tokens long, logp double, logc double, known long, rare array<long>, doc_id string, held_out boolean"
    scored = staged(docs.mapInPandas(judge, schema))
    rare = scored.select("row", F.explode("rare").alias("code"))
    found = (
        rare.groupBy("row", "code").agg(F.count(F.lit(1)).alias("times")).join(counts.select("code", "c"), "code", "left")
        .groupBy("row").agg(
            F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("more_logc"),
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        )
    )
    each = F.log10(F.lit(total + 0.1 * (vocabulary + 1)))
    logc = F.col("logc") + F.coalesce("more_logc", F.lit(0.0))
    return scored.drop("rare").join(found, "row", "left").select(
        F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (logc - F.col("n_tokens") * each).alias("base_score"),
        (F.col("logp") + logc).alias("score"),
    )
