"""Similarity join of documents by the Jaccard similarity of their word n-grams, over prefix trees.

1. All n-grams have one global order: those that very many sets begin with last, the others by their
   hash. Documents with equal sets (128-bit digests) form a class; one document stands for it.
2. Sets that reach the similarity share several of their first ids (heads), the more the larger they
   are: 1 + n // GAIN of the first n - ceil(t n) + 1 + n // GAIN. Heads are sorted by id and size.
   Of a run of few sets every pair is counted, and counts once it shares enough; a long run becomes a
   chain of neighbours in size, never all pairs. What is connected then is a group beyond which no
   link goes; an n-gram that two long texts share by chance connects nothing.
3. A group is joined by a trie: stored sets are paths of ids in order; all probes descend level by
   level, sets with a common path share the overlap counted so far, and a subtree is left as soon as
   its remaining lengths cannot reach the bound. A subtree of one set is counted to its end at once,
   but only while probe and set are not yet connected by links.
4. Large groups are dealt out in chunks, each with the same few leaders, so copies of one text are
   connected at linear cost. Only sets outside a group's largest component then meet all blocks of
   like size, which makes the join whole.
5. Links that span the groups (not all links) give the components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import as_text, broadcast_if_small, connected_components, discard, drop_listed, id_filter, may_hold, staged
from boxloom.llm.hashing import mix64, pieces, word_codes

#: A set of n ids has n // GAIN heads more than the plain prefix bound asks for, and shares as many more.
GAIN = 32
#: Ids stored beyond the heads, one part in SLACK: so many may go to the end of the order without a second look at the text.
SLACK = 10
#: Every pair counts in runs of up to PAIRS sets, a bounded number a set; an id that more than HOT sets begin with goes to the end of the order.
PAIRS, HOT = 16, 16
#: At most so many ids go there, those that most sets begin with (4 MB as a broadcast).
MAX_HOT = 500_000
#: Groups of more classes than this are dealt out; each chunk has about LEADERS sets of all chunks.
UNIT, LEADERS = 256, 8
#: Lists of up to so many ids (16 MB) are broadcast, longer ones joined by a shuffle.
MAX_BROADCAST = 1_000_000
#: Ids looked up in one step of counting tails.
STEP = 1 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _chain(codes: np.ndarray, k: int) -> np.ndarray:
    """63-bit ids of all runs of k words."""
    span = len(codes) - k + 1
    h = np.full(span, k, dtype=np.uint64)
    for j in range(k):
        h = mix64(h * _SPREAD + codes[j : j + span])
    return (h >> np.uint64(1)).astype(np.int64)


def ngram_sets(texts, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct ids of the n-grams of every text; a shorter word sequence is one n-gram."""
    for run in pieces(list(texts)):
        codes, count = word_codes(run)
        grams = _chain(codes, n) if len(codes) >= n else np.empty(0, dtype=np.int64)
        at = 0
        for k in count.tolist():
            if k >= n:
                yield np.unique(grams[at : at + k - n + 1])
            else:
                yield _chain(codes[at : at + k], k) if k else np.empty(0, dtype=np.int64)
            at += k


def set_key(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.tobytes(), digest_size=16).digest()


def shared_least(n):
    """So many heads two linked sets share at least: the smaller of their two numbers."""
    return 1 + n // GAIN


def head_count(n, percent: int):
    return n - -(-percent * n // 100) + shared_least(n)


def stored_count(n: int, percent: int) -> int:
    return min(n, head_count(n, percent) + n // SLACK)


def pack(ids: np.ndarray) -> bytes:
    """The upper 48 bits of sorted ids, six bytes each: enough to find what sets may share."""
    return (ids >> 15).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<i8").ravel()


def in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def heads_of(low: np.ndarray, n: int, percent: int, hot: np.ndarray) -> np.ndarray | None:
    """The first ids in the global order from the stored ones; None where those do not tell."""
    last = in_sorted(low, hot)
    if not last.any():
        return low[: head_count(n, percent)]
    want = min(n, head_count(n, percent))
    if len(low) < n and len(low) - last.sum() < want:
        return None
    return np.concatenate([low[~last], low[last]])[:want]


def _head_rows(rows: list[tuple[int, int, np.ndarray]]) -> pd.DataFrame:
    many = [len(h) for *_, h in rows]
    return pd.DataFrame({
        "gram": np.concatenate([h for *_, h in rows]) if rows else np.empty(0, dtype=np.int64),
        "rid": np.repeat(np.array([r[0] for r in rows], dtype=np.int64), many), "n": np.repeat(np.array([r[1] for r in rows], dtype=np.int64), many),
    })


def near_runs(percent: int):
    """Rows (gram, n, rid) sorted by gram and n -> (a, b, need): pairs of short runs with the heads they must
    share, neighbours in size of long ones with need 0. One batch and the end of one run are held."""

    def edges(gram, n, rid, long_first: bool):
        begin = np.flatnonzero(np.diff(gram, prepend=gram[0] - 1)) if len(gram) else np.empty(0, dtype=np.int64)
        many = np.diff(begin, append=len(gram))
        is_long = many > PAIRS
        if long_first and len(begin):
            is_long[0] = True
        is_long = np.repeat(is_long, many)
        out = []
        for d in range(1, PAIRS):
            x = np.arange(max(0, len(gram) - d))
            y = x + d
            x, y = (v[(gram[x] == gram[y]) & (~is_long[x] | (d == 1)) & (100 * n[x] >= percent * n[y]) & (rid[x] != rid[y])] for v in (x, y))
            out.append((np.minimum(rid[x], rid[y]), np.maximum(rid[x], rid[y]), np.where(is_long[x], 0, shared_least(n[x]))))
        a, b, need = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"a": a, "b": b, "need": need})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("gram", "n", "rid")
        held, long_held = [np.empty(0, dtype=np.int64)] * 3, False
        for batch in batches:
            rows = [np.concatenate([h, batch[c].to_numpy(dtype=np.int64)]) for h, c in zip(held, names)]
            if not len(rows[0]):
                continue
            open_ = int(np.searchsorted(rows[0], rows[0][-1]))
            if open_:
                yield edges(*(r[:open_] for r in rows), long_held)
                long_held = False
            held = [r[open_:] for r in rows]
            if len(held[0]) > PAIRS or long_held:
                yield edges(*held, True)
                held, long_held = [h[-1:] for h in held], True
        if len(held[0]):
            yield edges(*held, long_held)

    return run


class _Union:
    """Components of 0 .. count - 1, and the links that joined them."""

    def __init__(self, count: int):
        self.up, self.kept = list(range(count)), []

    def top(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, pairs) -> None:
        for a, b in pairs:
            x, y = self.top(a), self.top(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.kept.append((a, b))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        label = np.array([self.top(x) for x in range(len(self.up))], dtype=np.int64)
        return label[a] != label[b]


def _spread(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (many[0] of them), begin[1], ..."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)


def trie_links(unit: np.ndarray, side: np.ndarray, sets: list[np.ndarray], n: np.ndarray, percent: int) -> np.ndarray:
    """Index pairs of linked sets that span the components; pairs are a probe (side 0 or 2) and a stored set (1 or 2) of one unit.

    sets may lack ids that no other set has; n are their sizes with those.
    """
    union = _Union(len(sets))
    if not sets:
        return np.empty((0, 2), dtype=np.int64)
    length = np.array([len(s) for s in sets], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(length)])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = len(names) + 1
    key = np.repeat(np.arange(len(sets)), length) * size + flat  # sorted: by set, then by id
    units, root = np.unique(unit, return_inverse=True)
    row = np.flatnonzero((side >= 1) & (length > 0))
    node = root[row]  # the node each stored set has come to
    probe = np.flatnonzero((side != 1) & (length > 0))
    at, overlap = root[probe], np.zeros(len(probe), dtype=np.int64)
    tails = []

    def linked(o, p, r):
        return 100 * o >= percent * (n[p] + n[r] - o)

    depth = 0
    while len(row) and len(probe):
        step, node = np.unique(node * size + flat[start[row] + depth], return_inverse=True)
        parent, name = step // size, step % size
        shortest, largest, longest = np.full(len(step), 1 << 60), np.zeros(len(step), dtype=np.int64), np.zeros(len(step), dtype=np.int64)
        np.minimum.at(shortest, node, n[row])
        np.maximum.at(largest, node, n[row])
        np.maximum.at(longest, node, length[row])
        lo, hi = np.searchsorted(parent, at, "left"), np.searchsorted(parent, at, "right")
        many = hi - lo
        probe, overlap, at = np.repeat(probe, many), np.repeat(overlap, many), _spread(lo, many)
        want = probe * size + name[at]
        where = np.searchsorted(key, want)
        hit = key[np.minimum(where, len(key) - 1)] == want
        overlap = overlap + hit
        left = np.minimum(longest[at] - depth - 1, length[probe] - (where - start[probe]) - hit)
        own = n[probe]
        near = (100 * np.minimum(own, largest[at]) >= percent * own) & (100 * own >= percent * shortest[at])
        live = near & ((100 + percent) * (overlap + left) >= percent * (own + shortest[at]))
        probe, at, overlap = probe[live], at[live], overlap[live]
        depth += 1
        # subtrees of one set, and sets that end here, are counted apart from the descent
        alone = np.bincount(node, minlength=len(step)) == 1
        ends = np.flatnonzero(alone[node] | (length[row] == depth))
        if len(ends) and len(probe):
            ends = ends[np.argsort(node[ends], kind="stable")]
            lo, hi = np.searchsorted(node[ends], at, "left"), np.searchsorted(node[ends], at, "right")
            many = hi - lo
            p, r, o = np.repeat(probe, many), row[ends[_spread(lo, many)]], np.repeat(overlap, many)
            fits = (p != r) & ((side[p] != 2) | (side[r] != 2) | (p < r)) & (100 * np.minimum(n[p], n[r]) >= percent * np.maximum(n[p], n[r]))
            tails.append((p[fits], r[fits], o[fits], np.full(fits.sum(), depth)))
            on = ~alone[at]
            probe, at, overlap = probe[on], at[on], overlap[on]
        goes_on = ~alone[node] & (length[row] > depth)
        row, node = row[goes_on], node[goes_on]
    if not tails:
        return np.empty((0, 2), dtype=np.int64)
    p, r, o, d = (np.concatenate(c) for c in zip(*tails))
    while len(p):
        apart = union.apart(p, r)
        p, r, o, d = p[apart], r[apart], o[apart], d[apart]
        order = np.lexsort((r, p))
        first = np.zeros(len(p), dtype=bool)
        first[order[np.flatnonzero(np.diff(p[order], prepend=-1))]] = True  # one partner of every probe a time
        many = length[r[first]] - d[first]
        for part in np.split(np.arange(len(many)), np.flatnonzero(np.diff(np.cumsum(many) // STEP)) + 1):
            fp, fr, fm = p[first][part], r[first][part], many[part]
            want = np.repeat(fp, fm) * size + flat[_spread(start[fr] + d[first][part], fm)]
            hit = key[np.minimum(np.searchsorted(key, want), len(key) - 1)] == want
            total = o[first][part] + np.bincount(np.repeat(np.arange(len(fm)), fm), hit, len(fm)).astype(np.int64)
            good = linked(total, fp, fr)
            union.join(zip(fp[good].tolist(), fr[good].tolist()))
        p, r, o, d = p[~first], r[~first], o[~first], d[~first]
    return np.array(union.kept, dtype=np.int64).reshape(-1, 2)


def without_lone(unit: np.ndarray, sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets without ids that one set alone of these has."""
    names, flat, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = np.split(many[flat] > 1, np.cumsum([len(s) for s in sets])[:-1])
    return [s[k] for s, k in zip(sets, keep)]


def join_rows(percent: int):
    """A bin of rows (rid, unit, side, n, ids) -> links (a, b)."""

    def join_bin(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.drop_duplicates(["rid", "unit"])  # rows that repeat a document
        unit, rid = batch["unit"].to_numpy(), batch["rid"].to_numpy()
        ids = without_lone(unit, [np.frombuffer(s, dtype="<i8") for s in batch["ids"]])
        pairs = trie_links(unit, batch["side"].to_numpy(), ids, batch["n"].to_numpy(), percent)
        return pd.DataFrame({"a": rid[pairs[:, 0]], "b": rid[pairs[:, 1]]})

    return join_bin


def verify(docs: DataFrame, members: DataFrame, units: DataFrame, ngram: int, percent: int, unit: int) -> DataFrame:
    """members (rid, key, first_id, ...), units (rid, unit, side) -> spanning links (a, b) of the units, staged.

    The sets are cut from the texts again, only those that a bitmap of the members' ids lets through.
    """
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(members, "first_id", members.count()))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"][may_hold(bits.value, batch["doc_id"])]
            sets = [s for s in ngram_sets(texts, ngram) if len(s)]
            yield pd.DataFrame({"key": [set_key(s) for s in sets], "n": [len(s) for s in sets], "ids": [s.astype("<i8").tobytes() for s in sets]})

    sets = docs.select(as_text("doc_id"), "text").mapInPandas(cut, "key binary, n long, ids binary")
    units = staged(units.join(members.select("rid", "key"), "rid"))
    count = units.count()
    placed = sets.join(broadcast_if_small(units, MAX_BROADCAST // 4), "key").withColumn("bin", F.pmod("unit", F.lit(max(1, count // (2 * unit)))))
    links = staged(placed.groupBy("bin").applyInPandas(join_rows(percent), "a long, b long"))
    discard(units)
    return links


def chunks_with_leaders(large: DataFrame, unit: int) -> DataFrame:
    """large (rid, root, many) -> (rid, unit, side): every set in one chunk of its group, leaders in all."""
    chunks = F.ceil(F.col("many") / unit)
    leads = F.pmod(F.xxhash64("rid", F.lit(1)), F.col("many")) < LEADERS
    own = F.array(F.pmod(F.xxhash64("rid", F.lit(2)), chunks))
    each = F.explode(F.when(leads, F.sequence(F.lit(0).cast("long"), chunks - 1)).otherwise(own)).alias("chunk")
    return large.select("rid", "root", each).select("rid", F.xxhash64("root", "chunk").alias("unit"), F.lit(2).alias("side"))


def blocks_of_rest(large: DataFrame, percent: int, unit: int) -> DataFrame:
    """large (rid, root, n, rest) -> (rid, unit, side): blocks of like size, of which one holds sets of the rest, meet.

    Sizes of linked sets lie within one band of width 1 / t of each other, so a block meets those of
    its own and the two neighbouring bands. Sets outside the rest are one component: they do not meet.
    """
    width = math.log(100 / percent) * 1.000001
    large = large.withColumn("band", F.floor(F.log("n") / width))
    blocks = staged(large.groupBy("root", "band", "rest").agg(F.ceil(F.count(F.lit(1)) / (unit // 2)).alias("blocks")))
    there = blocks.select("root", F.col("band").alias("band2"), F.col("rest").alias("rest2"), F.col("blocks").alias("blocks2"))
    own = large.join(blocks, ["root", "band", "rest"]).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    met = own.join(there, "root").filter("abs(band - band2) <= 1 and (rest or rest2)")
    met = met.select("rid", "root", F.struct("band", "rest", "block").alias("home"), "band2", "rest2",
                     F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks2") - 1)).alias("block2"))
    home, other = F.col("home"), F.struct(F.col("band2").alias("band"), F.col("rest2").alias("rest"), F.col("block2").alias("block"))
    side = F.when(home == other, 2).when(home < other, 0).otherwise(1)
    return met.select("rid", F.xxhash64("root", F.least(home, other), F.greatest(home, other)).alias("unit"), side.alias("side"))


def _pick_hot(counts: DataFrame, most: int) -> np.ndarray:
    """Sorted ids of counts (gram, many), of which at most ``most``, those of the largest counts."""
    by_count = sorted(((r["many"], r["grams"]) for r in counts.groupBy("many").agg(F.count(F.lit(1)).alias("grams")).collect()), reverse=True)
    least, total = None, 0
    for many, grams in by_count:
        total += grams
        if total > most:
            break
        least = many
    if least is None:
        return np.empty(0, dtype=np.int64)
    return np.sort(np.array([r["gram"] for r in counts.filter(F.col("many") >= least).select("gram").collect()], dtype=np.int64))


def _components(docs: DataFrame, ngram: int, percent: int, unit: int, max_hot: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n, key, digest; classes: key, first_id, root, one row a set), both staged."""
    spark = docs.sparkSession
    docs = docs.select(as_text("doc_id"), "text")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = [(len(s), set_key(s) if len(s) else None, pack(s[: stored_count(len(s), percent)])) for s in ngram_sets(batch["text"], ngram)]
            digest = [None if t is None else hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].array, "rid": np.arange(rid, rid + len(out)), "n": [o[0] for o in out],
                "key": [o[1] for o in out], "digest": digest, "low": [o[2] for o in out],
            })
            rid += len(out)

    described = staged(docs.mapInPandas(describe, "doc_id string, rid long, n long, key binary, digest string, low binary").withColumn("doc_id", F.col("doc_id").cast("long")))
    worded = described.filter("n > 0")
    classes = staged(worded.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.min("rid").alias("rid"), F.max("n").alias("n")))
    copies = staged(worded.select("rid").join(classes.select("rid"), "rid", "left_anti"))
    sets = worded.select("rid", "n", "low").join(broadcast_if_small(copies, MAX_BROADCAST), "rid", "left_anti")

    # ids that many sets begin with go to the end of the order
    def first_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            low = [unpack(d) for d in batch["low"]]
            yield pd.DataFrame({"gram": np.concatenate(low) if low else np.empty(0, dtype=np.int64)})

    counts = staged(sets.select("low").mapInPandas(first_ids, "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > HOT))
    hot = spark.sparkContext.broadcast(_pick_hot(counts, max_hot))

    # sets most of whose stored ids went to the end are looked at again in full
    def unclear(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            on = [heads_of(unpack(d), n, percent, hot.value) is None for d, n in zip(batch["low"], batch["n"])]
            yield batch.loc[on, ["rid"]]

    deep = staged(classes.join(sets.mapInPandas(unclear, "rid long"), "rid"))
    bits = spark.sparkContext.broadcast(id_filter(deep, "first_id", deep.count()))

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(rid, n, heads_of(unpack(d), n, percent, hot.value)) for rid, n, d in zip(batch["rid"], batch["n"], batch["low"])]
            yield _head_rows([r for r in rows if r[2] is not None])

    def deep_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [s for s in ngram_sets(batch["text"][may_hold(bits.value, batch["doc_id"])], ngram) if len(s)]
            yield pd.DataFrame({"key": [set_key(s) for s in found], "heads": [heads_of(s >> 15, len(s), percent, hot.value).astype("<i8").tobytes() for s in found]})

    again = docs.mapInPandas(deep_heads, "key binary, heads binary").join(broadcast_if_small(deep.select("key", "rid", "n"), MAX_BROADCAST // 4), "key")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _head_rows([(rid, n, np.frombuffer(h, dtype="<i8")) for rid, n, h in zip(batch["rid"], batch["n"], batch["heads"])])

    schema = "gram long, rid long, n long"
    every = sets.mapInPandas(heads, schema).unionByName(again.dropDuplicates(["rid"]).mapInPandas(spread, schema))
    near = every.repartition("gram").sortWithinPartitions("gram", "n").select("gram", "n", "rid").mapInPandas(near_runs(percent), "a long, b long, need long")
    near = near.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("need").alias("need")).filter("shared >= need")
    # ids as hashes (of one long, a bijection), as the contraction wants them
    near = staged(near.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    rows = described.select("doc_id", "n", "key", "digest")
    slim = staged(rows)
    discard(described, copies, counts, deep)
    classes = classes.withColumn("rid", F.xxhash64("rid"))

    groups = connected_components(near).select(F.col("node").alias("rid"), "root")
    members = staged(groups.join(classes, "rid"))
    large = staged(members.groupBy("root").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > unit))
    sized = members.join(broadcast_if_small(large, MAX_BROADCAST), "root", "left")
    small = sized.filter("many is null").select("rid", F.xxhash64("root").alias("unit"), F.lit(2).alias("side"))
    links = [verify(docs, members, small.unionByName(chunks_with_leaders(sized.filter("many is not null"), unit)), ngram, percent, unit)]
    if not large.isEmpty():
        parts = connected_components(links[0]).select(F.col("node").alias("rid"), F.col("root").alias("part"))
        inside = staged(sized.filter("many is not null").join(parts, "rid", "left").withColumn("part", F.coalesce("part", "rid")))
        of_part = inside.groupBy("root", "part").agg(F.count(F.lit(1)).alias("of_part"))
        top = staged(of_part.groupBy("root").agg(F.max(F.struct("of_part", "part"))["part"].alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1"))
        open_ = staged(inside.join(broadcast_if_small(top, MAX_BROADCAST), "root").select("rid", "key", "first_id", "root", "n", (F.col("part") != F.col("top")).alias("rest")))
        if not open_.isEmpty():
            links.append(verify(docs, open_, blocks_of_rest(open_, percent, unit), ngram, percent, unit))
    every_link = links[0] if len(links) == 1 else links[0].unionByName(links[1])
    found = connected_components(every_link).withColumnRenamed("node", "rid")
    named = staged(classes.join(found, "rid", "left").select("key", "first_id", F.coalesce("root", "rid").alias("root")))
    discard(near, members, large, *links)
    return slim, named


def similarity_classes(docs: DataFrame, ngram: int = 4, percent: int = 85, unit: int = UNIT, max_hot: int = MAX_HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two documents link when 100 * |A and B| >= percent * |A or B| over their sets of distinct n-grams
    of words (A-Z lower-cased, split at ASCII blanks); a document of fewer words has its whole
    sequence as one n-gram. component_id is the smallest doc_id that links reach. Documents without
    words, null texts among them, are linked with nothing and are their own component. A null doc_id
    links like any other, but names a component only if it has no other id. Repeated rows are links
    of each other. An empty table gives no rows. n-grams are compared by 63-bit hashes, equal sets
    by 128-bit digests.
    """
    rows, classes = _components(docs, ngram, percent, unit, max_hot)
    # components of one class need no join, and a component of very many meets a broadcast row
    lowest = staged(classes.groupBy("root").agg(F.min("first_id").alias("lowest"), F.count(F.lit(1)).alias("many")).filter("many > 1"))
    named = classes.join(broadcast_if_small(lowest, MAX_BROADCAST), "root", "left").select(
        "key", F.when(F.col("many").isNotNull(), F.col("lowest")).otherwise(F.col("first_id")).alias("component_id"))
    return rows.select("doc_id", "n", "key").join(named, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, ngram: int = 5, percent: int = 80, unit: int = UNIT, max_hot: int = MAX_HOT) -> DataFrame:
    """Of every component one row stays, with the columns of docs; rows without words stay all.

    It is the row of the smallest doc_id, null last, and then of the smallest digest of the text. Rows
    count by id and text: what shares an id with a dropped row, but is unlike it, stays. Of rows equal
    in both one stays.
    """
    rows, classes = _components(docs, ngram, percent, unit, max_hot)
    named = rows.filter("n > 0").select("doc_id", "digest", "key").join(classes.select("key", "root"), "key")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    each = named.groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("times"))
    best = staged(each.groupBy("root").agg(F.min(order).alias("best"), F.sum("times").alias("rows")).filter("rows > 1"))
    each = each.join(broadcast_if_small(best, MAX_BROADCAST // 4), "root")
    is_best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    listed = staged(each.select("doc_id", "digest", is_best.alias("kept"), "times").filter("not kept or times > 1").drop("times"))
    discard(rows, classes)
    return drop_listed(docs, listed, F.md5(docs.text))
