"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the vectors, span a product grid of cells; every vector is listed
in the cell of its two nearest codewords. A search visits cells in the order of the sum of two sorted
lists of distances (a multi-sequence traversal) until that sum exceeds the nearest cell's by a gap,
which is calibrated so that the target share of links at the threshold is reached; what is listed in
the visited cells is verified by its cosine in double precision.

Groups of near copies are not expanded into pairs. Vectors of a cell that lie within half the
threshold's angle of a common centre form a ball: by the triangle inequality any two of them are
linked. Balls and the vectors in none are the entities that are listed and searched. Two entities are
linked altogether, or not at all, or, where the angles leave that open, verified member by member in
blocks that give counts and one edge. A cell with very many vectors is cut into parts, and the large
balls of its parts meet in a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import broadcast_if_small, connected_components, staged
from boxloom.llm.vectors import bounds_of_runs, matrix, runs, unit, usable

#: Rows that the codebooks are fitted on, the rows a codeword has of them at least, and rows a cell should list.
SAMPLE, PER_CODE, PER_CELL = 20_000, 16, 4
#: Share of links at the threshold that one side's search must reach; either side's suffices.
TARGET = 0.99
#: Rows of a part of a cell, parts that meet in one task, and the share of a part that a ball needs to go on.
PART, FAN, LARGE = 2048, 16, 64
#: Probes that are verified at once.
PROBES = 1024
#: Angles this close to a limit are verified rather than taken for certain.
MARGIN = 1e-7


@dataclass
class Index:
    first: np.ndarray  # codewords of the first half, a row each
    second: np.ndarray
    gap: float  # of the sum of squared distances, for vectors
    wide: float  # and for balls, which reach further

    @property
    def width(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def distances(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the codewords of each half, without what is the same for all codewords."""
        h = self.first.shape[1]
        return tuple((c * c).sum(axis=1) - 2 * (x @ c.T) for x, c in ((u[:, :h], self.first), (u[:, h:], self.second)))

    def cells(self, u: np.ndarray) -> np.ndarray:
        a, b = self.distances(u)
        return a.argmin(axis=1).astype(np.int64) * len(self.second) + b.argmin(axis=1)

    def visits(self, u: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells every row visits, the nearest first: both lists are sorted, and for each place in
        the first those of the second are taken that keep the sum within the gap."""
        rows, cells = [], []
        for s in range(0, len(u), 256):
            a, b = self.distances(u[s : s + 256])
            order_a, order_b = a.argsort(axis=1), b.argsort(axis=1)
            a, b = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
            a, b, gap = a - a[:, :1], b - b[:, :1], gaps[s : s + 256, None]
            m, n = int((a <= gap).sum(axis=1).max()), int((b <= gap).sum(axis=1).max())
            total = a[:, :m, None] + b[:, None, :n]
            r, p, q = np.nonzero(total <= gap[:, :, None])
            by_cost = np.lexsort((total[r, p, q], r))
            r, p, q = r[by_cost], p[by_cost], q[by_cost]
            rows.append(r + s)
            cells.append(order_a[r, p].astype(np.int64) * len(self.second) + order_b[r, q])
        return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(cells) if cells else np.zeros(0, np.int64)


def codebook(x: np.ndarray, size: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k-means; the start takes far rows by preference, or a large group of copies would get most codewords."""
    chosen = [int(rng.integers(len(x)))]
    far = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < size and far.sum() > 1e-12:
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    c = x[chosen]
    for _ in range(rounds):
        near = ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
        many = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], c)
    return c


def fit(sample: np.ndarray, n: int, level: float, target: float = TARGET) -> Index:
    """sample: unit vectors. The number of cells grows with n as far as the sample can fill codebooks."""
    rng = np.random.default_rng(7)
    size = max(1, min(len(sample) // PER_CODE, 2 ** round(math.log2(max(1.0, (n / PER_CELL) ** 0.5)))))
    half = sample.shape[1] // 2
    index = Index(codebook(sample[:, :half], size, rng), codebook(sample[:, half:], size, rng), 0.0, 0.0)
    u = sample[rng.permutation(len(sample))[:4000]]
    aside = rng.standard_normal(u.shape)
    aside -= (aside * u).sum(axis=1, keepdims=True) * u
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    a, b = index.distances(u)
    angle, gaps = math.acos(level), []
    for reach in (angle, 1.5 * angle):
        there = index.cells(math.cos(reach) * u + math.sin(reach) * aside)
        at = np.arange(len(u))
        cost = a[at, there // len(index.second)] + b[at, there % len(index.second)] - a.min(axis=1) - b.min(axis=1)
        gaps.append(float(np.quantile(cost, target)) + 1e-9)
    index.gap, index.wide = gaps
    return index


def balls(v: np.ndarray, level: float, real=np.float64) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(members, centre, radius) of balls among unit vectors; any two members are linked for certain."""
    limit = math.cos(math.acos(level) / 2 - MARGIN)
    near = v @ v.T >= level
    free, degree, out = np.ones(len(v), dtype=bool), near.sum(axis=1), []
    while True:
        pick = int(np.where(free, degree, 0).argmax())
        if not free[pick] or degree[pick] < 2:
            return out
        members = np.flatnonzero(near[pick] & free)
        for _ in range(2):
            centre = unit(v[members].sum(axis=0, keepdims=True))[0].astype(real)
            towards = unit(centre[None, :].astype(np.float64))[0]
            members = np.flatnonzero(free & (v @ towards >= limit))
            if len(members) < 2:
                break
        if len(members) < 2:
            members = np.array([pick])
        else:
            out.append((members, centre, float(np.arccos(np.clip(v[members] @ towards, -1, 1)).max()) + 1e-9))
        free[members] = False
        degree -= near[:, members].sum(axis=1)


#: {v} is the type of the vectors; centres are rounded to it, and radii are those about the rounded centres.
ASSIGNED = "row long, id long, ent long, cell int, part int, vector {v}, centre {v}, radius double, size long, least long"


def _assign(level: float, width: int):
    """Rows sorted by (cell, part) -> ASSIGNED: the first member of a ball carries its centre, radius, size and smallest id."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, ["cell", "part"]):
            row, cell, part = (b[c].to_numpy(zero_copy_only=False) for c in ("row", "cell", "part"))
            ids, v = b["id"].to_pylist(), unit(matrix(b["vector"], width))
            real = b["vector"].type
            ent, radius, size = row.copy(), np.zeros(len(row)), np.ones(len(row), dtype=np.int64)
            centres: list = [None] * len(row)
            least = list(ids)
            at = bounds_of_runs(cell, part)
            for s, e in zip(at[:-1], at[1:]):
                for members, centre, r in balls(v[s:e], level, real.value_type.to_pandas_dtype()) if e - s > 1 else []:
                    members = members + s
                    first = members[0]
                    ent[members] = row[first]
                    centres[first], radius[first], size[first] = centre, r, len(members)
                    least[first] = min((ids[k] for k in members if ids[k] is not None), default=None)
            yield pa.RecordBatch.from_arrays(
                [b["row"], b["id"], pa.array(ent), b["cell"], b["part"], b["vector"], pa.array(centres, real), pa.array(radius), pa.array(size), pa.array(least, pa.int64())],
                ["row", "id", "ent", "cell", "part", "vector", "centre", "radius", "size", "least"])

    return assign


def _meet(level: float):
    """Balls of one cell whose parts meet: a ball joins the largest one before it whose radius can take it in."""
    limit = math.acos(level) / 2 - MARGIN

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "ent"], ascending=[False, True])
        centres = unit(np.stack(pdf["centre"].to_numpy()).astype(np.float64))
        heads: list[int] = []
        into, radius = np.arange(len(pdf)), pdf["radius"].to_numpy().copy()
        for k in range(len(pdf)):
            if heads:
                grown = np.arccos(np.clip(centres[heads] @ centres[k], -1, 1)) + radius[k] + 1e-9
                fits = np.flatnonzero(grown <= limit)
                if len(fits):
                    into[k] = heads[fits[0]]
                    radius[into[k]] = max(radius[into[k]], grown[fits[0]])
                    continue
            heads.append(k)
        ents = pdf["ent"].to_numpy()
        return pd.DataFrame({"ent": ents, "head": ents[into], "reach": radius[into]})

    return meet


def _joined_parts(assigned: DataFrame, most_parts: int, level: float) -> DataFrame:
    """assigned, where large balls of a cell of several parts are one; their members name the head's row."""
    known = assigned.filter((F.col("row") == F.col("ent")) & (F.col("size") >= LARGE)).select("ent", "cell", "part", "centre", "radius", "size", "least")
    moves = staged(known.select("ent", F.col("ent").alias("head"), F.col("radius").alias("reach"), "size", "least"))
    parts, least_size = most_parts, LARGE
    while parts > 1:
        heads = known.filter(F.col("size") >= least_size).groupBy("cell", F.floor(F.col("part") / FAN).alias("_meet")).applyInPandas(_meet(level), "ent long, head long, reach double")
        heads = staged(heads)
        part = F.floor(F.col("part") / FAN).cast("int").alias("part")
        merged = known.join(heads, "ent").groupBy(F.col("head").alias("ent")).agg(F.max("reach").alias("radius"), F.sum("size").alias("size"), F.min("least").alias("least"))
        known = staged(known.join(heads.filter("ent = head").select("ent"), "ent").select("ent", "cell", part, "centre").join(merged, "ent"))
        again = heads.select(F.col("ent").alias("head"), F.col("head").alias("next"))
        new = known.select(F.col("ent").alias("next"), F.col("radius").alias("r2"), F.col("size").alias("s2"), F.col("least").alias("l2"))
        moves = staged(moves.join(again, "head", "left").join(new, "next", "left").select(
            "ent", F.coalesce("next", "head").alias("head"), F.coalesce("r2", "reach").alias("reach"), F.coalesce("s2", "size").alias("size"), F.coalesce("l2", "least").alias("least")))
        parts, least_size = -(-parts // FAN), least_size * FAN
    to = broadcast_if_small(moves.select("ent", "head", "reach", F.col("size").alias("all"), F.col("least").alias("lowest")), 100_000)
    whole = assigned.join(to, "ent", "left")
    head = F.coalesce("head", "ent")
    is_head = F.col("head").isNotNull() & (F.col("row") == F.col("head"))
    return staged(whole.select(
        "row", "id", head.alias("ent"), "cell", "part", "vector", F.when(F.col("row") == head, F.col("centre")).alias("centre"),
        F.when(is_head, F.col("reach")).otherwise(F.col("radius")).alias("radius"), F.when(is_head, F.col("all")).otherwise(F.col("size")).alias("size"),
        F.when(is_head, F.col("lowest")).otherwise(F.col("least")).alias("least")))


ENTITY = "ent long, cell int, centre {v}, radius double, size long, visits array<int>"


def _listed(index: Index):
    """Entities with their cell and the cells they visit."""
    def listed(batches):
        for b in batches:
            u = unit(matrix(b["centre"], index.width))
            radius = b["radius"].to_numpy(zero_copy_only=False)
            row, cell = index.visits(u, np.where(radius > 0, index.wide, index.gap))
            offsets = np.searchsorted(row, np.arange(len(u) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b["ent"], pa.array(index.cells(u).astype(np.int32)), b["centre"], b["radius"], b["size"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell.astype(np.int32)))],
                ["ent", "cell", "centre", "radius", "size", "visits"])

    return listed


STREAM = "place long, side int, " + ENTITY


def _dealt(codes: int, split: np.ndarray, salts: dict[int, int]):
    """Entities -> STREAM: side 0 lists one where it is found, side 1 sends it to every place that holds a cell it visits.

    A place is a first codeword; of a codeword with many entities a residue of the second; of a cell with
    many entities a part of the cell. What is sent names the cells that are visited there.
    """
    def place(cell: np.ndarray, salt) -> np.ndarray:
        i, j = cell // codes, cell % codes
        return ((i << 21) + j % split[i] << 21) + salt

    def dealt(batches):
        for b in batches:
            ent, cell = b["ent"].to_numpy(zero_copy_only=False), b["cell"].to_numpy(zero_copy_only=False).astype(np.int64)
            salt = np.array([e % salts[c] + 1 if c in salts else 0 for e, c in zip(ent.tolist(), cell.tolist())], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place(cell, salt)), pa.array(np.zeros(len(ent), dtype=np.int32)), *b.columns], ["place", "side", *b.schema.names])
            owner = np.repeat(np.arange(len(ent)), pa.compute.list_value_length(b["visits"]).to_numpy(zero_copy_only=False))
            to = b["visits"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            parts = np.array([salts.get(c, 1) for c in to.tolist()], dtype=np.int64) if salts else np.ones(len(to), dtype=np.int64)
            hot = np.array([c in salts for c in to.tolist()], dtype=bool) if salts else np.zeros(len(to), dtype=bool)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            owner, to, hot = (np.repeat(x, parts) for x in (owner, to, hot))
            at = place(to, np.where(hot, nth + 1, 0))
            order = np.lexsort((at, owner))
            owner, to, at = owner[order], to[order], at[order]
            cuts = bounds_of_runs(owner, at)
            first = cuts[:-1]
            sent = b.take(pa.array(owner[first]))
            seen = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(to.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[first]), pa.array(np.ones(len(first), dtype=np.int32)), *[sent[n] for n in sent.schema.names if n != "visits"], seen], ["place", "side", *b.schema.names])

    return dealt


FOUND = "kind int, a long, b long, n long"
COUNT, EDGE, OPEN = 0, 1, 2


class Findings:
    """Counts by entity or row, edges of a spanning forest, and open pairs, as batches of FOUND."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def add(self, kind: int, a: np.ndarray, b, n) -> None:
        if len(a):
            one = np.empty((len(a), 4), dtype=np.int64)  # never by way of floats, which lose digits of row numbers
            for k, x in enumerate((kind, a, b, n)):
                one[:, k] = x
            self.parts.append(one)

    def forest(self, links: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Edges that connect what a matrix of links connects, one a node."""
        rows, columns = links.any(axis=1), links.any(axis=0)
        links, a, b = links[rows][:, columns], a[rows], b[columns]
        if not len(a):
            return
        label, most = np.arange(len(a)), len(a)
        while True:
            of_b = np.where(links, label[:, None], most).min(axis=0)
            new = np.minimum(label, np.where(links, of_b[None, :], most).min(axis=1))
            new = new[new]
            if (new == label).all():
                break
            label = new
        for nodes, heads in ((a, a[label]), (b, a[of_b])):
            moved = nodes != heads
            self.add(EDGE, nodes[moved], heads[moved], 0)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            x = np.concatenate(self.parts)
            self.parts = []
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), *[pa.array(x[:, k]) for k in (1, 2, 3)]], ["kind", "a", "b", "n"])


def _verify(level: float, width: int):
    """STREAM sorted by (place, side, cell) -> FOUND."""
    angle = math.acos(level)

    def block(p, listed, found: Findings) -> None:
        """Probes against the entities of one cell that they all visit."""
        cos = p["u"] @ listed["u"].T
        reach = p["radius"][:, None] + listed["radius"][None, :]
        between = np.arccos(np.clip(cos, -1, 1))
        single = reach == 0
        other = p["ent"][:, None] != listed["ent"][None, :]
        close = other & np.where(single, cos >= level, between <= angle + reach + MARGIN)
        at, to = np.nonzero(close)
        if not len(at):
            return
        # a pair that the searches of both sides meet counts in that of the smaller one
        cells, of_at = np.unique(p["cell"][at], return_inverse=True)
        theirs, of_to = np.unique(to, return_inverse=True)
        met = np.array([[c in listed["visits"][y] for c in cells.tolist()] for y in theirs], dtype=bool)
        meets = met[of_to, of_at]
        mine = ~meets | (p["ent"][at] < listed["ent"][to])
        at, to = at[mine], to[mine]
        sure = single[at, to] | (between[at, to] + reach[at, to] <= angle - MARGIN)
        found.add(OPEN, p["ent"][at[~sure]], listed["ent"][to[~sure]], 0)
        at, to = at[sure], to[sure]
        links = np.zeros(cos.shape, dtype=bool)
        links[at, to] = True
        for ents, sums in ((p["ent"], links @ listed["size"]), (listed["ent"], p["size"] @ links)):
            found.add(COUNT, ents[sums > 0], 0, sums[sums > 0])
        found.forest(links, p["ent"], listed["ent"])

    def unpack(b: pa.RecordBatch) -> dict:
        out = {c: b[c].to_numpy(zero_copy_only=False) for c in ("ent", "cell", "radius", "size")}
        return out | {"u": unit(matrix(b["centre"], width)), "visits": b["visits"]}

    def part_of(x: dict, at) -> dict:
        return {k: v[at] for k, v in x.items() if k != "visits"}

    def verify(batches):
        place, listed = None, []
        for b in batches:
            places, sides = b["place"].to_numpy(zero_copy_only=False), b["side"].to_numpy(zero_copy_only=False)
            bounds = bounds_of_runs(places, sides)
            for s, e in zip(bounds[:-1], bounds[1:]):
                piece = b.slice(s, e - s)
                if places[s] != place:
                    place, listed = places[s], []
                x = unpack(piece)
                if sides[s] == 0:
                    x["visits"] = np.array([set(v) for v in x["visits"].to_pylist()] + [None], dtype=object)[:-1]
                    listed.append(x)
                    continue
                if len(listed) > 1:
                    listed = [{k: np.concatenate([y[k] for y in listed]) for k in listed[0]}]
                if not listed:
                    continue
                here = listed[0]
                cells, begin = np.unique(here["cell"], return_index=True)  # sorted by cell already
                end = np.append(begin[1:], len(here["cell"]))
                flat = x["visits"].flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(x["ent"])), pa.compute.list_value_length(x["visits"]).to_numpy(zero_copy_only=False))
                known = np.searchsorted(cells, flat)
                there = (known < len(cells)) & (cells[np.minimum(known, len(cells) - 1)] == flat)
                owner, known = owner[there], known[there]
                by_cell = np.argsort(known, kind="stable")
                owner, known = owner[by_cell], known[by_cell]
                found, cuts = Findings(), bounds_of_runs(known)
                for cs, ce in zip(cuts[:-1], cuts[1:]):
                    k = known[cs]
                    entries = {n: v[begin[k] : end[k]] for n, v in here.items()}
                    for q in range(cs, ce, PROBES):
                        block(part_of(x, owner[q : min(ce, q + PROBES)]), entries, found)
                yield from found.batches()

    return verify


def _summed(found: DataFrame) -> DataFrame:
    return found.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def _open_pairs(pairs: DataFrame, assigned: DataFrame, entities: DataFrame, level: float, width: int) -> DataFrame:
    """Open pairs (a, b) member by member -> FOUND, where COUNT is by row in b = 1 and by entity in b = 0.

    Members of the smaller entity are compared with the larger one's centre first; only those whose angle
    leaves it open meet its members, block by block.
    """
    angle = math.acos(level)
    side = lambda n: entities.select(F.col("ent").alias(n), F.struct("size", F.col("ent").alias("ent")).alias(f"{n}_of"), F.struct("centre", "radius", "size").alias(f"{n}_ball"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    a_first = F.col("a_of") > F.col("b_of")
    pick = lambda x, y: F.when(a_first, F.col(x)).otherwise(F.col(y))
    both = staged(both.select(pick("a", "b").alias("large"), pick("b", "a").alias("ent"), pick("a_ball", "b_ball").alias("ball")))

    rows = assigned.select("row", "ent", "vector")
    asked = rows.join(both, "ent").select("large", "ent", "row", "vector", "ball.centre", "ball.radius", "ball.size")

    def sort_out(batches):
        for b in batches:
            between = np.arccos(np.clip((unit(matrix(b["vector"], width)) * unit(matrix(b["centre"], width))).sum(axis=1), -1, 1))
            radius = b["radius"].to_numpy(zero_copy_only=False)
            verdict = np.where(between + radius <= angle - MARGIN, 1, np.where(between - radius > angle + MARGIN, 0, 2))
            yield pa.RecordBatch.from_arrays([*[b[c] for c in ("large", "ent", "row", "vector", "size")], pa.array(verdict.astype(np.int32))], ["large", "ent", "row", "vector", "size", "verdict"])

    sorted_out = staged(asked.mapInArrow(sort_out, f"large long, ent long, row long, vector {dict(assigned.dtypes)['vector']}, size long, verdict int"))
    sure = sorted_out.filter("verdict = 1")
    kind = lambda k: F.lit(k).alias("kind")
    told = sure.select(kind(COUNT), F.col("row").alias("a"), F.lit(1).cast("long").alias("b"), F.col("size").alias("n")).unionByName(
        sure.groupBy("large").agg(F.count(F.lit(1)).alias("n")).select(kind(COUNT), F.col("large").alias("a"), F.lit(0).cast("long").alias("b"), "n")).unionByName(
        sure.select(kind(EDGE), F.col("ent").alias("a"), F.col("large").alias("b"), F.lit(0).cast("long").alias("n")).distinct())

    blocks = F.ceil(F.col("size") / PART).cast("int")
    probes = sorted_out.filter("verdict = 2").select("large", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("side"), "ent", "row", "vector")
    larges = both.select(F.col("large").alias("ent"), F.col("ball.size").alias("size")).distinct()
    members = rows.join(larges, "ent").select(F.col("ent").alias("large"), F.pmod(F.xxhash64("row"), blocks).cast("int").alias("block"), F.lit(0).alias("side"), "ent", "row", "vector")

    def compare(batches):
        key, rows_, vectors = None, [], []
        for b in batches:
            large, block, side_, ent, row = (b[c].to_numpy(zero_copy_only=False) for c in ("large", "block", "side", "ent", "row"))
            v = unit(matrix(b["vector"], width))
            at = bounds_of_runs(large, block, side_)
            for s, e in zip(at[:-1], at[1:]):
                if (large[s], block[s]) != key:
                    key, rows_, vectors = (large[s], block[s]), [], []
                if side_[s] == 0:
                    rows_.append(row[s:e])
                    vectors.append(v[s:e])
                    continue
                if not rows_:
                    continue
                ids, w, found = np.concatenate(rows_), np.concatenate(vectors), Findings()
                for p in range(s, e, PROBES):
                    q = min(e, p + PROBES)
                    links = v[p:q] @ w.T >= level
                    some, theirs = links.sum(axis=1), links.sum(axis=0)
                    found.add(COUNT, row[p:q][some > 0], 1, some[some > 0])
                    found.add(COUNT, ids[theirs > 0], 1, theirs[theirs > 0])
                    linked = np.unique(ent[p:q][some > 0])
                    found.add(EDGE, linked, large[s], 0)
                yield from found.batches()

    stream = members.unionByName(probes).repartition("large", "block").sortWithinPartitions("large", "block", "side")
    return told.unionByName(stream.mapInArrow(compare, FOUND))


def near_duplicates(
    rows: DataFrame, vector: str = "embedding", id_col: str = "vec_id", level: float = 0.95, target: float = TARGET, sample: int = SAMPLE, part: int = PART,
) -> DataFrame:
    """One row per row of rows: id, n_links, component_id, kept.

    Vectors link whose cosine is at least level, as far as the searches meet them; no pair below it links.
    n_links counts the other rows linked with a row, component_id is the smallest id reachable by links,
    kept says that it is the row's own. Vectors that are null, zero or hold null or non-finite entries,
    and empty ones, link with nothing. Shorter vectors count as if zeros followed. Repeated rows are
    linked like any copies; rows that share an id are told apart. A null id is never the smallest; a
    component without any id has a null component_id, and its rows are kept. An empty table gives no
    rows. Other columns are not read. The codebooks are fitted on ``sample`` rows, by hashed number;
    every row is listed and searched.
    """
    spark = rows.sparkSession
    some = F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.when(usable(vector) & some, F.col(vector)).alias("vector"))
    named = staged(named.withColumn("row", F.xxhash64(F.monotonically_increasing_id())))  # staging fixes the numbers
    alone = named.filter("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    sound = named.filter("vector is not null")
    told = sound.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    shape = lambda df: df.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    if not told["n"]:
        return shape(alone)
    width = max(2, told["width"])
    picked = sound.orderBy("row").limit(sample).select("vector").toPandas()["vector"]  # bounded by sample
    dense = np.zeros((len(picked), width))
    for k, v in enumerate(picked):
        dense[k, : len(v)] = v
    index = fit(unit(dense), told["n"], level, target)
    codes, kind = len(index.second), dict(sound.dtypes)["vector"]

    def locate(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["row"], b["id"], b["vector"], pa.array(index.cells(unit(matrix(b["vector"], width))).astype(np.int32))], ["row", "id", "vector", "cell"])

    located = staged(sound.select("row", "id", "vector").mapInArrow(locate, f"row long, id long, vector {kind}, cell int"))
    crowded = staged(located.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts")).filter("parts > 1"))
    most_parts = crowded.agg(F.max("parts")).first()[0] or 1
    cut = located.join(broadcast_if_small(crowded, 100_000), "cell", "left") if most_parts > 1 else located.withColumn("parts", F.lit(None).cast("int"))
    cut = cut.withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    assigned = staged(cut.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_assign(level, width), ASSIGNED.format(v=kind)))
    if most_parts > 1:
        assigned = _joined_parts(assigned, most_parts, level)

    heads = assigned.filter("row = ent").select("ent", F.coalesce("centre", "vector").alias("centre"), "radius", "size")
    entities = staged(heads.mapInArrow(_listed(index), ENTITY.format(v=kind)))
    cells = staged(entities.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    split = np.ones(len(index.first), dtype=np.int64)
    for r in cells.groupBy(F.floor(F.col("cell") / codes).alias("i")).agg(F.sum("n").alias("n")).collect():  # a row a codeword
        split[r["i"]] = min(codes, -(-r["n"] // (4 * part)))
    salts = {r["cell"]: -(-r["n"] // (4 * part)) for r in cells.filter(F.col("n") > 4 * part).collect()}  # at most an entry per 4 * part entities
    stream = entities.mapInArrow(_dealt(codes, split, salts), STREAM.format(v=kind)).repartition("place").sortWithinPartitions("place", "side", "cell")
    found = staged(_summed(stream.mapInArrow(_verify(level, width), FOUND)))
    adds = found.filter(f"kind = {COUNT}").select(F.col("a").alias("ent"), "n")
    edges = found.filter(f"kind = {EDGE}").select("a", "b")
    by_row = None
    opened = found.filter(f"kind = {OPEN}").select("a", "b")
    if not opened.isEmpty():
        more = staged(_open_pairs(opened, assigned, entities, level, width))
        adds = adds.unionByName(more.filter(f"kind = {COUNT} and b = 0").select(F.col("a").alias("ent"), "n"))
        edges = edges.unionByName(more.filter(f"kind = {EDGE}").select("a", "b"))
        by_row = more.filter(f"kind = {COUNT} and b = 1").groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("more"))

    heads = assigned.filter("row = ent").select("ent", "size", "least")
    roots = connected_components(edges)
    reached = roots.join(heads.select(F.col("ent").alias("node"), "least"), "node")
    lowest = reached.groupBy("root").agg(F.min("least").alias("lowest"))
    named_roots = reached.join(lowest, "root").select(F.col("node").alias("ent"), "lowest")
    added = adds.groupBy("ent").agg(F.sum("n").alias("n"))
    of_entity = heads.join(added, "ent", "left").join(named_roots, "ent", "left").filter("size > 1 or n is not null or lowest is not null").select(
        "ent", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("lowest", "least").alias("lowest"))
    of_entity = staged(of_entity)
    whole = assigned.select("row", "id", "ent").join(broadcast_if_small(of_entity, 250_000), "ent", "left")
    if by_row is not None:
        whole = whole.join(broadcast_if_small(staged(by_row), 250_000), "row", "left")
    else:
        whole = whole.withColumn("more", F.lit(0).cast("long"))
    linked = whole.select("id", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("n").isNotNull(), F.col("lowest")).otherwise(F.col("id")).alias("component_id"))
    return shape(linked.unionByName(alone))
