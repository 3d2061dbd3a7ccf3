"""Whitening of vectors by a one-sided Jacobi SVD of a TSQR factor.

Every partition centres its vectors and folds them batch by batch into the triangular factor R of a
QR decomposition; factors meet in a tree, sixteen at a time, so no task holds more than seventeen of
them. Plane rotations then orthogonalise the columns of the last R, which has d x d numbers whatever
the number of vectors: the accumulated rotations are the components, and the lengths of the rotated
columns, which keep their relative accuracy however small, give the standard deviations. The
covariance matrix itself is never formed, so nothing is lost by squaring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import staged
from boxloom.llm.vectors import matrix

#: Factors that meet in one task.
FAN = 16
SWEEPS = 60


@dataclass
class Fit:
    """n vectors with per-dimension sums (exact), components as columns, their eigenvalues falling, and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def _rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d (even) columns, in d - 1 rounds of disjoint ones: a round-robin tournament."""
    ring = list(range(1, d))
    out = []
    for _ in range(d - 1):
        seats = [0, *ring]
        out.append((np.array(seats[: d // 2]), np.array(seats[: d // 2 - 1 : -1])))
        ring = ring[-1:] + ring[:-1]
    return out


def jacobi_svd(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values of r, falling; right singular vectors as columns), each with its largest entry positive."""
    d = r.shape[1]
    even = d + d % 2
    a, v = np.zeros((r.shape[0], even)), np.eye(even)
    a[:, :d] = r
    for _ in range(SWEEPS):
        turned = False
        for p, q in _rounds(even) if even > 1 else []:
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            turned = True
            zeta = np.where(turn, beta - alpha, 0.0) / np.where(turn, 2 * gamma, 1.0)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            x, y = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    sigma = np.sqrt((a * a).sum(axis=0))[:d] if d == even else np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-sigma, kind="stable")
    if d != even:  # the added column stays zero and belongs to the added unit vector
        order = np.array([k for k in order if abs(v[d, k]) < 0.5])
    sigma, v = sigma[order], v[:d, order]
    return sigma, v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def _totals(rows: DataFrame, vector: str, width: int) -> tuple[int, list[int]]:
    def add(batches):
        n, sums = 0, np.zeros(width, dtype=np.int64)
        for b in batches:
            n += b.num_rows
            sums += matrix(b[vector], width, np.int64).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sums": pa.array([sums.tolist()], pa.list_(pa.int64()))})

    part = rows.select(vector).mapInArrow(add, "n long, sums array<long>")
    each = part.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row a dimension
    if not each:
        return 0, []
    return each[0]["n"], [int(r["s"]) for r in sorted(each, key=lambda r: r["at"])]


def _factor(rows: DataFrame, vector: str, mean: np.ndarray) -> np.ndarray:
    d = len(mean)

    def compress(batches):
        r = np.zeros((0, d))
        for b in batches:
            r = np.linalg.qr(np.vstack([r, matrix(b[vector], d) - mean]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.vstack([np.frombuffer(x, dtype=np.float64).reshape(-1, d) for x in pdf.sort_values("part")["r"]])
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // FAN], "r": [np.linalg.qr(r, mode="r").tobytes()]})

    kind = "part long, r binary"
    factors = staged(rows.select(vector).mapInArrow(compress, kind))
    while (top := factors.agg(F.max("part")).first()[0]) is not None and top > 0:
        factors = staged(factors.groupBy(F.floor(F.col("part") / FAN).alias("_meet")).applyInPandas(meet, kind))
    return np.frombuffer(factors.first()["r"], dtype=np.float64).reshape(-1, d)  # one d x d factor is left


def fit(rows: DataFrame, vector: str, width: int) -> Fit | None:
    """rows with vectors of whole numbers (array<bigint> of at most width entries, none null); None for no rows."""
    n, sums = _totals(rows, vector, width) if width else (0, [])
    if not n:
        return None
    sigma, v = jacobi_svd(_factor(rows, vector, np.array([s / n for s in sums])))
    e = sigma**2 / n
    trace = float(e.sum())
    sound = e > (e[0] if len(e) else 0.0) * (width * 2.0**-50) ** 2  # below that a column is rounding of the larger ones
    return Fit(n, sums, v[:, sound], e[sound], trace)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row the exact sum of (n * x - S) ** 2; None where it passes 63 bits."""
    reach = max(n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(s) for s in sums), 1) if x.size else 1
    if reach < 2**62:
        y = n * x - np.array(sums, dtype=np.int64)
        most = max(abs(int(y.min())), abs(int(y.max()))) if y.size else 0
        if most * most * max(1, x.shape[1]) < 2**63:
            return (y * y).sum(axis=1).tolist()
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(rows: DataFrame, vector: str, width: int, components: int = 8, id_col: str = "vec_id") -> DataFrame:
    """One row per row of rows and component: id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error.

    rows has vectors of whole numbers, at most width entries each, shorter ones followed by zeros; the
    caller leaves out what is not usable. Components without variance (fewer distinct vectors than
    components, or equal ones only) are left out, so a table of equal vectors and an empty one give no
    rows. Repeated rows and repeated or null ids count and come back as often as they are there. A
    deviation of more than 63 bits is null. Other columns are not read.
    """
    spark = rows.sparkSession
    known = fit(rows, vector, width)
    schema = f"{id_col} {dict(rows.dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    k = min(components, len(known.eigenvalues)) if known else 0
    if not k:
        return spark.createDataFrame([], schema)
    mean, n, sums = np.array([s / known.n for s in known.sums]), known.n, known.sums
    turn = known.components[:, :k] / np.sqrt(known.eigenvalues[:k])

    def project(batches):
        for b in batches:
            x = matrix(b[vector], width, np.int64)
            w = (x.astype(np.float64) - mean) @ turn
            yield pa.RecordBatch.from_arrays(
                [b[id_col], pa.array(_deviation(x, n, sums), pa.int64()), *[pa.array(w[:, i]) for i in range(k)]], [id_col, "deviation", *[f"w{i}" for i in range(k)]])

    kind = f"{id_col} {dict(rows.dtypes)[id_col]}, deviation long, " + ", ".join(f"w{i} double" for i in range(k))
    done = staged(rows.select(id_col, vector).mapInArrow(project, kind))
    mid = done.agg(*[F.avg(f"w{i}") for i in range(k)]).first()
    centred = [F.col(f"w{i}") - F.lit(mid[i]) for i in range(k)]
    cov = done.agg(*[F.avg(centred[i] * centred[j]) for i in range(k) for j in range(i, k)]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(cov, [(i, j) for i in range(k) for j in range(i, k)]))
    share = F.element_at(F.lit([float(e / known.trace) for e in known.eigenvalues[:k]]), F.col("component"))
    each = done.select(id_col, "deviation", F.posexplode(F.array(*[f"w{i}" for i in range(k)])).alias("at", "whitened"))
    return each.withColumn("component", F.col("at") + 1).select(
        id_col, "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(float(error)).alias("identity_error"))
