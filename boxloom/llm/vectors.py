"""Vectors in array columns: which are usable, fixed-point forms, and matrices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite numbers; an empty vector is usable."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def fixed_point(vector: str, scale: int, shift: int, width: int, limit: int) -> Column:
    """floor(scale * x) + shift of every entry, x as double; floors beyond +-limit saturate there.

    Vectors shorter than width are taken as if zeros followed.
    """
    one = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(float(-limit))), F.lit(float(limit)))) + F.lit(shift).cast("long")
    return F.concat(F.transform(vector, one), F.array_repeat(F.lit(shift).cast("long"), F.greatest(F.lit(width) - F.size(vector), F.lit(0))))


def matrix(lists: pa.Array, width: int, dtype=np.float64) -> np.ndarray:
    """A list column as rows of a matrix, zeros after the end of shorter lists."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) * width == len(flat) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=dtype)
    begin = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(begin, sizes)] = flat
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by integer keys, cut anew so that each holds whole runs of equal keys only.

    Meant for runs of bounded length: what is held back is the last run of a batch.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if len(held) > 1 and all(batch[k][-1].as_py() == held[0][k][-1].as_py() for k in keys):
            continue  # still the run that began earlier
        whole = _joined(held)
        last = np.ones(whole.num_rows, dtype=bool)
        for k in keys:
            column = whole[k].to_numpy(zero_copy_only=False)
            last &= column == column[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield whole.slice(0, cut)
        held = [whole.slice(cut)]
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def bounds_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end: k runs give k + 1 bounds."""
    change = np.zeros(max(0, len(columns[0]) - 1), dtype=bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(columns[0])]]) if len(columns[0]) else np.zeros(1, dtype=np.int64)
