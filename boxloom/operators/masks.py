"""Masks as runs: column-major run lengths that begin with zeros, and their codecs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG = T.LongType()


def run_area(runs: Column) -> Column:
    """Pixels set: the sum of every second run, in the JVM."""
    return F.aggregate(F.transform(runs, lambda r, i: F.when(i % 2 == 1, r).otherwise(0)), F.lit(0).cast("long"), lambda a, r: a + r)


def runs_of(mask: np.ndarray) -> list[int]:
    flat = np.asarray(mask, dtype=bool).ravel(order="F")
    if not flat.size:
        return []
    edge = np.flatnonzero(np.diff(flat)) + 1
    runs = np.diff(np.concatenate([[0], edge, [flat.size]])).tolist()
    return [0, *runs] if flat[0] else runs


def mask_of(runs, height: int, width: int) -> np.ndarray:
    flat = np.repeat(np.arange(len(runs)) % 2 == 1, runs)
    return flat.reshape((height, width), order="F")


def pack_runs(runs) -> str:
    """Runs as text: differences to the run two before from the third on, five bits a character, sign in the last."""
    out = []
    for k, run in enumerate(runs):
        x = int(run) - (int(runs[k - 2]) if k > 2 else 0)
        while True:
            low, x = x & 31, x >> 5
            done = x == (-1 if low & 16 else 0)
            out.append(chr(48 + low + (0 if done else 32)))
            if done:
                break
    return "".join(out)


def unpack_runs(text: str) -> list[int]:
    runs: list[int] = []
    value = shift = 0
    for c in text:
        code = ord(c) - 48
        value |= (code & 31) << shift
        shift += 5
        if not code & 32:
            if code & 16:
                value -= 1 << shift
            runs.append(value + (runs[-2] if len(runs) > 2 else 0))
            value = shift = 0
    return runs


@F.pandas_udf(T.ArrayType(_LONG))
def decode_runs(counts: pd.Series) -> pd.Series:
    return counts.map(lambda s: None if s is None else unpack_runs(s))


def places_within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of so many in turn."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def pack_many(values: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """pack_runs of many masks at once, so many of the values each: their texts in one, and the length of each."""
    x = values.astype(np.int64)
    x[2:] -= np.where(places_within(counts)[2:] > 2, values[:-2], 0)
    chars, used, left = [], [], np.ones(len(x), dtype=bool)
    while left.any():
        low, x = x & 31, x >> 5
        done = x == np.where(low & 16, -1, 0)
        chars.append(np.where(done, 48, 80) + low)
        used.append(left)
        left = left & ~done
    if not chars:
        return b"", np.zeros(len(counts), dtype=np.int64)
    used = np.stack(used, axis=1)
    ends = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
    at = np.concatenate([[0], np.cumsum(counts)])
    return np.stack(chars, axis=1)[used].astype(np.uint8).tobytes(), np.diff(ends[at])


def _texts(values: np.ndarray, counts: np.ndarray, known: np.ndarray) -> pa.Array:
    """Masks packed; null where they are not known."""
    text, lengths = pack_many(values, counts)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    large = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(text))
    return pc.if_else(pa.array(known), large.cast(pa.string()), pa.scalar(None, pa.string()))


def _sizes(lists: pa.Array) -> np.ndarray:
    """Lengths of lists, 0 of null ones."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


@F.arrow_udf(T.StringType())
def encode_runs(runs: pa.Array) -> pa.Array:
    return _texts(runs.flatten().to_numpy(zero_copy_only=False), _sizes(runs), runs.is_valid().to_numpy(zero_copy_only=False))


def mask_geometry(runs: Column | str, height: Column | str) -> Column:
    """struct(x1, y1, x2, y2, cx, cy, area): bounding box (exclusive), centroid of the pixel indices and area, from the runs alone.

    A run from s to e of columns h high has sum(p // h) = S(e) - S(s) with S(n) = h * q * (q - 1) / 2 + q * r, q and r
    the quotient and rest of n by h, and sum(p) = (e * (e - 1) - s * (s - 1)) / 2; a run over a column's end touches the
    first and the last line. No pixel is ever listed. Exact below 2 ** 31 pixels; no box and centre for an empty mask.
    """
    runs, h = (F.col(c) if isinstance(c, str) else c for c in (runs, height))
    h = h.cast("long")
    quotient = lambda n: ((n - n % h) / h).cast("long")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    each = F.transform(F.coalesce(runs, F.array().cast("array<bigint>")), lambda r, i: F.struct(r.cast("long").alias("n"), (i % 2 == 1).alias("on")))
    start = F.struct(zero.alias("at"), none.alias("x1"), none.alias("y1"), none.alias("x2"), none.alias("y2"), zero.alias("sx"), zero.alias("sp"), zero.alias("area"))
    half = lambda n: (n / 2).cast("long")

    def columns_before(n: Column) -> Column:
        q = quotient(n)
        return half(q * (q - 1)) * h + q * (n % h)

    def step(acc: Column, r: Column) -> Column:
        s, e = acc["at"], acc["at"] + r["n"]
        first, last = quotient(s), quotient(e - 1)
        over = first < last
        grown = F.struct(
            e.alias("at"), F.least(acc["x1"], first).alias("x1"), F.least(acc["y1"], F.when(over, zero).otherwise(s % h)).alias("y1"),
            F.greatest(acc["x2"], last + 1).alias("x2"), F.greatest(acc["y2"], F.when(over, h).otherwise((e - 1) % h + 1)).alias("y2"),
            (acc["sx"] + columns_before(e) - columns_before(s)).alias("sx"), (acc["sp"] + half(e * (e - 1)) - half(s * (s - 1))).alias("sp"), (acc["area"] + r["n"]).alias("area"))
        passed = F.struct(e.alias("at"), *[acc[c].alias(c) for c in ("x1", "y1", "x2", "y2", "sx", "sp", "area")])
        return F.when(r["on"] & (r["n"] > 0), grown).otherwise(passed)

    def finish(acc: Column) -> Column:
        mean = lambda c: F.when(acc["area"] > 0, c / acc["area"])
        return F.struct(*[acc[c].alias(c) for c in ("x1", "y1", "x2", "y2")], mean(acc["sx"]).alias("cx"), mean(acc["sp"] - h * acc["sx"]).alias("cy"), acc["area"].alias("area"))

    return F.aggregate(F.when(h > 0, each).otherwise(F.slice(each, 1, 0)), start, step, finish)


def spans_of(runs) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the pixels that are set."""
    r = np.asarray([] if runs is None else runs, dtype=np.int64)
    end = np.cumsum(r)
    begin, end = (end - r)[1::2], end[1::2]
    return begin[end > begin], end[end > begin]


def runs_of_spans(begin: np.ndarray, end: np.ndarray, total: int) -> list[int]:
    """Runs of sorted spans that neither touch nor overlap."""
    if not total:
        return []
    edges = np.empty(2 * len(begin) + 2, dtype=np.int64)
    edges[0], edges[1:-1:2], edges[2:-1:2], edges[-1] = 0, begin, end, total
    runs = np.diff(edges).tolist()
    return runs[:-1] if not runs[-1] and len(runs) > 1 else runs


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans sorted by begin, those that touch or overlap made one."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(begin), dtype=bool)
    new[1:] = begin[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1) if len(begin) else np.zeros(0, dtype=np.int64)
    return begin[new], reach[last]


def turned(begin: np.ndarray, end: np.ndarray, lines: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans over ``lines`` lines of ``length`` pixels, one after the other, as spans across the lines.

    Where a line differs from the one before it, spans across the lines begin and end: only those pixels are
    listed, as many as the outline is long.
    """
    if not len(begin):
        return begin, end
    first, last = begin // length, (end - 1) // length
    many = last - first + 1
    line = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    a = np.where(line == np.repeat(first, many), np.repeat(begin % length, many), 0)
    b = np.where(line == np.repeat(last, many), np.repeat((end - 1) % length + 1, many), length)
    step = length + 1
    at, of = np.unique(np.concatenate([line * step + a, line * step + b, (line + 1) * step + a, (line + 1) * step + b]), return_inverse=True)
    change = np.cumsum(np.bincount(of, np.repeat([1.0, -1.0, -1.0, 1.0], len(line))))[:-1]

    def places(chosen: np.ndarray) -> np.ndarray:
        n = np.diff(at)[chosen]
        p = np.repeat(at[:-1][chosen], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.sort(p % step * lines + p // step)

    return merged(places(change > 0.5), places(change < -0.5))


def bit_fields(data: np.ndarray):
    """A function (bit positions, widths up to 32) -> the unsigned numbers there, all at once; zeros after the end."""
    padded = np.concatenate([data.astype(np.uint8), np.zeros(16, dtype=np.uint8)])
    window = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def read(at, width) -> np.ndarray:
        at = np.minimum(np.asarray(at, dtype=np.int64), 8 * len(data))
        word = np.ascontiguousarray(window[at >> 3]).view(">u8").reshape(at.shape).astype(np.uint64)
        value = (word << (at & 7).astype(np.uint64)) >> (np.uint64(64) - np.asarray(width, dtype=np.uint64))
        return value.astype(np.int64)

    return read


#: Widths of the lengths of blocks (fixed values of the brush format).
BRUSH_SIZES = (3, 4, 8, 16)


#: Pixels of a block of literals up to which these are read one by one.
SHORT = 32


def brush_spans(data) -> tuple[np.ndarray, np.ndarray]:
    """Packed brush of the annotation tool -> spans of the pixels, row by row, whose alpha value is not 0.

    Head: 32 bits count, 5 bits word size less one, four times 4 bits size less one. Blocks: a bit
    for run or literals, two bits choosing a size, a length less one, then one word or as many.
    The values are those of four channels in turn, of which the fourth is alpha. A block gives its spans
    at once, and of literals only the alpha words are read, those of long blocks together; values missing at the end are 0.
    """
    raw = np.asarray(data, dtype=np.int64) & 255
    text, read, bits = raw.astype(np.uint8).tobytes() + bytes(8), None, 8 * len(raw)

    def field(at: int, width: int) -> int:
        return int.from_bytes(text[at >> 3 : (at + width + 7) >> 3], "big") >> (-(at + width) & 7) & ((1 << width) - 1)

    count, word = field(0, 32), field(32, 5) + 1
    sizes = [field(37 + 4 * k, 4) + 1 for k in range(4)]
    at, done, begin, end, longer = 53, 0, [], [], []
    while done < count and at < bits:
        size = sizes[field(at + 1, 2)]
        length, body = field(at + 3, size) + 1, at + 3 + size
        first, last = done // 4, min(done + length, count) // 4  # pixels whose alpha value the block holds
        if field(at, 1):
            if field(body, word) and last > first:
                begin.append(first)
                end.append(last)
            at = body + word
        else:
            if last - first > SHORT:
                read = read or bit_fields(raw)
                pixel = np.arange(first, last)
                longer.append(pixel[read(body + word * (4 * pixel + 3 - done), word) > 0])
            else:
                on = [pixel for pixel in range(first, last) if body + word * (4 * pixel + 3 - done) < bits and field(body + word * (4 * pixel + 3 - done), word)]
                begin += on
                end += [pixel + 1 for pixel in on]
            at = body + word * length
        done += length
    single = np.concatenate(longer) if longer else np.zeros(0, dtype=np.int64)
    return merged(np.concatenate([np.array(begin, dtype=np.int64), single]), np.concatenate([np.array(end, dtype=np.int64), single + 1]))


def brush_runs(data, width: int, height: int) -> list[int]:
    """Column-major runs of a packed brush; pixels after the image's end are left out."""
    begin, end = brush_spans(data)
    begin, end = begin[begin < width * height], np.minimum(end[begin < width * height], width * height)
    return runs_of_spans(*turned(begin, end, height, width), width * height)


def brush_of(runs, width: int, height: int) -> list[int]:
    """Column-major runs as opaque pixels in the brush packing, all blocks runs of four equal channels."""
    begin, end = turned(*spans_of(runs), width, height)
    rows = runs_of_spans(begin, end, width * height)
    bits = [f"{4 * width * height:032b}", f"{7:05b}", *[f"{s - 1:04b}" for s in BRUSH_SIZES]]
    for k, run in enumerate(rows):
        left = 4 * run
        while left:
            n = min(left, 1 << BRUSH_SIZES[-1])
            size = next(i for i, s in enumerate(BRUSH_SIZES) if n - 1 < 1 << s)
            bits.append(f"1{size:02b}{n - 1:0{BRUSH_SIZES[size]}b}{255 * (k % 2):08b}")
            left -= n
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return list(int(text, 2).to_bytes(len(text) // 8, "big"))


#: Crossings of a polygon's lines that are worked out together.
CROSSINGS = 1 << 18


def polygon_runs(points, width: int, height: int) -> list[int]:
    """Percent polygon -> column-major runs of its inside and its edges; fewer than three points: none."""
    return runs_of_spans(*turned(*polygon_spans(points, width, height), height, width), width * height)


def polygon_spans(points, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Percent polygon -> spans, row by row, of its inside and its edges; fewer than three points: none.

    Corners are cut to whole pixels. On each line the crossings of the edges that reach it are sorted and taken in
    pairs; an edge that ends on a line other than the last crosses it twice, so that corners stay closed. A pair
    fills the pixels from its first crossing, rounded half up, to its second, rounded half down. Level edges are
    drawn. Beside the spans, the crossings of some lines at a time are held.
    """
    if len(points) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    xs, ys = (np.trunc(np.array([p[k] for p in points], dtype=float) / 100 * s).astype(np.int64) for k, s in ((0, width), (1, height)))
    x1, y1 = np.roll(xs, -1), np.roll(ys, -1)
    begin, end = [], []

    def draw(y, left, right) -> None:
        left, right = np.maximum(left, 0), np.minimum(right, width - 1)
        seen = (left <= right) & (y >= 0) & (y < height)
        begin.append((y * width + left)[seen])
        end.append((y * width + right + 1)[seen])

    level = ys == y1
    draw(ys[level], np.minimum(xs, x1)[level], np.maximum(xs, x1)[level])
    steep = ys != y1
    top, low = np.minimum(ys, y1)[steep], np.maximum(ys, y1)[steep]
    at, on, slope = xs[steep], ys[steep], ((x1 - xs)[steep]) / ((y1 - ys)[steep])
    bottom = int(low.max()) if len(low) else -1
    first, last = max(0, int(top.min())) if len(low) else 0, min(height - 1, bottom)
    lines = max(1, CROSSINGS // max(1, 2 * len(low)))
    for y in range(first, last + 1, lines):
        line = np.arange(y, min(last + 1, y + lines))[:, None]
        near = (top < y + lines) & (low >= y)
        reached = (top[near] <= line) & (low[near] >= line)
        cross = np.where(reached, at[near] + (line - on[near]) * slope[near], np.inf)
        again = np.where(reached & (low[near] == line) & (line < bottom), cross, np.inf)
        cross = np.sort(np.concatenate([cross, again], axis=1), axis=1)
        row, pair = np.nonzero(cross[:, 1::2] < np.inf)
        draw(line[row, 0], np.floor(cross[row, 2 * pair] + 0.5).astype(np.int64), np.ceil(cross[row, 2 * pair + 1] - 0.5).astype(np.int64))
    return merged(np.concatenate(begin), np.concatenate(end))


def polygons_spans(xy: np.ndarray, counts: np.ndarray, width: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, begin, end): polygon_runs' spans of many polygons at once, row by row, before any are merged.

    xy: the corners of all, so many of each; every polygon has three at least.
    """
    own = np.repeat(np.arange(len(counts)), counts)
    xs, ys = (np.trunc(xy[:, k] / 100 * extent[own]).astype(np.int64) for k, extent in ((0, width), (1, height)))
    following = np.arange(len(xs)) + 1
    following[np.cumsum(counts) - 1] = np.cumsum(counts) - counts
    x1, y1 = xs[following], ys[following]
    drawn = []

    def draw(owner, y, left, right) -> None:
        left, right = np.maximum(left, 0), np.minimum(right, width[owner] - 1)
        seen = (left <= right) & (y >= 0) & (y < height[owner])
        drawn.append((owner[seen], (y * width[owner] + left)[seen], (y * width[owner] + right + 1)[seen]))

    level = ys == y1
    draw(own[level], ys[level], np.minimum(xs, x1)[level], np.maximum(xs, x1)[level])
    steep = ~level
    owner, top, low = own[steep], np.minimum(ys, y1)[steep], np.maximum(ys, y1)[steep]
    at, on, slope = xs[steep], ys[steep], ((x1 - xs)[steep]) / ((y1 - ys)[steep])
    bottom = np.full(len(counts), -1)
    np.maximum.at(bottom, owner, low)
    first, last = np.maximum(top, 0), np.minimum(low, height[owner] - 1)
    lines = np.maximum(last - first + 1, 0)
    edge = np.repeat(np.arange(len(owner)), lines)
    line = first[edge] + places_within(lines)
    cross = at[edge] + (line - on[edge]) * slope[edge]
    again = (low[edge] == line) & (line < bottom[owner[edge]])
    owner, line, cross = (np.concatenate([c, c[again]]) for c in (owner[edge], line, cross))
    order = np.lexsort((cross, line, owner))
    owner, line, cross = owner[order], line[order], cross[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (line[1:] != line[:-1])
    heads = np.flatnonzero(new)
    many = np.diff(np.append(heads, len(owner)))
    nth = places_within(many)
    left = np.flatnonzero((nth % 2 == 0) & (nth + 1 < np.repeat(many, many)))
    draw(owner[left], line[left], np.floor(cross[left] + 0.5).astype(np.int64), np.ceil(cross[left + 1] - 0.5).astype(np.int64))
    return tuple(np.concatenate([d[k] for d in drawn]) for k in range(3))


def turned_runs(owner: np.ndarray, begin: np.ndarray, end: np.ndarray, width: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts): column-major runs of many masks from their spans, row by row.

    As merged, turned and runs_of_spans do for one, with every mask at a place of its own on one long line, one pixel from the next.
    """
    total = width * height
    base = np.cumsum(total + 1) - (total + 1)
    begin, end = merged(base[owner] + begin, base[owner] + end)
    owner = np.searchsorted(base, begin, side="right") - 1
    begin, end = begin - base[owner], end - base[owner]
    w = width[owner]
    first, last = begin // w, (end - 1) // w
    many = last - first + 1
    span = np.repeat(np.arange(len(begin)), many)
    nth, of, w = places_within(many), owner[span], w[span]
    line = first[span] + nth
    a = np.where(nth == 0, begin[span] % w, 0)
    b = np.where(line == last[span], (end[span] - 1) % w + 1, w)
    room = (width + 1) * (height + 1)
    start = np.cumsum(room) - room
    here, step = start[of], w + 1
    at = np.concatenate([here + line * step + a, here + line * step + b, here + (line + 1) * step + a, here + (line + 1) * step + b])
    order = np.argsort(at, kind="stable")
    change, at = np.cumsum(np.repeat([1, -1, -1, 1], len(line))[order]), at[order]

    def places(chosen: np.ndarray) -> np.ndarray:
        n = np.diff(at)[chosen]
        p = np.repeat(at[:-1][chosen], n) + places_within(n)
        of = np.searchsorted(start, p, side="right") - 1
        p, step = p - start[of], width[of] + 1
        return np.sort(base[of] + p % step * height[of] + p // step)

    if len(at):
        begin, end = merged(places(change[:-1] > 0), places(change[:-1] < 0))
    owner = np.searchsorted(base, begin, side="right") - 1
    held = np.bincount(owner, minlength=len(width))
    sizes = 2 * held + 2
    heads = np.cumsum(sizes) - sizes
    edges = np.empty(sizes.sum(), dtype=np.int64)
    edges[heads], edges[heads + sizes - 1] = base, base + total
    place = heads[owner] + 1 + 2 * places_within(held)
    edges[place], edges[place + 1] = begin, end
    runs = np.diff(edges)
    kept = np.ones(len(runs), dtype=bool)
    kept[heads[1:] - 1] = False  # from one mask to the next
    tail = heads + sizes - 2
    counts = sizes - 1
    short = (runs[tail] == 0) & ((held > 0) | (total == 0))
    kept[tail[short]] = False
    return runs[kept], counts - short


def geometry_many(values: np.ndarray, counts: np.ndarray, height: np.ndarray) -> pa.Array:
    """mask_geometry of many masks at once."""
    owner, end = np.repeat(np.arange(len(counts)), counts), np.cumsum(values)
    before = np.concatenate([[0], end])[np.cumsum(counts) - counts]
    on = (places_within(counts) % 2 == 1) & (values > 0) & (height[owner] > 0)
    owner, e, n = owner[on], (end - before[owner])[on], values[on]
    s, h = e - n, height[owner]
    first, last = s // h, (e - 1) // h
    columns = lambda at: at // h * (at // h - 1) // 2 * h + at // h * (at % h)
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    some, seen = np.zeros(len(counts), dtype=bool), owner[heads]
    some[seen] = True

    def told(kind, of) -> np.ndarray:
        out = np.zeros(len(counts), dtype=np.int64)
        if len(heads):
            out[seen] = kind.reduceat(of, heads)
        return out

    over = first < last
    area, sx = told(np.add, n), told(np.add, columns(e) - columns(s))
    sp = told(np.add, e * (e - 1) // 2 - s * (s - 1) // 2)
    parts = {"x1": told(np.minimum, first), "y1": told(np.minimum, np.where(over, 0, s % h)), "x2": told(np.maximum, last + 1), "y2": told(np.maximum, np.where(over, h, (e - 1) % h + 1)),
             "cx": sx / np.maximum(area, 1), "cy": (sp - height * sx) / np.maximum(area, 1)}
    return pa.StructArray.from_arrays([*[pa.array(v, mask=~some) for v in parts.values()], pa.array(area)], [*parts, "area"])


#: Corners times lines, or bytes of brushes, that are drawn together.
TOGETHER = 1 << 20


def _portions(cost: np.ndarray) -> list[np.ndarray]:
    """Indices in order, in groups of about TOGETHER."""
    group = np.cumsum(cost) // TOGETHER
    return np.split(np.arange(len(cost)), np.flatnonzero(np.diff(group)) + 1) if len(cost) else []


def drawn_runs(rle: pa.Array, points: pa.Array, width: pa.Array, height: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, counts, known) of the runs of brushes, else of percent polygons; not known where there is neither.

    Rows are drawn together in portions, so that a small shape does not cost the start of every array operation. A polygon of
    very many crossings is drawn by itself, some lines at a time.
    """
    brushed = rle.is_valid().to_numpy(zero_copy_only=False)
    known = brushed | points.is_valid().to_numpy(zero_copy_only=False)
    corners, extents = np.where(brushed, 0, _sizes(points)), [pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (width, height)]
    bytes_, flat = _sizes(rle), rle.flatten().to_numpy(zero_copy_only=False)
    if (known & (width.is_null().to_numpy(zero_copy_only=False) | height.is_null().to_numpy(zero_copy_only=False))).any():
        raise ValueError("the size of a drawn region is not known")
    byte_at, corner_at = np.cumsum(bytes_) - bytes_, np.cumsum(_sizes(points)) - _sizes(points)
    each = points.flatten()
    two = _sizes(each)
    if (two < 2).any():
        raise ValueError("a corner needs two numbers")
    numbers, first = each.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(two) - two
    crossings = corners * (extents[1] + 1)
    values, counts = [], []
    for rows in _portions(bytes_ + crossings):
        w, h = (e[rows] for e in extents)
        parts = [(np.zeros(0, dtype=np.int64),) * 3]
        for k in np.flatnonzero(brushed[rows]):
            begin, end = brush_spans(flat[byte_at[rows[k]] : byte_at[rows[k]] + bytes_[rows[k]]])
            inside, total = begin < w[k] * h[k], w[k] * h[k]
            parts.append((np.full(inside.sum(), k), begin[inside], np.minimum(end[inside], total)))
        drawn = np.flatnonzero(corners[rows] > 2)
        if len(drawn) == 1 and crossings[rows[drawn[0]]] > TOGETHER:
            k = drawn[0]
            xy = numbers[first[corner_at[rows[k]] + np.arange(corners[rows[k]])][:, None] + np.arange(2)]
            begin, end = polygon_spans(xy, int(w[k]), int(h[k]))
            parts.append((np.full(len(begin), k), begin, end))
        elif len(drawn):
            n = corners[rows[drawn]]
            corner = np.repeat(corner_at[rows[drawn]], n) + places_within(n)
            owner, begin, end = polygons_spans(numbers[first[corner][:, None] + np.arange(2)], n, w[drawn], h[drawn])
            parts.append((drawn[owner], begin, end))
        owner, begin, end = (np.concatenate([p[k] for p in parts]) for k in range(3))
        v, c = turned_runs(owner, begin, end, w, h)
        none = ~known[rows]
        if none.any():
            v, c = v[np.repeat(~none, c)], np.where(none, 0, c)
        values.append(v)
        counts.append(c)
    joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return joined(values), joined(counts), known


GEOMETRY = T.StructType([*[T.StructField(n, _LONG) for n in ("x1", "y1", "x2", "y2")], *[T.StructField(n, T.DoubleType()) for n in ("cx", "cy")], T.StructField("area", _LONG)])


@F.arrow_udf(T.StructType([T.StructField("counts", T.StringType()), T.StructField("g", GEOMETRY)]))
def region_masks(rle: pa.Array, points: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    """Runs of a brush, else of a percent polygon, packed, and their geometry; packed is null where there is neither."""
    values, counts, known = drawn_runs(rle, points, width, height)
    h = pc.fill_null(height, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.StructArray.from_arrays([_texts(values, counts, known), geometry_many(values, counts, h)], ["counts", "g"])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def brushes(masks: pd.Series) -> pd.Series:
    """Brush packings of lists of masks (counts as text, size as height and width)."""
    each = lambda m: brush_of(unpack_runs(m["counts"]), int(m["size"][1]), int(m["size"][0]))
    return masks.map(lambda ms: None if ms is None else [each(m) for m in ms])
