"""One large JSON document read by all cores: its byte ranges are cut at object borders.

Spark's text reader cuts a file after any given character; after "}" a range never begins within an
escape sequence. Whether it begins within a string, and how deep, is not known from the range alone, so
a first scan describes every range for both cases: how its quotes, depth and object ends change, where
the wanted arrays begin, and the text up to the first ends of what it may have begun in the middle of. The
descriptions, a short row a range, are put in order and say how every range truly begins; a second scan
then gives whole objects. No task reads more than its ranges.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.errors import DatasetBuildError

#: Characters that are looked at together, and how much of an object's rest is described at first.
CHUNK, REST = 1 << 22, 1 << 16
#: Depth of the objects that are wanted: in an array in the document's object.
DEPTH = 3
#: Key of a range's whole text among its rests, which have depths below 0.
WHOLE = 1
_QUOTE, _SLASH, _OPEN, _CLOSE, _LEFT, _RIGHT = b'"\\{}[]'


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes, bool]]:
    """(path, block, text, whether the block begins with it), the texts of a block in order; "}" is put back."""
    known, held, size, fresh = None, [], 0, True
    for b in batches:
        for path, block, value in zip(b["path"].to_pylist(), b["block"].to_pylist(), b["value"].to_pylist()):
            if (path, block) != known or size >= CHUNK:
                if held:
                    yield *known, b"".join(held), fresh
                fresh = (path, block) != known
                known, held, size = (path, block), [], 0
            piece = value.encode("utf-8", "surrogatepass") + b"}"
            held.append(piece)
            size += len(piece)
    if held:
        yield *known, b"".join(held), fresh


def _structure(text: bytes, parity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places of brackets, +1 or -1 of each, parity of the quotes before each, parity at the end)."""
    b = np.frombuffer(text, dtype=np.uint8)
    quotes = np.flatnonzero(b == _QUOTE)
    if _SLASH in text:
        plain = np.maximum.accumulate(np.where(b != _SLASH, np.arange(len(b)), -1))
        before = np.where(quotes > 0, plain[quotes - 1], -1)
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
    at = np.flatnonzero((b == _OPEN) | (b == _CLOSE) | (b == _LEFT) | (b == _RIGHT))
    inside = (np.searchsorted(quotes, at) + parity) & 1
    return at, np.where((b[at] == _OPEN) | (b[at] == _LEFT), 1, -1), inside, (parity + len(quotes)) & 1


_ABOUT = "path string, block long, flips int, begins_inside int, depth long, ends map<long,long>, arrays array<struct<depth:long,name:string,ends:long>>, rests map<long,string>"


def _describe(names: tuple[str, ...], rest: int):
    wanted = re.compile(('"(' + "|".join(map(re.escape, names)) + ')"\\s*:\\s*\\[').encode())

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about: dict = {}

        def row(case: int) -> dict:
            x = about["cases"][case]
            if about["block"] and about["size"] <= rest:  # a short range, all of which may belong to one object
                x["rests"][WHOLE] = about["read"].decode("utf-8", "surrogatepass")
            return {"path": about["path"], "block": about["block"], "flips": about["parity"], "begins_inside": case, "depth": x["depth"], "ends": list(x["ends"].items()), "arrays": x["arrays"], "rests": list(x["rests"].items())}

        def rows() -> pa.RecordBatch:
            kinds = {"path": pa.string(), "block": pa.int64(), "flips": pa.int32(), "begins_inside": pa.int32(), "depth": pa.int64(), "ends": pa.map_(pa.int64(), pa.int64()),
                     "arrays": pa.list_(pa.struct([("depth", pa.int64()), ("name", pa.string()), ("ends", pa.int64())])), "rests": pa.map_(pa.int64(), pa.string())}
            both = [row(0), row(1)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in both], kind) for k, kind in kinds.items()], list(kinds))

        for path, block, text, fresh in _texts(batches):
            if fresh:
                if about:
                    yield rows()
                about = {"path": path, "block": block, "parity": 0, "read": b"", "size": 0, "cases": [{"depth": 0, "ends": defaultdict(int), "arrays": [], "rests": {}} for _ in range(2)]}
            at, step, inside, parity = _structure(text, about["parity"])
            close = np.frombuffer(text, dtype=np.uint8)[at] == _CLOSE
            offset = about["size"]
            about["size"] += len(text)
            if offset < rest:
                about["read"] += text[: rest - offset]
            for case, x in enumerate(about["cases"]):
                real = inside == case
                depth = x["depth"] + np.cumsum(step[real])
                place, ending = at[real], close[real]
                for m in wanted.finditer(text):
                    k = int(np.searchsorted(place, m.end() - 1))
                    if k < len(place) and place[k] == m.end() - 1:
                        d = int(depth[k])
                        # its own depth is one more than that of the ends of the objects in it
                        x["arrays"].append({"depth": d, "name": m[1].decode(), "ends": x["ends"][d] + int((ending[:k] & (depth[:k] == d)).sum())})
                values, counts = np.unique(depth[ending], return_counts=True)
                for d, n in zip(values.tolist(), counts.tolist()):
                    x["ends"][d] += n
                # the text up to where something that was open at the beginning closes
                for d in range(-1, int(values.min()) - 1 if len(values) else 0, -1):
                    if d not in x["rests"]:
                        first = int(place[ending & (depth == d)][0]) + 1 if (ending & (depth == d)).any() else None
                        if first is not None and offset + first <= rest:
                            x["rests"][d] = about["read"][: offset + first].decode("utf-8", "surrogatepass")
                x["depth"] += int(step[real].sum())
            about["parity"] = parity
        if about:
            yield rows()

    return describe


def _beginnings(about: DataFrame) -> tuple[dict, dict, bool]:
    """How every block begins: (inside, depth, objects ended before, array, rest of the object open at its end); the first number of each array; whether all rests were there."""
    told = defaultdict(dict)
    for r in about.collect():  # two short rows a block
        told[r["path"], r["block"]][r["begins_inside"]] = r
    begins, first, complete = {}, {}, True
    inside = depth = ended = 0
    array, owner, now = None, None, None
    for path, block in sorted(told):
        if now != path:
            inside, depth, ended, array, owner, now = 0, 0, 0, None, None, path
        r, level = told[path, block][inside], DEPTH - 1 - depth
        begins[path, block] = [inside, depth, ended, array, ""]
        closes = r["ends"].get(level, 0)
        if depth >= DEPTH and owner:
            rest = r["rests"].get(level if closes else WHOLE)
            complete &= rest is not None
            begins[owner][4] += rest or ""
        if closes or depth < DEPTH:
            owner = path, block  # what is open at this block's end began in it
        for a in r["arrays"]:
            if a["depth"] == level:
                array = a["name"]
                first.setdefault((path, array), ended + a["ends"])
        ended += closes
        depth, inside = depth + r["depth"], inside ^ (r["flips"] & 1)
    return begins, first, complete


def objects(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """(path, name, no from 0, value): the objects of the named arrays of each document's object, as JSON texts.

    Arrays elsewhere and what is no object is passed over; of a document that is cut off, what is whole comes.
    """
    rest = REST
    while True:
        begins, first, complete = _beginnings(_pieces(spark, path).mapInArrow(_describe(names, rest), _ABOUT))
        if complete:
            break
        if rest > 1 << 28:
            raise DatasetBuildError(f"{path}: an object goes on over more than {rest} bytes of a range")
        rest <<= 6
    finder = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')

    def whole(batches):
        depth = parity = ended = 0
        array, held, ends_with = None, b"", ""
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            kinds = {"path": pa.string(), "name": pa.string(), "no": pa.int64(), "value": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))

        def tell(path: str, text: bytes) -> None:
            if array in names:
                out.append((path, array, ended - first[path, array], text.decode("utf-8", "surrogatepass")))

        open_, known = False, None
        for path, block, text, fresh in _texts(batches):
            if fresh:
                if open_ and ends_with:
                    tell(known, held + ends_with.encode("utf-8", "surrogatepass"))
                parity, depth, ended, array, ends_with = begins[path, block]
                open_, held, known = False, b"", path
            at, step, inside, parity = _structure(text, parity)
            at, step = at[inside == 0], step[inside == 0]
            after = depth + np.cumsum(step)
            depth = int(after[-1]) if len(after) else depth
            char = np.frombuffer(text, dtype=np.uint8)[at]
            marks = np.flatnonzero(((char == _LEFT) & (after == DEPTH - 1)) | ((char == _OPEN) & (after == DEPTH)) | ((char == _CLOSE) & (after == DEPTH - 1)))
            begin = 0
            for k in marks.tolist():
                place = int(at[k])
                if char[k] == _LEFT:
                    named = finder.search(text, max(0, place - 300), place)
                    array = named[1].decode("utf-8", "replace") if named else None
                elif char[k] == _OPEN:
                    open_, begin, held = True, place, b""
                else:
                    if open_:
                        tell(path, held + text[begin : place + 1])
                    open_, held = False, b""
                    ended += 1
            if open_:
                held += text[begin:]
            if len(out) > 4096:
                yield flush()
        if open_ and ends_with:
            tell(known, held + ends_with.encode("utf-8", "surrogatepass"))
        yield flush()

    return _pieces(spark, path).mapInArrow(whole, "path string, name string, no long, value string")
