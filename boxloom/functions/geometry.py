"""Box and point arithmetic as columns. Boxes are x1, y1, x2, y2 with exclusive right and lower edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def normalize(v: Column, extent, factor=1000) -> Column:
    """v / extent * factor, in this order; an extent that is not positive raises."""
    extent = _col(extent)
    return F.when(extent > 0, v / extent * factor).otherwise(F.raise_error("extent must be positive").cast("double"))


def half_even(v: Column) -> Column:
    """Rounded to the nearest whole number, ties to even."""
    return F.rint(v).cast("long")


def to_text(*values: Column) -> Column:
    return F.concat_ws(",", *[half_even(v).cast("string") for v in values])


def width(x1: Column, x2: Column) -> Column:
    return x2 - x1


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def clamp(v: Column, low, high) -> Column:
    return F.greatest(_col(low), F.least(_col(high), v))


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column, width, height) -> Column:
    """struct(x1, y1, x2, y2): clamped to the image, then rounded outward."""
    return F.struct(
        F.floor(clamp(x, 0.0, _col(width).cast("double"))).alias("x1"), F.floor(clamp(y, 0.0, _col(height).cast("double"))).alias("y1"),
        F.ceil(clamp(x + w, 0.0, _col(width).cast("double"))).alias("x2"), F.ceil(clamp(y + h, 0.0, _col(height).cast("double"))).alias("y2"),
    )


def is_valid(box: Column) -> Column:
    return F.coalesce((box["x1"] < box["x2"]) & (box["y1"] < box["y2"]), F.lit(False))


def center(box: Column) -> Column:
    """struct(x, y, is_positive): half-even middle."""
    return F.struct(
        half_even((box["x1"] + box["x2"]) / 2).alias("x"), half_even((box["y1"] + box["y2"]) / 2).alias("y"),
        F.lit(True).alias("is_positive"),
    )


def yolo_to_xywh(xc: Column, yc: Column, wn: Column, hn: Column, width: Column, height: Column) -> Column:
    """struct(x, y, w, h) in pixels. A box over the left or upper edge keeps its full extent from the edge."""
    x = F.greatest(F.lit(0.0), xc * width - wn * width / 2)
    y = F.greatest(F.lit(0.0), yc * height - hn * height / 2)
    w = F.greatest(F.lit(0.0), F.least(wn * width, width - x))
    h = F.greatest(F.lit(0.0), F.least(hn * height, height - y))
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def rounded(v: Column, places: int) -> Column:
    """v to so many decimal places as its binary value says, exact halves to even.

    Decimal rounding goes by the shortest text of a number, which may be a half where the number is not. There the
    product with twice the power of ten is all but an odd whole number, and what it lies beside it by, worked out
    exactly with split factors, says on which side of the half the number is.
    """
    double, power = float(2 * 10**places), float(10**places)
    whole, spread = F.rint(v * double), v * 134217729.0  # 2 ** 27 + 1 splits a double into halves that multiply exactly
    high = spread - (spread - v)
    beside = (high * double - whole) + (v - high) * double
    half = (F.abs(whole) % 2 == 1) & (F.abs(beside) < 1e-6) & (beside != 0)
    return F.when(half, (whole + F.signum(beside)) / 2 / power).otherwise(F.bround(v, places))


def unit_xyxy(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, places: int = 4) -> Column:
    """struct of the corners in 0..1, rounded."""
    r = lambda v: rounded(v, places)
    return F.struct(r(x / width).alias("x1"), r(y / height).alias("y1"), r((x + w) / width).alias("x2"), r((y + h) / height).alias("y2"))


def pixels(coords: Column, width: Column, height: Column, factor=1000, normalized: bool = True) -> Column:
    """array of four numbers -> struct(xa, ya, xb, yb): denormalised, half-even. Null unless there are four."""
    px = lambda i, extent: half_even(F.get(coords, F.lit(i)) / factor * extent if normalized else F.get(coords, F.lit(i)))
    four = F.struct(px(0, width).alias("xa"), px(1, height).alias("ya"), px(2, width).alias("xb"), px(3, height).alias("yb"))
    return F.when(F.size(coords) == 4, four)


def pixel_box(px: Column, width: Column, height: Column) -> Column:
    """struct(x1, y1, x2, y2) of pixels: corners reordered, at least in the image. Null if they are null.

    Left and upper edges lie in [0, extent - 1], the others in [1, extent].
    """
    xa, ya, xb, yb = (px[c] for c in ("xa", "ya", "xb", "yb"))
    box = F.struct(
        clamp(F.least(xa, xb), 0, width - 1).alias("x1"), clamp(F.least(ya, yb), 0, height - 1).alias("y1"),
        clamp(F.greatest(xa, xb), 1, width).alias("x2"), clamp(F.greatest(ya, yb), 1, height).alias("y2"),
    )
    return F.when(px.isNotNull(), box)


def to_pixels(coords: Column, width: Column, height: Column, factor=1000, normalized: bool = True) -> Column:
    """array of four numbers -> struct(x1, y1, x2, y2), as pixel_box has it. Null unless there are four."""
    return pixel_box(pixels(coords, width, height, factor, normalized), width, height)


def prompt_box(box: Column, width: Column, height: Column) -> Column:
    """Rounded, inside the image, at least one pixel wide and high."""
    x1, y1 = clamp(half_even(box["x1"]), 0, width - 1), clamp(half_even(box["y1"]), 0, height - 1)
    x2, y2 = clamp(half_even(box["x2"]), 0, width), clamp(half_even(box["y2"]), 0, height)
    return F.struct(x1.alias("x1"), y1.alias("y1"), F.greatest(x2, x1 + 1).alias("x2"), F.greatest(y2, y1 + 1).alias("y2"))


def percent_to_pixels(v: Column, extent: Column) -> Column:
    return v / 100 * extent


def percent_rect(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Edges are rounded on their own, the far one as near edge plus extent."""
    x0, y0 = percent_to_pixels(x, width), percent_to_pixels(y, height)
    return F.struct(
        half_even(x0).alias("x1"), half_even(y0).alias("y1"),
        half_even(x0 + percent_to_pixels(w, width)).alias("x2"), half_even(y0 + percent_to_pixels(h, height)).alias("y2"),
    )


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; negative extents count as 0, and so does an empty union. Null corners give null."""
    zero = F.lit(0.0)
    side = lambda lo, hi: F.greatest(zero, hi - lo)
    inter = side(F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"])) * side(F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"]))
    union = side(a["x1"], a["x2"]) * side(a["y1"], a["y2"]) + side(b["x1"], b["x2"]) * side(b["y1"], b["y2"]) - inter
    whole = a["x1"] + a["y1"] + a["x2"] + a["y2"] + b["x1"] + b["y1"] + b["x2"] + b["y2"]
    return F.when(whole.isNull(), None).when(union > 0, inter / union).otherwise(zero)


def safe_div(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))
