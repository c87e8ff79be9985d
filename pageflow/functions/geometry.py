"""Boxes and tiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Corners rounded half to even, kept within the page, at least one pixel apart."""
    low_x = F.least(F.greatest(F.bround(x).cast("int"), F.lit(0)), width - 1)
    low_y = F.least(F.greatest(F.bround(y).cast("int"), F.lit(0)), height - 1)
    return {
        "x1": low_x,
        "y1": low_y,
        "x2": F.greatest(F.least(F.bround(x + w).cast("int"), width), low_x + 1),
        "y2": F.greatest(F.least(F.bround(y + h).cast("int"), height), low_y + 1),
    }


def area(b: dict[str, Column] | Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: dict[str, Column] | Column, b: dict[str, Column] | Column) -> Column:
    """Intersection over union; 0 where nothing overlaps, whatever the boxes."""
    wide = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    high = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    both = wide * high
    return F.when(both > 0, F.try_divide(both, area(a) + area(b) - both)).otherwise(F.lit(0.0))


def box(df_prefix: str = "") -> dict[str, Column]:
    return {k: F.col(f"{df_prefix}{k}") for k in ("x1", "y1", "x2", "y2")}


def polygon(b: dict[str, Column]) -> Column:
    """Four corners, clockwise from the top left, as eight numbers."""
    return F.array(b["x1"], b["y1"], b["x2"], b["y1"], b["x2"], b["y2"], b["x1"], b["y2"])


def polygon_box(points: Column) -> dict[str, Column]:
    """Bounding box of eight numbers, not below zero."""
    xs = F.filter(points, lambda _, i: i % 2 == 0)
    ys = F.filter(points, lambda _, i: i % 2 == 1)
    zero = F.lit(0)
    return {"x1": F.greatest(zero, F.array_min(xs)), "y1": F.greatest(zero, F.array_min(ys)), "x2": F.greatest(zero, F.array_max(xs)), "y2": F.greatest(zero, F.array_max(ys))}


def tile_starts(size: Column, tile: int, stride: int) -> Column:
    """Starts of tiles along one axis, until a tile reaches the end."""
    last = F.ceil(F.greatest(size - tile, F.lit(0)) / stride).cast("int") * stride
    return F.sequence(F.lit(0), last, F.lit(stride))


def adaptive_starts(size: Column, crop: int) -> Column:
    """Starts of evenly spread crops of one size; the last ends at the edge."""
    n = F.ceil(size / crop).cast("int")
    step = F.when(n > 1, F.ceil((size - crop) / F.nullif(n - 1, F.lit(0))).cast("int")).otherwise(F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.greatest(F.lit(0), F.least(i * step, size - crop))))


def letterbox(width: Column, height: Column, target: int, rounding: str = "round") -> tuple[Column, Column, Column, Column]:
    """Scaled width and height that fit a square, at least one pixel, and the left and top margin."""
    scale = F.least(F.lit(float(target)) / width, F.lit(float(target)) / height)
    fit = (lambda v: F.bround(v).cast("int")) if rounding == "round" else (lambda v: v.cast("int"))
    w, h = F.greatest(F.lit(1), fit(width * scale)), F.greatest(F.lit(1), fit(height * scale))
    return w, h, F.floor((F.lit(target) - w) / 2).cast("int"), F.floor((F.lit(target) - h) / 2).cast("int")


def pad_to_multiple(size: Column, multiple: int) -> Column:
    return F.pmod(F.lit(multiple) - F.pmod(size, F.lit(multiple)), F.lit(multiple))
