"""Tiles of pages, and boxes that fall into them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import adaptive_starts, tile_starts


def tiles(pages: DataFrame, tile: int = 640, stride: int = 320, pad: int = 0) -> DataFrame:
    """A row for each tile of each page (page, width, height): tile_idx, x0, y0 relative to the unpadded page, and the
    actual w and h of the tile within the padded page."""
    wide, high = F.col("width") + 2 * pad, F.col("height") + 2 * pad
    ys = pages.select("page", "width", "height", F.posexplode(tile_starts(high, tile, stride)).alias("_j", "_y"))
    xs = ys.select("page", "width", "height", "_j", "_y", F.posexplode(tile_starts(wide, tile, stride)).alias("_i", "_x"), F.size(tile_starts(wide, tile, stride)).alias("_n"))
    return xs.select(
        "page",
        (F.col("_j") * F.col("_n") + F.col("_i")).cast("int").alias("tile_idx"),
        (F.col("_x") - pad).cast("int").alias("x0"),
        (F.col("_y") - pad).cast("int").alias("y0"),
        F.least(F.lit(tile), wide - F.col("_x")).cast("int").alias("w"),
        F.least(F.lit(tile), high - F.col("_y")).cast("int").alias("h"),
    )


def uniform_patches(pages: DataFrame, size: int = 128, stride: int = 64) -> DataFrame:
    """Patches at every stride, thin ones at the ends too."""
    at = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1, F.lit(stride)))
    both = pages.select("page", "width", "height", at("height").alias("y0")).select("page", "width", "height", "y0", at("width").alias("x0"))
    return both.select("page", "x0", "y0", F.least(F.lit(size), F.col("width") - F.col("x0")).alias("w"), F.least(F.lit(size), F.col("height") - F.col("y0")).alias("h"))


def adaptive_grid(pages: DataFrame, crop: int) -> DataFrame:
    """Crops of one size spread evenly, the last flush with the edge."""
    ys = pages.select("page", "width", "height", F.explode(adaptive_starts(F.col("height"), crop)).alias("y0"))
    return ys.select("page", F.explode(adaptive_starts(F.col("width"), crop)).alias("x0"), "y0")


def tiles_of_boxes(boxes: DataFrame, tile: int = 640, stride: int = 320, min_side: int = 2) -> DataFrame:
    """Every box with each tile whose half-open square holds its centre, clipped to it; sides below ``min_side`` go.

    Which tiles these are follows from the centre by arithmetic, so there is no join. ``boxes`` has page, width, height,
    x1, y1, x2, y2; the result adds tile_idx and the clipped corners relative to the tile.
    """
    cx, cy = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0

    def covering(centre, size):
        last = F.ceil(F.greatest(size - tile, F.lit(0)) / stride).cast("int")
        low = F.greatest(F.lit(0), (F.floor((centre - tile) / stride) + 1).cast("int"))
        high = F.least(last, F.floor(centre / stride).cast("int"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    placed = boxes.withColumns({"_cx": cx, "_cy": cy, "_n": F.size(tile_starts(F.col("width"), tile, stride))})
    placed = placed.withColumn("_i", F.explode(covering(F.col("_cx"), F.col("width")))).withColumn("_j", F.explode(covering(F.col("_cy"), F.col("height"))))
    x0, y0 = F.col("_i") * stride, F.col("_j") * stride
    w, h = F.least(F.lit(tile), F.col("width") - x0), F.least(F.lit(tile), F.col("height") - y0)
    inside = (F.col("_cx") < x0 + w) & (F.col("_cy") < y0 + h)
    clipped = placed.where(inside).withColumns({
        "tile_idx": (F.col("_j") * F.col("_n") + F.col("_i")).cast("int"),
        "tx1": F.greatest(F.col("x1") - x0, F.lit(0)),
        "ty1": F.greatest(F.col("y1") - y0, F.lit(0)),
        "tx2": F.least(F.col("x2") - x0, w),
        "ty2": F.least(F.col("y2") - y0, h),
    })
    return clipped.where((F.col("tx2") - F.col("tx1") >= min_side) & (F.col("ty2") - F.col("ty1") >= min_side)).drop("_cx", "_cy", "_n", "_i", "_j")


def centre_zone(detections: DataFrame) -> DataFrame:
    """Detections whose centre lies in the middle half of their tile (columns w and h), bounds truncated and inclusive."""
    cx, cy = ((F.col("x1") + F.col("x2")) / 2).cast("int"), ((F.col("y1") + F.col("y2")) / 2).cast("int")
    low = lambda c: (F.col(c) * 0.25).cast("int")
    high = lambda c: (F.col(c) * 0.75).cast("int")
    return detections.where(cx.between(low("w"), high("w")) & cy.between(low("h"), high("h")))


def within_page(detections: DataFrame, width=None, height=None) -> DataFrame:
    """Detections inside the page; all of them where no size is given."""
    if width is None or height is None:
        return detections
    return detections.where("x1 >= 0 AND y1 >= 0 AND x1 < x2 AND y1 < y2").where((F.col("x2") <= width) & (F.col("y2") <= height))


def fixed_cut(pages: DataFrame, size: int = 704, parts: int = 11) -> DataFrame:
    """page, name, x0, y0, x1, y1 of the equal pieces that a page resized to a square is cut into, columns first."""
    step = size // parts
    starts = F.sequence(F.lit(0), F.lit(size - 1), F.lit(step))
    cut = pages.select("page", F.explode(starts).alias("x0")).select("page", "x0", F.explode(starts).alias("y0"))
    return cut.select("page", F.format_string("%d_%d.png", "x0", "y0").alias("name"), "x0", "y0", (F.col("x0") + step).alias("x1"), (F.col("y0") + step).alias("y1"))
