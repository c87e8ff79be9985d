"""Reading order: right-to-left columns, projection islands, recursive XY cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reading_order(boxes: DataFrame, page: str = "page", index: str = "idx") -> DataFrame:
    """Adds ``col_id`` and ``pos``: columns from the right, each from top to bottom. Coordinates count as whole numbers,
    cut towards zero.

    A new column begins where the centre moves further than 0.8 of the page's median width (5 pixels at least) from the
    box before. One shuffle on the page serves the median, the columns and the positions.
    """
    page_all = Window.partitionBy(page)
    by_x = page_all.orderBy(F.desc("_cx"), index)
    x1, y1, x2, y2 = (F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2"))
    cx, cy = (x1 + x2) / 2.0, (y1 + y2) / 2.0
    width = F.greatest(F.lit(1), x2 - x1)
    gap = F.greatest((F.median(width).over(page_all) * 0.8).cast("int"), F.lit(5))
    moved = F.abs(F.col("_cx") - F.lag("_cx").over(by_x)) > F.col("_gap")
    walked = boxes.withColumns({"_cx": cx, "_cy": cy, "_gap": gap}).withColumn("_new", F.coalesce(moved, F.lit(False)).cast("int"))
    columns = walked.withColumn("col_id", F.sum("_new").over(by_x.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    order = page_all.orderBy("col_id", "_cy", index)
    return columns.withColumn("pos", F.row_number().over(order) - 1).drop("_cx", "_cy", "_gap", "_new")


def islands(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Joins intervals that overlap or touch; one row for each island: keys, island, start, end, members.
    Intervals of no extent are left out."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.where(F.col(end) > F.col(start)).withColumn("_new", F.coalesce(F.col(start) > reach, F.lit(False)).cast("int"))
    numbered = marked.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("members"))


def _cut(boxes: list[tuple[int, int, int, int, int]], axis: int) -> list[list[tuple[int, int, int, int, int]]]:
    """Groups between which at least one pixel row (axis 1) or column (axis 0) is empty."""
    out, reach = [], None
    for b in sorted((b for b in boxes if b[axis + 2] > b[axis]), key=lambda b: b[axis]):
        if reach is None or b[axis] > reach:
            out.append([])
        out[-1].append(b)
        reach = b[axis + 2] if reach is None else max(reach, b[axis + 2])
    return out


def xy_order(boxes: list[tuple[int, int, int, int, int]]) -> list[int]:
    """Numbers of the boxes (x1, y1, x2, y2, number) in the order of recursive cuts: rows first, then columns in each.
    Boxes without extent along a cut vanish."""
    out: list[int] = []
    for row in _cut(boxes, 1):
        columns = _cut(row, 0)
        if len(columns) == 1:
            out += [b[4] for b in columns[0]]
        else:
            for column in columns:
                out += xy_order(column)
    return out


def xy_cut(boxes: DataFrame, page: str = "page", index: str = "idx") -> DataFrame:
    """page, idx, pos by recursive cuts. The depth depends on the data, so a page is a group in Python."""

    def order(key, pdf):
        import pandas as pd

        rows = list(pdf[["x1", "y1", "x2", "y2", index]].astype(int).itertuples(index=False, name=None))
        found = xy_order(rows)
        return pd.DataFrame({page: [key[0]] * len(found), index: found, "pos": range(len(found))})

    kind = dict(boxes.dtypes)
    return boxes.select(page, "x1", "y1", "x2", "y2", index).groupBy(page).applyInPandas(order, f"{page} {kind[page]}, {index} {kind[index]}, pos int")
