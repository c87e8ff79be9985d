"""Suppression, matching and scores of detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, iou
from ..functions.numbers import safe_ratio
from .tiling import centre_zone, within_page

#: Side of the grid cells in which boxes look for partners.
CELL = 128


def suppress(detections: DataFrame, keys: list[str], threshold: float = 0.45, order: str = "idx") -> DataFrame:
    """Greedy suppression in each group: by falling score (then ``order``), a box stays unless it overlaps one that
    stayed by more than the threshold. A fold over the group's sorted boxes; groups are pages, so they are bounded."""
    fields = ["x1", "y1", "x2", "y2", order]
    item = F.struct((-F.col("score")).alias("neg"), F.col(order).alias("_o"), *fields, "score")
    grouped = detections.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, b: F.when(F.exists(acc, lambda k: iou(k, b) > threshold), acc).otherwise(F.concat(acc, F.array(b))))
    return grouped.select(*keys, F.explode(kept).alias("b")).select(*keys, *[f"b.{f}" for f in fields], "b.score")


def merge_tiles(detections: DataFrame, conf: float = 0.35, threshold: float = 0.45, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """Raw detections of tiles (tile-relative corners, obj, cls_conf, tile place x0, y0 and size w, h) to page boxes:
    confidence, suppression in each tile, centre zone, page coordinates, page bounds, suppression in each page."""
    scored = detections.withColumn("score", F.col("obj") * F.col("cls_conf")).where(F.col("score") >= conf)
    place = scored.select("page", "tile_idx", "x0", "y0", "w", "h").distinct()
    first = suppress(scored, ["page", "tile_idx"], threshold).join(place, ["page", "tile_idx"])
    shifted = centre_zone(first).withColumns({c: F.col(c) + F.col(f"{c[0]}0") for c in ("x1", "y1", "x2", "y2")})
    return suppress(within_page(shifted, width, height).withColumn("idx", F.struct("tile_idx", "idx")), ["page"], threshold)


def candidate_pairs(truth: DataFrame, found: DataFrame, page: str = "page", cell: int = CELL) -> DataFrame:
    """Overlapping pairs of one page with their iou, each once. Boxes meet on (page, grid cell) and a pair counts in the
    cell of its intersection's upper left corner, so no distinct is needed and dense pages don't meet all to all."""

    def gridded(df: DataFrame, side: str) -> DataFrame:
        own = df.select(page, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != page])
        cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / cell)))
        return own.withColumn("_cx", cells(f"{side}_x1", f"{side}_x2")).withColumn("_cy", cells(f"{side}_y1", f"{side}_y2"))

    met = gridded(truth, "t").join(gridded(found, "p"), [page, "_cx", "_cy"])
    t, p = box("t_"), box("p_")
    left, top = F.greatest(t["x1"], p["x1"]), F.greatest(t["y1"], p["y1"])
    home = (F.floor(left / cell) == F.col("_cx")) & (F.floor(top / cell) == F.col("_cy"))
    return met.where(home).withColumn("iou", iou(t, p)).where("iou > 0").drop("_cx", "_cy")


def best_for_truth(pairs: DataFrame, page: str = "page", threshold: float = 0.5) -> DataFrame:
    """For each truth its best prediction above the threshold (lowest index on ties); one prediction may serve several."""
    order = Window.partitionBy(page, "t_idx").orderBy(F.desc("iou"), "p_idx")
    return pairs.where(F.col("iou") > threshold).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def best_for_prediction(found: DataFrame, pairs: DataFrame, page: str = "page", threshold: float = 0.5) -> DataFrame:
    """Every prediction with its best truth above the threshold, or nulls."""
    order = Window.partitionBy(page, "p_idx").orderBy(F.desc("iou"), "t_idx")
    best = pairs.where(F.col("iou") > threshold).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    keep = [c for c in best.columns if c.startswith("t_")] + ["iou"]
    return found.join(best.select(page, F.col("p_idx").alias("idx"), *keep), [page, "idx"], "left")


def f1_table(truth: DataFrame, found: DataFrame, matched: DataFrame, page: str = "page", total: str = "TOTAL") -> DataFrame:
    """Per page and in total: gt_count, pred_count, correct (matched with the right char), recall, precision and F1 in
    percent. The totals come from the same pass, by a rollup."""
    counts = truth.select(page, F.lit(1).alias("gt"), F.lit(0).alias("pr"), F.lit(0).alias("ok"))
    counts = counts.unionByName(found.select(page, F.lit(0).alias("gt"), F.lit(1).alias("pr"), F.lit(0).alias("ok")))
    counts = counts.unionByName(matched.select(page, F.lit(0).alias("gt"), F.lit(0).alias("pr"), (F.col("t_char") == F.col("p_char")).cast("int").alias("ok")))
    sums = counts.rollup(page).agg(F.grouping(page).alias("_all"), F.sum("gt").alias("gt_count"), F.sum("pr").alias("pred_count"), F.sum("ok").alias("correct"))
    recall, precision = safe_ratio(100.0 * F.col("correct"), F.col("gt_count")), safe_ratio(100.0 * F.col("correct"), F.col("pred_count"))
    out = sums.withColumns({"recall": recall, "precision": precision})
    f1 = safe_ratio(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision"))
    return out.select(F.when(F.col("_all") == 1, total).otherwise(F.col(page).cast("string")).alias("image"), "gt_count", "pred_count", "correct", "recall", "precision", f1.alias("f1"))


def confidence_by_outcome(matched: DataFrame) -> DataFrame:
    """Confidence of right and of wrong matches: number, mean, median, 90th percentile, below 0.5, above 0.8."""
    ok = (F.col("t_char") == F.col("p_char")).alias("is_ok")
    conf = F.col("p_conf")
    return matched.groupBy(ok).agg(F.count(F.lit(1)).alias("n"), F.avg(conf).alias("mean_conf"), F.median(conf).alias("median_conf"), F.percentile(conf, 0.9).alias("p90_conf"), F.count_if(conf < 0.5).alias("below_half"), F.count_if(conf > 0.8).alias("above_08"))


def same_image(a: Column, b: Column, substring: bool = False) -> Column:
    """Whether two image names mean one image: equal, or on request one within the other."""
    return (F.contains(a, b) | F.contains(b, a)) if substring else a == b
