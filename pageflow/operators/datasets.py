"""Splits, ids, class lists and incremental work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stages import written


def dense_ids(df: DataFrame, order: list[str], name: str = "id", start: int = 0) -> DataFrame:
    """Consecutive numbers in a total order, without one task that sees all rows: a range partitioning, sorted within, is
    written once with each row's partition and place; offsets follow from counts by partition. Whatever is read of the
    result later, boundaries are those of the written stage."""
    place = F.monotonically_increasing_id()  # the partition above bit 33, the place in it below
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place)
    made = written(ordered, "dense-ids").withColumn("_part", F.shiftright("_place", 33))
    counts = made.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    at = F.col("_place").bitwiseAND((1 << 33) - 1)
    return made.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + at + start).drop("_part", "_place", "_before")


def pending(work: DataFrame, done: DataFrame, key: str, inputs: list[DataFrame] | None = None) -> DataFrame:
    """Work whose inputs are all there and whose output is not."""
    for needed in inputs or []:
        work = work.join(needed.select(key).distinct(), key, "left_semi")
    return work.join(done.select(key), key, "left_anti")


def progress(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    flagged = work.join(done.select(key).distinct().withColumn("_d", F.lit(True)), key, "left")
    return flagged.agg(F.count_if(F.col("_d").isNotNull()).alias("processed"), F.count_if(F.col("_d").isNull()).alias("remaining"))


def split_members(items: DataFrame, splits: dict[str, list[str]], key: str) -> DataFrame:
    """Items with the split that lists their key; items of no split are left out."""
    spark = items.sparkSession
    table = spark.createDataFrame([(s, k) for s, ks in splits.items() for k in ks], f"split string, {key} string")
    return items.join(F.broadcast(table), key)


def missing_members(items: DataFrame, splits: dict[str, list[str]], key: str) -> DataFrame:
    table = items.sparkSession.createDataFrame([(s, k) for s, ks in splits.items() for k in ks], f"split string, {key} string")
    return table.join(items.select(key).distinct(), key, "left_anti")


def hash_order(key: Column) -> Column:
    """A fixed pseudo-random number below 2**32 for each key."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def validation_split(items: DataFrame, key: str, share: float = 0.1, groups: list[str] | None = None) -> DataFrame:
    """Adds ``split``: the first tenth (one at least) in hash order is ``val``. Without groups the boundary is found from
    counts, not by sorting all rows in one task."""
    if groups:
        order = Window.partitionBy(*groups).orderBy(hash_order(F.col(key)), key)
        n = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy(*groups)) * share))
        return items.withColumn("split", F.when(F.row_number().over(order) <= n, "val").otherwise("train"))
    ranked = dense_ids(items.withColumn("_h", hash_order(F.col(key))), ["_h", key], "_rank")
    n = items.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share)).alias("_n"))
    return ranked.crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col("_rank") < F.col("_n"), "val").otherwise("train")).drop("_h", "_rank", "_n")


def class_index(samples: DataFrame, cls: str = "cls") -> DataFrame:
    """cls, class_id (place in the sorted names), n, weight (1 / n)."""
    counts = samples.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("class_id", F.row_number().over(Window.orderBy(cls)) - 1).withColumn("weight", 1.0 / F.col("n"))  # a row for each class


def drawn(*parts: Column) -> Column:
    """A whole number of 60 bits from a digest of the parts: the same at every run and in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in parts])), 1, 15), 16, 10).cast("long")


def weighted_draws(samples: DataFrame, n: int, key: str, cls: str = "cls", seed: int = 0) -> DataFrame:
    """n draws with replacement in which all classes are equally likely: a uniform class, then a uniform member. Members
    are numbered within their class, so a draw is an equi-join on (class, number)."""
    counts = class_index(samples, cls).select(cls, "class_id", "n")
    members = samples.withColumn("_i", F.row_number().over(Window.partitionBy(cls).orderBy(hash_order(F.col(key)), key)) - 1)
    k = counts.count()
    draws = samples.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(drawn(F.lit(seed), F.lit("class"), F.col("id")), F.lit(max(k, 1))).cast("int").alias("class_id"), drawn(F.lit(seed), F.lit("member"), F.col("id")).alias("_u"))
    picked = draws.join(F.broadcast(counts), "class_id").withColumn("_i", F.pmod("_u", "n").cast("int"))
    return picked.select("draw", cls, "_i").join(members, [cls, "_i"]).drop("_i")


def coco(pages: DataFrame, boxes: DataFrame, tile: int = 640, stride: int = 320, date: str = "2024") -> tuple[DataFrame, DataFrame]:
    """Images (one a tile with boxes) and annotations of a COCO document, with dense ids in page and tile order."""
    from ..functions.geometry import polygon
    from .tiling import tiles, tiles_of_boxes

    placed = tiles_of_boxes(boxes.join(pages, "page"), tile, stride)
    name = F.format_string("%s_%03d.jpg", F.col("page").cast("string"), F.col("tile_idx"))
    used = placed.select("page", "tile_idx").distinct()
    images = dense_ids(tiles(pages, tile, stride).join(used, ["page", "tile_idx"], "left_semi"), ["page", "tile_idx"])
    b = {k: F.col(f"t{k}").cast("double") for k in ("x1", "y1", "x2", "y2")}
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    notes = placed.join(images.select("page", "tile_idx", F.col("id").alias("image_id")), ["page", "tile_idx"])
    notes = dense_ids(notes, ["image_id", "idx"]).select("id", "image_id", F.lit(1).alias("category_id"), F.array(b["x1"], b["y1"], w, h).alias("bbox"), (w * h).alias("area"), F.array(polygon(b)).alias("segmentation"), F.lit(0).alias("iscrowd"))
    return images.select("id", name.alias("file_name"), F.col("w").alias("width"), F.col("h").alias("height"), F.lit(date).alias("date_captured")), notes


def early_stop(metrics: DataFrame, gain: float = 0.0005, patience: int = 10, run: str = "run", epoch: str = "epoch", value: str = "value") -> DataFrame:
    """run, best, best_epoch, stop_epoch: a fold over each run's epochs; a value counts if it beats the best by ``gain``."""
    seq = F.sort_array(F.collect_list(F.struct(F.col(epoch).cast("int").alias("e"), F.col(value).cast("double").alias("v"))))
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(-1).alias("at"), F.lit(0).alias("bad"), F.lit(None).cast("int").alias("stop"))

    def step(a, m):
        better = m["v"] > a["best"] + gain
        bad = F.when(better, F.lit(0)).otherwise(a["bad"] + 1)
        new = F.struct(F.when(better, m["v"]).otherwise(a["best"]).alias("best"), F.when(better, m["e"]).otherwise(a["at"]).alias("at"), bad.alias("bad"), F.when(bad >= patience, m["e"]).alias("stop"))
        return F.when(a["stop"].isNotNull(), a).otherwise(new)

    folded = metrics.groupBy(run).agg(F.aggregate(seq, start, step).alias("s"))
    return folded.select(run, F.col("s.best").alias("best"), F.col("s.at").alias("best_epoch"), F.col("s.stop").alias("stop_epoch"))


def pick_by_priority(files: DataFrame, key: str, extensions: list[str], ext: str = "ext") -> DataFrame:
    """For each key the file whose extension comes first in the list; files of other extensions are left out."""
    rank = F.array_position(F.array(*[F.lit(e) for e in extensions]), F.lower(F.col(ext)))
    best = files.withColumn("_r", rank).where("_r > 0").withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_r", ext)))
    return best.where("_n = 1").drop("_r", "_n")


def selected_pages(df: DataFrame, choice: str, page: str = "Image") -> DataFrame:
    """Rows of the pages in a comma list; ``all`` keeps every row."""
    if choice.strip() == "all":
        return df
    names = [p.strip() for p in choice.split(",") if p.strip()]
    return df.where(F.col(page).cast("string").isin(names))


def with_text(df: DataFrame, texts: DataFrame, page: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose page has a text, and the pages that have none."""
    return df.join(texts.select(page).distinct(), page, "left_semi"), df.select(page).distinct().join(texts.select(page).distinct(), page, "left_anti")


def random_partners(left: DataFrame, right: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Each row of ``left`` with some row of ``right``, decided by a hash of its key: numbers on one side, an equi-join."""
    n = right.count()
    numbered = dense_ids(right, [key], "_number").select("_number", *[F.col(c).alias(f"partner_{c}") for c in right.columns])
    return left.withColumn("_number", F.pmod(drawn(F.lit(seed), F.col(key)), F.lit(max(n, 1)))).join(numbered, "_number").drop("_number")


def key_difference(have: DataFrame, want: DataFrame, key: str, shape: str) -> DataFrame:
    """key and status of entries that are missing, unexpected or of another shape."""
    h, w = have.select(key, F.col(shape).alias("_h")), want.select(key, F.col(shape).alias("_w"))
    both = h.join(w, key, "full_outer")
    status = F.when(F.col("_h").isNull(), "missing").when(F.col("_w").isNull(), "unexpected").when(F.col("_h") != F.col("_w"), "shape")
    return both.select(key, status.alias("status")).where("status IS NOT NULL")


def metric_means(rows: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    return rows.groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def prepare_inference(masks: DataFrame, pages: DataFrame, done: DataFrame, suffix: str) -> tuple[DataFrame, DataFrame]:
    """Mask files (name, path) paired with page images (stem, path) by the mask's name without its suffix, but for pages
    that are done; and the masks whose page image is missing."""
    keyed = masks.where(F.col("name").endswith(suffix)).select(F.expr(f"substring(name, 1, length(name) - {len(suffix)})").alias("page"), F.col("path").alias("mask_path"))
    images = pages.select(F.col("stem").alias("page"), F.col("path").alias("image_path"))
    ready = keyed.join(images, "page").join(done.select("page").distinct(), "page", "left_anti")
    return ready, keyed.join(images, "page", "left_anti")


def long_enough(examples: DataFrame, ids: str = "ids", least: int = 3) -> DataFrame:
    """Examples of at least so many tokens, marks included; a null list has none."""
    return examples.where(F.size(ids) >= least)


#: What marks a file as made from another.
DERIVED_MARKS, DERIVED_ENDINGS = ["02_text_black"], ["_fin.png"]


def without_derived(files: DataFrame, name: str = "name", marks: list[str] = DERIVED_MARKS, endings: list[str] = DERIVED_ENDINGS) -> DataFrame:
    keep = F.lit(True)
    for m in marks:
        keep = keep & ~F.contains(F.col(name), F.lit(m))
    for e in endings:
        keep = keep & ~F.col(name).endswith(e)
    return files.where(keep)


def parameter_names(names: DataFrame, name: str = "name") -> DataFrame:
    """Names of a model's parameters without the prefixes of wrappers (the outer one first, each once), and without the
    counters of a profiler."""
    kept = names.where(~F.contains(F.col(name), F.lit("total_ops")) & ~F.contains(F.col(name), F.lit("total_params")))
    return kept.withColumn(name, F.regexp_replace(F.regexp_replace(name, r"^module\.", ""), r"^_orig_mod\.", ""))


def boxes_of_books(books: DataFrame, pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """book_id, page, boxes for all pages of listed books; a page without boxes has an empty list."""
    grouped = boxes.groupBy("book_id", "page").agg(F.sort_array(F.collect_list(F.struct("idx", "x1", "y1", "x2", "y2"))).alias("boxes"))
    none = F.filter(F.array(F.struct(*[F.lit(0).alias(c) for c in ("idx", "x1", "y1", "x2", "y2")])), lambda _: F.lit(False))
    return pages.join(books.select("book_id").distinct(), "book_id", "left_semi").join(grouped, ["book_id", "page"], "left").withColumn("boxes", F.coalesce("boxes", none))


def compared_files(restored: DataFrame, reference: DataFrame, masks: DataFrame | None = None, name: str = "name") -> DataFrame:
    """Every restored file with the path of the reference of its name and, if asked, of its mask; null where there is none."""
    out = restored.join(reference.select(name, F.col("path").alias("reference_path")), name, "left")
    return out if masks is None else out.join(masks.select(name, F.col("path").alias("mask_path")), name, "left")


def training_pairs(low: DataFrame, good: DataFrame, stem: str = "stem") -> DataFrame:
    """Files of two listings that share a stem: stem, lq_path, gt_path."""
    return low.select(stem, F.col("path").alias("lq_path")).join(good.select(stem, F.col("path").alias("gt_path")), stem)


def in_page_order(names: DataFrame, name: str = "name", rank: str = "rank") -> DataFrame:
    """Names ``<book>_<sequence>_<side>`` ranked by sequence and side from 0; names of another form come last."""
    from ..functions.text import page_numbers

    far = F.lit(2**62)
    seq, side = (F.coalesce(c, far) for c in page_numbers(F.col(name)))
    return dense_ids(names.withColumns({"_seq": seq, "_side": side}), ["_seq", "_side", name], rank).drop("_seq", "_side")


def output_tree(images: DataFrame, root: str, base: str, path: str = "path") -> DataFrame:
    """Adds the folder of each image's results below ``root``: the last part of ``base``, what lies between it and the image,
    and the image's stem; and in it the folders of its patches and crops and the name of the whole result."""
    from ..functions.text import base_name, stem

    base = base.rstrip("/")
    between = F.regexp_replace(F.expr(f"substring({path}, {len(base) + 2})"), "[^/]*$", "")
    folder = F.concat(F.lit(f"{root.rstrip('/')}/{base.rsplit('/', 1)[-1]}/"), between, stem(F.col(path)))
    return images.withColumns({"folder": folder, "patches": F.concat(folder, F.lit("/patches")), "crops": F.concat(folder, F.lit("/crops")), "result": F.concat(folder, F.lit("/"), base_name(F.col(path)))})


def sweep(folders: DataFrame, prefix: str, root: str, settings: list[dict[str, str]] | None = None, name: str = "folder") -> DataFrame:
    """A run for each folder whose name begins with ``prefix`` and each of a few settings, with its output folder."""
    chosen = folders.where(F.col(name).startswith(prefix)).withColumn("output", F.concat(F.lit(f"{root.rstrip('/')}/RESULT_"), name))
    if not settings:
        return chosen
    return chosen.withColumn("settings", F.explode(F.array(*[F.create_map(*[F.lit(x) for kv in sorted(s.items()) for x in kv]) for s in settings])))
