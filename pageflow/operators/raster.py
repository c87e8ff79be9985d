"""Rasters as pixel rows (image, y, x, r, g, b or v): thresholds, blends, composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import feather, text_boost
from .datasets import drawn


def value_counts(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """keys, value, n: at most 256 rows a key from here on."""
    return pixels.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def otsu(pixels: DataFrame, key: str = "image", value: str = "v") -> DataFrame:
    """key, threshold: the lowest value that maximises the variance between what is at most it and what is above."""
    hist = value_counts(pixels, [key], value)
    low = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(key)
    sums = hist.withColumns({"w0": F.sum("n").over(low), "s0": F.sum(F.col("n") * F.col(value)).over(low), "w": F.sum("n").over(everything), "s": F.sum(F.col("n") * F.col(value)).over(everything)})
    w1 = F.col("w") - F.col("w0")
    m0, m1 = F.col("s0") / F.col("w0"), F.try_divide(F.col("s") - F.col("s0"), w1)
    # Rounded so that equal splits tie whatever the order of the arithmetic.
    scored = sums.withColumn("var", F.round(F.coalesce(F.col("w0") * w1 * F.pow(m0 - m1, F.lit(2.0)), F.lit(0.0)), 3))
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("var")).alias("neg"), F.col(value).alias("t"))).alias("b"))
    return best.select(key, F.col("b.t").alias("threshold"))


def binary_mask(pixels: DataFrame, thresholds: DataFrame, key: str = "image", text_is: int = 0) -> DataFrame:
    """Adds m: text is what is at most the threshold; it gets ``text_is`` (0 or 255), the rest the other."""
    return pixels.join(thresholds, key).withColumn("m", F.when(F.col("v") <= F.col("threshold"), text_is).otherwise(255 - text_is)).drop("threshold")


def dilate(mask: DataFrame, radius: int = 1, text_is: int = 0) -> DataFrame:
    """Text grows by a square: each text pixel marks its neighbours; marks combine before they move far."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    text = mask.where(F.col("m") == text_is).select("image", "y", "x").withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))
    grown = text.select("image", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).distinct().withColumn("_t", F.lit(True))
    return mask.join(grown, ["image", "y", "x"], "left").withColumn("m", F.when(F.col("_t"), text_is).otherwise(F.col("m"))).drop("_t")


def channel_mode(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """The most frequent value, the lowest on ties."""
    best = value_counts(pixels, keys, value).groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("neg"), value)).alias("b"))
    return best.select(*keys, F.col(f"b.{value}").alias("mode"))


def background_median(pixels: DataFrame, thresholds: DataFrame, key: str = "image") -> DataFrame:
    """Median colour (truncated) of pixels whose luma is above the image's threshold; white where there are none."""
    medians = pixels.join(thresholds, key).groupBy(key).agg(*[F.median(F.when(F.col("v") > F.col("threshold"), F.col(c))).alias(c) for c in ("r", "g", "b")])
    return medians.select(key, *[F.coalesce(F.col(c).cast("int"), F.lit(255)).alias(c) for c in ("r", "g", "b")])


def feather_blend(patches: DataFrame, size: int, overlap: int, mask: Column | None = None) -> DataFrame:
    """Patches of pixels (image, x0, y0, px, py, v) to one image: sum of weighted values over sum of weights, truncated.
    Weights are gaussian, highest in a patch's centre, raised on text by ``mask``."""
    weight = F.greatest(feather(F.col("px"), size, overlap) * feather(F.col("py"), size, overlap), F.lit(1e-6))
    weight = weight if mask is None else text_boost(weight, mask)
    placed = patches.select("image", (F.col("y0") + F.col("py")).alias("y"), (F.col("x0") + F.col("px")).alias("x"), weight.alias("w"), "v")
    sums = placed.groupBy("image", "y", "x").agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("w").alias("w"))
    # A hair above, so that whole values don't fall below themselves by rounding.
    return sums.select("image", "y", "x", F.floor(F.col("s") / F.greatest(F.col("w"), F.lit(1e-6)) + 1e-9).cast("int").alias("v"))


def overlap_average(patches: DataFrame) -> DataFrame:
    placed = patches.select("image", (F.col("y0") + F.col("py")).alias("y"), (F.col("x0") + F.col("px")).alias("x"), "v")
    return placed.groupBy("image", "y", "x").agg(F.avg("v").alias("v"))


def composite(base: DataFrame, original: DataFrame, mask: DataFrame, above: int = 127) -> DataFrame:
    """The original's value where the mask is above a threshold, else the base's. Pixels without mask are base."""
    keys = ["image", "y", "x"]
    both = base.join(original.withColumnRenamed("v", "_o"), keys).join(mask.select(*keys, "m"), keys, "left")
    return both.select(*keys, F.when(F.col("m") > above, F.col("_o")).otherwise(F.col("v")).alias("v"))


def total_variation(pixels: DataFrame, key: str = "image") -> DataFrame:
    """Sums of absolute differences to the right and lower neighbour, by one neighbour join each way."""
    own = pixels.select(key, "y", "x", "v")
    right = F.lead("v").over(Window.partitionBy(key, "y").orderBy("x"))
    below = F.lead("v").over(Window.partitionBy(key, "x").orderBy("y"))
    return own.withColumns({"_r": F.abs(right - F.col("v")), "_b": F.abs(below - F.col("v"))}).groupBy(key).agg(F.coalesce(F.sum("_r"), F.lit(0)).alias("horizontal"), F.coalesce(F.sum("_b"), F.lit(0)).alias("vertical"))


def mask_union(a: Column, b: Column, above: int = 128) -> Column:
    """1 where either of two masks of 0 to 255 is above the threshold, else 0; a missing one counts as empty."""
    return F.when((F.coalesce(a, F.lit(0)) > above) | (F.coalesce(b, F.lit(0)) > above), 1).otherwise(0)


def binarise(v: Column, threshold: int = 125) -> Column:
    return F.when(v > threshold, 255).otherwise(0)


def resize_taps(size: int, out: int, antialias: bool = True) -> list[tuple[int, int, float]]:
    """(output place, input place, weight) of a bicubic resize along one axis; edges mirror. As many taps as the output
    has places times the kernel's width."""
    import math

    def cubic(x: float) -> float:
        d = abs(x)
        return 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d <= 2 else 0.0

    scale = out / size
    shrink = min(scale, 1.0) if antialias else 1.0
    width = 4 / shrink
    taps: dict[tuple[int, int], float] = {}
    for i in range(out):
        centre = (i + 1) / scale + 0.5 * (1 - 1 / scale)
        left = math.floor(centre - width / 2)
        raw = [(j, shrink * cubic(shrink * (centre - j))) for j in range(left, left + math.ceil(width) + 2)]
        total = sum(w for _, w in raw)
        for j, w in raw:
            if w:
                k = (j - 1) % (2 * size)
                k = k if k < size else 2 * size - 1 - k
                taps[i, k] = taps.get((i, k), 0.0) + w / total
    return [(i, k, w) for (i, k), w in sorted(taps.items())]


def resize(pixels: DataFrame, height: int, width: int, out_height: int, out_width: int) -> DataFrame:
    """Bicubic resize of images of one size, one axis after the other; weights are small broadcast tables and sums are
    combined before they move."""
    spark = pixels.sparkSession

    def along(df: DataFrame, axis: str, size: int, out: int) -> DataFrame:
        taps = spark.createDataFrame(resize_taps(size, out), f"_o int, {axis} int, _w double")
        keys = ["image", *({"y", "x"} - {axis})]
        return df.join(F.broadcast(taps), axis).groupBy(*keys, F.col("_o").alias("_a")).agg(F.sum(F.col("v") * F.col("_w")).alias("v")).withColumnRenamed("_a", axis)

    return along(along(pixels.select("image", "y", "x", F.col("v").cast("double").alias("v")), "y", height, out_height), "x", width, out_width).select("image", "y", "x", "v")


def letterboxed(pixels: DataFrame, height: int, width: int, target: int, fill: float = 255.0) -> DataFrame:
    """Images of one size scaled into a square and centred on a plain ground."""
    scale = min(target / width, target / height)
    w, h = max(1, round(width * scale)), max(1, round(height * scale))
    left, top = (target - w) // 2, (target - h) // 2
    inner = resize(pixels, height, width, h, w).select("image", (F.col("y") + top).alias("y"), (F.col("x") + left).alias("x"), "v")
    line = F.explode(F.sequence(F.lit(0), F.lit(target - 1)))
    ground = pixels.select("image").distinct().withColumn("y", line).withColumn("x", line)
    return ground.join(inner, ["image", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(fill)))


def padded(pixels: DataFrame, colours: DataFrame, height: int, width: int, multiple: int = 128) -> DataFrame:
    """Images (r, g, b) of one size padded at the right and bottom to a multiple with their own background colour."""
    h, w = -(-height // multiple) * multiple, -(-width // multiple) * multiple
    places = colours.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    own = pixels.select("image", "y", "x", *[F.col(c).alias(f"_{c}") for c in "rgb"])
    return places.join(own, ["image", "y", "x"], "left").select("image", "y", "x", *[F.coalesce(f"_{c}", c).alias(c) for c in "rgb"])


def ghost(pixels: DataFrame, shift: int = 5, strength: float = 0.3, above: int = 128) -> DataFrame:
    """A faint copy of dark pixels, moved to the right: what shows through from the other side of a page."""
    dark = pixels.where(F.col("v") <= above).select("image", "y", (F.col("x") + shift).alias("x"), F.col("v").alias("_g"))
    return pixels.join(dark, ["image", "y", "x"], "left").withColumn("v", F.floor(F.coalesce((1 - strength) * F.col("v") + strength * F.col("_g"), F.col("v"))).cast("int")).drop("_g")


def blend(pixels: DataFrame, mask: DataFrame, colour: int, opacity: float) -> DataFrame:
    """A stain of one colour under a mask of 0 to 255, as opaque as asked for."""
    a = F.coalesce(F.col("m"), F.lit(0)) / 255.0 * opacity
    return pixels.join(mask.select("image", "y", "x", "m"), ["image", "y", "x"], "left").withColumn("v", F.floor((1 - a) * F.col("v") + a * colour + 1e-9).cast("int")).drop("m")


def blob_masks(images: DataFrame, height: int, width: int, blobs: int = 3, seed: int = 0) -> DataFrame:
    """image, y, x, m: discs at places that a hash of the image's key decides, so that a rerun gives the same."""
    draw = lambda k, c: F.pmod(drawn(F.lit(seed), F.col("image"), F.col("k"), F.lit(c)), F.lit(1_000_003)) / 1_000_003.0
    discs = images.select("image").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(blobs)))).select("image", (draw("k", 1) * height).alias("cy"), (draw("k", 2) * width).alias("cx"), (1 + draw("k", 3) * min(height, width) / 4).alias("r"))
    span = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col(c) - F.col("r")).cast("int")), F.least(F.lit(n - 1), F.ceil(F.col(c) + F.col("r")).cast("int"))))
    near = discs.withColumn("y", span("cy", height)).withColumn("x", span("cx", width))
    inside = F.pow(F.col("y") - F.col("cy"), F.lit(2.0)) + F.pow(F.col("x") - F.col("cx"), F.lit(2.0)) <= F.pow("r", F.lit(2.0))
    return near.where(inside).select("image", "y", "x", F.lit(255).alias("m")).distinct()


def inpainted(pixels: DataFrame, restored: DataFrame, mask: DataFrame) -> DataFrame:
    """The inpainting operator: known pixels stay, those under the mask come from the restoration."""
    return composite(pixels, restored, mask, above=0)


def packed_images(pixels: DataFrame, key: str = "image") -> DataFrame:
    """key, height, width and data (rows of blue, green, red bytes, clipped to 0..255): one group in Python for each image."""

    def run(k, pdf):
        import numpy as np
        import pandas as pd

        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        out = np.zeros((h, w, 3), np.uint8)
        for c, name in enumerate("bgr"):
            out[pdf["y"].to_numpy(), pdf["x"].to_numpy(), c] = np.clip(pdf[name].to_numpy(), 0, 255)
        return pd.DataFrame({key: [k[0]], "height": [h], "width": [w], "data": [out.tobytes()]})

    return pixels.select(key, "y", "x", "r", "g", "b").groupBy(key).applyInPandas(run, f"{key} {dict(pixels.dtypes)[key]}, height int, width int, data binary")
