"""Statistics of recognition results: one row for each predicted character (folder, pos, char, prob, top5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import safe_ratio

# Lower bounds and names of the confidence bins.
BINS = [(0.9, "0.9-1.0"), (0.8, "0.8-0.9"), (0.7, "0.7-0.8"), (0.6, "0.6-0.7"), (0.5, "0.5-0.6"), (None, "0.0-0.5")]


def with_defaults(predictions: DataFrame) -> DataFrame:
    """Missing char, probability and candidates as ``?``, 0 and none."""
    out = predictions.withColumn("char", F.coalesce("char", F.lit("?"))).withColumn("prob", F.coalesce("prob", F.lit(0.0)))
    return out.withColumn("top5", F.coalesce("top5", F.array().cast(dict(predictions.dtypes)["top5"]))) if "top5" in predictions.columns else out


def summary(predictions: DataFrame) -> DataFrame:
    """One row: number, distinct characters, and largest, smallest, mean, median and sample deviation of the confidence;
    zeros where there is nothing, deviation 0 for a single one."""
    zero = F.lit(0.0)
    return predictions.agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct("char").alias("distinct_chars"),
        F.coalesce(F.max("prob"), zero).alias("max_conf"),
        F.coalesce(F.min("prob"), zero).alias("min_conf"),
        F.coalesce(F.avg("prob"), zero).alias("mean_conf"),
        F.coalesce(F.median("prob"), zero).alias("median_conf"),
        F.coalesce(F.stddev_samp("prob"), zero).alias("std_conf"),
    )


def histogram(predictions: DataFrame) -> DataFrame:
    """All six bins with their counts and shares in percent, empty ones too."""
    spark = predictions.sparkSession
    name = F.lit(BINS[-1][1])
    for low, label in reversed(BINS[:-1]):
        name = F.when(F.col("prob") >= low, label).otherwise(name)
    counts = predictions.groupBy(name.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = spark.createDataFrame([(b,) for _, b in BINS], "bin string")
    filled = bins.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = filled.agg(F.sum("n").alias("_total"))
    return filled.crossJoin(F.broadcast(total)).select("bin", "n", safe_ratio(100.0 * F.col("n"), F.col("_total")).alias("percent"))


def by_folder(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_conf"), F.min("prob").alias("min_conf"), F.max("prob").alias("max_conf"))


def largest_folders(predictions: DataFrame, n: int = 20) -> DataFrame:
    return by_folder(predictions).orderBy(F.desc("n"), "folder").limit(n)


def weakest_folders(predictions: DataFrame, n: int = 10) -> DataFrame:
    return by_folder(predictions).orderBy("min_conf", "folder").limit(n)


def by_char(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("char").agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_conf"), F.min("prob").alias("min_conf"), F.max("prob").alias("max_conf"))


def low_confidence(predictions: DataFrame, below: float = 0.5) -> DataFrame:
    return predictions.where(F.col("prob") < below)


def low_confidence_share(predictions: DataFrame, below: float = 0.5) -> DataFrame:
    low = F.count_if(F.col("prob") < below)
    return predictions.agg(low.alias("low"), F.count(F.lit(1)).alias("total"), F.coalesce(F.try_divide(100.0 * low, F.count(F.lit(1))), F.lit(0.0)).alias("percent"))


def most_common(chars: DataFrame, n: int = 30, order: list[str] | None = None) -> DataFrame:
    """The n most frequent chars, first seen first on ties: char, n, share in percent, rank. ``order`` names the columns
    that say what was seen first."""
    names = order or ["ordinal"]
    # One number is aggregated by hashing, a struct by sorting all rows.
    seen = (F.min(names[0]) if len(names) == 1 else F.min(F.struct(*names))).alias("_seen")
    counts = chars.groupBy("char").agg(F.count(F.lit(1)).alias("n"), seen)
    top = counts.orderBy(F.desc("n"), "_seen").limit(n)
    total = chars.agg(F.count(F.lit(1)).alias("_total"))
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "_seen")))  # at most n rows
    return ranked.crossJoin(F.broadcast(total)).select("char", "n", (100.0 * F.col("n") / F.col("_total")).alias("percent"), "rank")


def folder_status(folders: DataFrame, results: DataFrame) -> DataFrame:
    """Listed folders with ``ok`` where a result was read, an empty one too, else ``failed``."""
    have = results.select("folder").distinct().withColumn("_have", F.lit(True))
    return folders.join(have, "folder", "left").select("folder", F.when(F.col("_have"), "ok").otherwise("failed").alias("status"))


def report(predictions: DataFrame, low: int = 30) -> DataFrame:
    """One row with a JSON document: summary, bins, folders, characters and the first low-confidence predictions."""
    flat = lambda df, name: df.agg(F.collect_list(F.struct(*df.columns)).alias(name))  # noqa: E731  a few dozen rows
    parts = [
        summary(predictions).select(F.struct("*").alias("summary")),
        flat(histogram(predictions), "bins"),
        flat(largest_folders(predictions), "largest_folders"),
        flat(weakest_folders(predictions), "weakest_folders"),
        flat(most_common(predictions, 30, ["folder", "pos"]), "most_common"),
        flat(low_confidence(predictions).orderBy("folder", "pos").limit(low).select("folder", "pos", "char", "prob"), "low_confidence"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out.select(F.to_json(F.struct("*")).alias("report"))
