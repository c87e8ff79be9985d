"""Writers. Rows are written by the executors; single small files (reports of a few rows) are made of one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM = "﻿"
#: Reports go to one file; more rows than this are an error.
MAX_REPORT_ROWS = 100_000


def _one_text(df: DataFrame, path: str, mode: str) -> None:
    df.coalesce(1).write.mode(mode).text(path)


def json_array(df: DataFrame, path: str, order: list[str], mode: str = "errorifexists") -> None:
    """One UTF-8 file with a JSON array of all rows, which have to be few."""
    if df.count() > MAX_REPORT_ROWS:
        raise ValueError("too many rows for one JSON array; write JSON lines")
    item = F.struct(*order, F.to_json(F.struct(*df.columns)).alias("_j"))
    rows = df.agg(F.sort_array(F.collect_list(item)).alias("a"))
    _one_text(rows.select(F.concat(F.lit("["), F.array_join(F.transform("a", lambda s: s["_j"]), ","), F.lit("]")).alias("value")), path, mode)


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def metadata(crops: DataFrame, path: str, page: str, mode: str = "errorifexists") -> None:
    """Crop rows with the page that they come from."""
    json_array(crops.withColumn("source_page", F.lit(page)), path, ["char_id"], mode)


def csv_report(df: DataFrame, path: str, order: list, bom: bool = True, mode: str = "errorifexists") -> None:
    """One CSV file with a header, by default behind a byte-order mark, in the given order."""
    if df.count() > MAX_REPORT_ROWS:
        raise ValueError("too many rows for one report")
    cell = lambda c: F.coalesce(F.when(F.col(c).cast("string").rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c).cast("string")), F.lit(""))
    lines = df.orderBy(*order).select(F.concat_ws(",", *[cell(c) for c in df.columns]).alias("value"))
    numbered = lines.coalesce(1).withColumn("_o", F.monotonically_increasing_id())
    header = df.sparkSession.createDataFrame([((BOM if bom else "") + ",".join(df.columns), -1)], "value string, _o long")
    _one_text(header.unionByName(numbered).coalesce(1).sortWithinPartitions("_o").select("value"), path, mode)


def image_store(images: DataFrame, path: str, level: int = 1, mode: str = "errorifexists") -> None:
    """Key-value image store: key, the encoded image, its size, and a line ``key.png (h,w,c) level``."""
    line = F.format_string("%s.png (%d,%d,%d) %d", "key", "h", "w", "c", F.lit(level))
    images.withColumns({"level": F.lit(level), "meta": line}).write.mode(mode).parquet(path)


def corpus(lines: DataFrame, path: str, preview: int = 20, order: str = "page", mode: str = "errorifexists") -> None:
    """``path``/text with a line a row, ``path``/preview with the first ones, ``path``/meta with the lengths."""
    from ..operators.lm import corpus_meta

    lines.select("text").write.mode(mode).text(f"{path}/text")
    _one_text(lines.orderBy(order).limit(preview).select("text"), f"{path}/preview", mode)
    corpus_meta(lines).coalesce(1).write.mode(mode).json(f"{path}/meta")


def materialise_split(members: DataFrame, path: str, overwrite: bool = False, sources: DataFrame | None = None, key: str = "path") -> None:
    """Rows by split; what exists is kept unless told otherwise. With the ``sources`` that there are (by ``key``), a member
    without one is an error, and nothing is written."""
    if sources is not None:
        lost = [r[0] for r in members.join(sources.select(key), key, "left_anti").select(key).limit(5).collect()]
        if lost:
            raise FileNotFoundError(f"no source for {lost}")
    members.write.mode("overwrite" if overwrite else "ignore").partitionBy("split").parquet(path)


def markdown_report(summary: DataFrame, bins: DataFrame, folders: DataFrame, top: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tables of a confidence report. All inputs have a few dozen rows at most."""
    s = summary.select(F.array(
        F.lit("# Recognition report"), F.lit(""), F.lit("| measure | value |"), F.lit("|---|---|"),
        F.concat(F.lit("| predictions | "), F.format_number("total", 0), F.lit(" |")), F.concat(F.lit("| characters | "), F.format_number("distinct_chars", 0), F.lit(" |")),
        F.format_string("| mean confidence | %.4f |", "mean_conf"), F.format_string("| median confidence | %.4f |", "median_conf"), F.format_string("| deviation | %.4f |", "std_conf"),
    ).alias("a"))

    def section(df: DataFrame, head: list[str], line, *order) -> DataFrame:
        rows = df.agg(F.sort_array(F.collect_list(F.struct(*order, line.alias("_l")))).alias("r"))
        return rows.select(F.concat(F.array(*[F.lit(h) for h in ["", *head]]), F.transform("r", lambda x: x["_l"])).alias("a"))

    parts = [
        s,
        section(bins, ["| bin | n | share |", "|---|---|---|"], F.format_string("| %s | %d | %.2f%% |", "bin", "n", "percent"), F.reverse("bin").alias("_k"), "bin"),
        section(top, ["| rank | char | n | share |", "|---|---|---|---|"], F.format_string("| %d | %s | %d | %.2f%% |", "rank", "char", "n", "percent"), "rank"),
        section(folders, ["| folder | n | mean |", "|---|---|---|"], F.format_string("| %s | %d | %.4f |", F.col("folder").cast("string"), "n", "mean_conf"), (-F.col("n")).alias("_k"), "folder"),
    ]
    out = parts[0].withColumnRenamed("a", "a0")
    for k, p in enumerate(parts[1:], 1):
        out = out.crossJoin(F.broadcast(p.withColumnRenamed("a", f"a{k}")))  # one row each
    _one_text(out.select(F.array_join(F.concat(*[f"a{k}" for k in range(len(parts))]), "\n").alias("value")), path, mode)


def coco_document(images: DataFrame, annotations: DataFrame, path: str, categories: list[tuple[int, str]] = [(1, "char")], mode: str = "errorifexists") -> None:
    """One COCO file of bounded size; larger sets go to JSON lines, one folder for each relation."""
    if images.count() > MAX_REPORT_ROWS or annotations.count() > 10 * MAX_REPORT_ROWS:
        json_lines(images, f"{path}/images", mode)
        json_lines(annotations, f"{path}/annotations", mode)
        return
    listed = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct("id", *[c for c in df.columns if c != "id"]))).alias(name))
    cats = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in categories]).alias("categories")
    both = listed(images, "images").crossJoin(listed(annotations, "annotations"))  # one row each
    _one_text(both.select(F.to_json(F.struct(cats, "images", "annotations")).alias("value")), path, mode)
