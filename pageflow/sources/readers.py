"""Readers. Every one has an explicit schema; nothing is inferred, nothing is gathered on the driver."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T

# Image endings in the order in which they are preferred.
IMAGE_EXTENSIONS = [".jpg", ".png", ".jpeg", ".tif", ".tiff", ".webp", ".bmp"]
MASK_EXTENSIONS = [".jpg", ".png", ".jpeg"]


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Character boxes by column name. ValueError if a required column is missing from the header."""
    names = [c.split()[0] for c in schemas.COORDINATES.split(", ")]
    raw = spark.read.option("header", True).csv(path)  # the header only names columns; all of them are strings
    schemas.require_columns(raw, names)
    return raw.select("Unicode", "Image", *[F.col(c).cast("double").alias(c) for c in names[2:]])


def coordinates_by_image(spark: SparkSession, path: str) -> DataFrame:
    """image and the list of its boxes, in file order."""
    rows = coordinates(spark, path).withColumn("_o", F.monotonically_increasing_id())
    box = F.struct("_o", F.col("X").alias("x"), F.col("Y").alias("y"), F.col("Width").alias("w"), F.col("Height").alias("h"))
    grouped = rows.groupBy(F.trim("Image").alias("image")).agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    return grouped.select("image", F.transform("boxes", lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h"))).alias("boxes"))


def coordinates_by_position(spark: SparkSession, path: str) -> DataFrame:
    """Boxes by place (columns 0, 1, 2, 3, 6, 7); rows that don't parse, the header too, and boxes without extent go."""
    raw = spark.read.schema(schemas.COORDINATES_BY_POSITION).option("header", False).csv(path)
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    rows = raw.select(F.col("_0").alias("Unicode"), F.col("_1").alias("Image"), number("_2").alias("X"), number("_3").alias("Y"), number("_6").alias("Width"), number("_7").alias("Height"))
    return rows.where("X IS NOT NULL AND Y IS NOT NULL AND Width > 0 AND Height > 0")


def _listed(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def page_texts(spark: SparkSession, path: str, invalid: str = "ignore") -> DataFrame:
    """book_id, page, text, size of ``<book>/<page>.txt`` files; invalid UTF-8 is dropped or replaced."""
    files = _listed(spark, path, "*.txt")
    name = F.col("path")
    return files.select(F.element_at(F.split(name, "/"), -2).alias("book_id"), T.stem(name).alias("page"), T.decoded(F.col("content"), invalid).alias("text"), F.col("length").alias("size"))


def page_characters(spark: SparkSession, path: str) -> DataFrame:
    """book_id, page, pos, gt: the characters of page texts without white space."""
    return page_texts(spark, path).select("book_id", "page", F.posexplode(T.characters(T.strip_white_space(F.col("text")))).alias("pos", "gt"))


def recognitions(spark: SparkSession, path: str, name: str = "arc_result.json") -> DataFrame:
    """folder, pos, corners, char, prob, top5 of one result file in each folder; missing values become ``?``, 0, none.
    Folders whose list is empty have no row here; see :func:`folders_with`."""
    files = _listed(spark, path, name)
    parsed = files.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.from_json(T.decoded(F.col("content")), schemas.RECOGNITION_JSON).alias("r"))
    flat = parsed.select("folder", F.posexplode("r").alias("pos", "p")).select("folder", "pos", "p.*")
    top = F.transform(F.coalesce("top5", F.array().cast("array<array<string>>")), lambda t: F.struct(F.get(t, F.lit(0)).alias("char"), F.get(t, F.lit(1)).cast("double").alias("prob")))
    return flat.withColumns({"char": F.coalesce("char", F.lit("?")), "prob": F.coalesce("prob", F.lit(0.0)), "top5": top})


def folders_with(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Folders that hold a file of this name."""
    return _listed(spark, path, name).select(F.element_at(F.split("path", "/"), -2).alias("folder")).distinct()


def boxes_json(spark: SparkSession, path: str, name: str = "bboxes.json") -> DataFrame:
    """folder, pos, x1, y1, x2, y2, score of lists of objects or lists of lists."""
    raw = _listed(spark, path, name).select(F.element_at(F.split("path", "/"), -2).alias("folder"), T.decoded(F.col("content")).alias("t"))
    listed = F.from_json("t", schemas.BOXES_JSON_LISTS)
    at = lambda b, k: F.get(b, F.lit(k))
    from_lists = F.transform(listed, lambda b: F.struct(*[at(b, k).cast("int").alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))], at(b, 4).alias("score")))
    boxes = F.when(F.col("t").rlike(r"^\s*\[\s*\["), from_lists).otherwise(F.from_json("t", schemas.BOXES_JSON))
    return raw.select("folder", F.posexplode(boxes).alias("pos", "b")).select("folder", "pos", "b.*")


def class_list(spark: SparkSession, path: str) -> DataFrame:
    """class_id, unicode, char of a file with a class on each line; blank lines don't count. ValueError if there is none."""
    lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    out = spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("class_id", "unicode"))
    if out.isEmpty():
        raise ValueError(f"no classes in {path}")
    return out.withColumn("char", T.code_point_char(F.col("unicode")))


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """class_id, unicode, char of a JSON object with numbers as keys."""
    parsed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "unicode"))
    return parsed.select(F.col("k").cast("int").alias("class_id"), "unicode", T.code_point_char(F.col("unicode")).alias("char"))


def book_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("book_id")).where("book_id <> ''")


def images(spark: SparkSession, path: str, drop_invalid: bool = True) -> DataFrame:
    """path, height, width, nChannels and data (rows of blue, green, red bytes)."""
    raw = spark.read.format("image").option("dropInvalid", drop_invalid).option("recursiveFileLookup", True).load(path)
    return raw.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")


def image_pixels(loaded: DataFrame) -> DataFrame:
    """path, y, x, r, g, b of images with three channels; bytes become rows on the executors."""

    def run(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            for r in pdf.itertuples(index=False):
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1)
                y, x = np.mgrid[0 : r.height, 0 : r.width]
                c = [a[..., min(k, a.shape[2] - 1)].ravel().astype("int32") for k in (2, 1, 0)]
                yield pd.DataFrame({"path": r.path, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "r": c[0], "g": c[1], "b": c[2]})

    return loaded.select("path", "height", "width", "data").mapInPandas(run, "path string, y int, x int, r int, g int, b int")


def scan(spark: SparkSession, path: str, suffixes: list[str] | None = None, keyword: str | None = None, hidden: bool = False) -> DataFrame:
    """path, name, stem, ext, size of all files below: of the given endings, without hidden ones, each once. With a
    keyword, only names that have it after their first character."""
    files = _listed(spark, path).select("path", F.col("length").alias("size")).distinct()
    named = files.withColumns({"name": T.base_name(F.col("path")), "stem": T.stem(F.col("path")), "ext": T.extension(F.col("path"))})
    if not hidden:
        named = named.where(~F.col("name").startswith("."))
    if suffixes:
        keep = F.lit(False)
        for s in suffixes:
            keep = keep | F.col("name").endswith(s)
        named = named.where(keep)
    return named.where(F.instr("name", keyword) > 1) if keyword else named


def resolve(keys: DataFrame, files: DataFrame, key: str, extensions: list[str]) -> DataFrame:
    """Keys with the path of the file whose stem they are, the first ending in the list first; null where there is none."""
    rank = F.array_position(F.array(*[F.lit(e) for e in extensions]), F.col("ext"))
    order = Window.partitionBy("stem").orderBy("_r", "path")
    best = files.withColumn("_r", rank).where("_r > 0").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return keys.join(best.select(F.col("stem").alias(key), "path"), key, "left")


def store_get(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Entries of a key-value image store by key; the filter reaches the Parquet scan."""
    return spark.read.parquet(path).where(F.col("key").isin(keys))


def store_keys(files: DataFrame, suffix: str) -> DataFrame:
    """Names without the suffix, in order."""
    return files.where(F.col("name").endswith(suffix)).select(F.expr(f"substring(name, 1, length(name) - {len(suffix)})").alias("key"), "path").orderBy("key")


#: Fixed value: the number that begins a flow file.
FLOW_MAGIC = 202021.25


def flow_bytes(dx, dy) -> bytes:
    """A flow field in its file format: magic, width, height, then pairs of floats by rows."""
    import numpy as np

    h, w = dx.shape
    return struct.pack("<fii", FLOW_MAGIC, w, h) + np.stack((dx, dy), 2).astype("<f4").tobytes()


def flows(spark: SparkSession, path: str) -> DataFrame:
    """path, y, x, dx, dy of flow files; a wrong magic number is an error."""

    def run(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            for r in pdf.itertuples(index=False):
                magic, w, h = struct.unpack_from("<fii", r.content)
                if magic != FLOW_MAGIC:
                    raise ValueError(f"{r.path} is not a flow file")
                f = np.frombuffer(r.content, "<f4", 2 * w * h, 12).reshape(h, w, 2)
                y, x = np.mgrid[0:h, 0:w]
                yield pd.DataFrame({"path": r.path, "y": y.ravel(), "x": x.ravel(), "dx": f[..., 0].ravel(), "dy": f[..., 1].ravel()})

    return _listed(spark, path, "*.flo").select("path", "content").mapInPandas(run, "path string, y int, x int, dx float, dy float")


def options(text: str, base: str = ".") -> dict:
    """A nested option file: ``key: value`` lines, deeper lines below their key, ``- value`` items of a list. Values of
    keys that end in ``path`` or ``dir`` are resolved against ``base``. What is not of this form is an error."""
    import ast
    import os

    def plain(raw: str, key: str):
        known = {"true": True, "false": False, "null": None, "~": None}
        if raw.lower() in known:
            return known[raw.lower()]
        try:
            value = ast.literal_eval(raw)
        except (ValueError, SyntaxError):
            value = raw
        if isinstance(value, str) and key.endswith(("path", "dir")) and not os.path.isabs(value) and "://" not in value:
            value = os.path.normpath(os.path.join(base, value))
        return value

    lines = []
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if body.strip() and not body.lstrip().startswith("#"):
            lines.append((len(body) - len(body.lstrip()), body.strip()))

    def block(at: int, depth: int, key: str):
        """The value that begins at a line, and the first line after it."""
        if lines[at][1] == "-" or lines[at][1].startswith("- "):
            items: list = []
            while at < len(lines) and lines[at][0] == depth and (lines[at][1] == "-" or lines[at][1].startswith("- ")):
                raw = lines[at][1][1:].strip()
                if not raw:
                    if at + 1 == len(lines) or lines[at + 1][0] <= depth:
                        items.append(None)
                        at += 1
                    else:
                        value, at = block(at + 1, lines[at + 1][0], key)
                        items.append(value)
                elif _pair(raw):
                    # The item's first key stands on the line of its sign: read it two places further in.
                    lines[at] = (depth + 2, raw)
                    value, at = block(at, depth + 2, key)
                    items.append(value)
                else:
                    items.append(plain(raw, key))
                    at += 1
            return items, at
        out: dict = {}
        while at < len(lines) and lines[at][0] == depth:
            pair = _pair(lines[at][1])
            if pair is None:
                raise ValueError(f"not an option: {lines[at][1]}")
            name, raw = pair
            at += 1
            deeper = at < len(lines) and (lines[at][0] > depth or (lines[at][0] == depth and lines[at][1].startswith("- ")))
            if raw:
                out[name] = plain(raw, name)
            elif deeper:
                out[name], at = block(at, lines[at][0], name)
            else:
                out[name] = None
        if at < len(lines) and lines[at][0] > depth:
            raise ValueError(f"deeper than its key: {lines[at][1]}")
        return out, at

    if not lines:
        return {}
    out, at = block(0, lines[0][0], "")
    if at < len(lines):
        raise ValueError(f"not an option: {lines[at][1]}")
    return out


def _pair(line: str) -> tuple[str, str] | None:
    """Key and value of a ``key: value`` or ``key:`` line."""
    key, colon, raw = line.partition(":")
    return (key.strip().strip("'\""), raw.strip()) if colon and (not raw or raw[0] == " ") and key[:1] not in ("[", "{") else None


def options_text(given: dict, level: int = 1) -> str:
    """Nested options as indented lines; a nested one stands in square brackets."""
    pad, lines = "  " * level, []
    for key, value in given.items():
        lines.append(f"{pad}{key}:[{options_text(value, level + 1)}{pad}]" if isinstance(value, dict) else f"{pad}{key}: {value}")
    return "\n" + "".join(line + "\n" for line in lines)
