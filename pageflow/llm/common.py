"""Written stages, row identity that holds across scans, joins that split hot keys, and loaders for the operators here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import stages
from ..stages import new_path, shared_folder  # noqa: F401

#: Rows and bytes of an Arrow batch, where the session has Spark's own defaults: whole texts are long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def small_batches(spark: SparkSession) -> None:
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once in the shared folder: its lineage ends here, and a lost executor costs nothing."""
    small_batches(df.sparkSession)
    return stages.written(df, name)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`written` once nothing will read it again."""
    stages.dropped(df)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; a null id counts as the empty text (crc32 0), so as held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


#: Rows of a few numbers (16 to 50 bytes each) up to which a counted side is broadcast.
MAX_BROADCAST_ROWS = 500_000


def sized(side: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``side`` with a broadcast hint if it was counted to have at most ``most`` rows; else it is joined by a shuffle."""
    return F.broadcast(side) if side.count() <= most else side


# --- rows and their files -------------------------------------------------------------------------------------------

#: What a row of ``numbered`` is known by: a 64-bit hash of its file's path, and its place in the file.
ROW = ("_file", "_at")


def _scan_only(docs: DataFrame) -> bool:
    """Whether ``docs`` is a scan of files, filtered and projected at most, so that every row is one row of a file."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.toString().lower()


def from_files(docs: DataFrame, name: str = "rows") -> DataFrame:
    """``docs`` if it is read from Parquet files as it is, else a copy that is written once."""
    return docs if _scan_only(docs) else written(docs, name)


def _row(docs: DataFrame) -> tuple[Column, Column]:
    meta = docs.metadataColumn("_metadata")
    return F.xxhash64(meta["file_path"]), meta["row_index"]


def numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``ROW`` of ``docs``, which must be :func:`from_files`. A row's number follows from its file and its
    place in it, so it is the same at every scan, however many executors there are."""
    file, at = _row(docs)
    return docs.select(*columns, file.alias("_file"), at.alias("_at"))


#: Bits of one block of a row map (fixed by the functions that make it), and the bytes of blocks that are broadcast at once.
BLOCK, MAX_MAP_BYTES = 32_768, 64 << 20


def row_maps(rows: DataFrame) -> DataFrame:
    """A bit for each of ``rows`` (``ROW``): _file, _block, _bits, 4096 bytes for 32768 places of a file. Written."""
    place = F.col("_at") + 1
    made = rows.groupBy("_file", F.bitmap_bucket_number(place).alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    return written(made, "row-maps")


def split_by_rows(docs: DataFrame, maps: DataFrame, inside: bool, *columns: str) -> DataFrame:
    """The rows of ``docs`` (:func:`from_files`) that ``maps`` marks, or those it doesn't, with ``columns`` (all, if none
    are named). Texts stay where they are read: the maps of a share of the files are broadcast at a time, as many shares as
    keep them below ``MAX_MAP_BYTES``, and each share reads its own files only."""
    blocks = maps.count()
    shares = max(1, min(blocks, -(-blocks * (BLOCK // 8 + 32) // MAX_MAP_BYTES)))
    names = [c for c in docs.columns]
    file_name, block_name, bits_name = (_free(c, names) for c in ("_file", "_block", "_bits"))
    side = maps.select(F.col("_file").alias(file_name), F.col("_block").alias(block_name), F.col("_bits").alias(bits_name))
    file, at = _row(docs)
    at_name = _free("_at", names)
    out = None
    for k in range(shares):
        own = docs.where(F.pmod(file, F.lit(shares)) == k) if shares > 1 else docs
        own = own.select(*[F.col(f"`{c}`") for c in names], file.alias(file_name), at.alias(at_name)).withColumn(block_name, F.bitmap_bucket_number(F.col(at_name) + 1))
        part = side.where(F.pmod(file_name, F.lit(shares)) == k) if shares > 1 else side
        met = own.join(F.broadcast(part), [file_name, block_name], "left")
        byte = F.conv(F.hex(F.substring(bits_name, (F.col(at_name) % BLOCK / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        marked = F.coalesce(F.getbit(byte, (F.col(at_name) % 8).cast("int")) == 1, F.lit(False))
        kept = met.where(marked if inside else ~marked)
        asked = columns or names
        kept = kept.select(*[F.col(file_name).alias("_file") if c == "_file" and c not in names else F.col(at_name).alias("_at") if c == "_at" and c not in names else F.col(f"`{c}`") for c in asked])
        out = kept if out is None else out.unionByName(kept)
    return out


def _free(name: str, taken: list[str]) -> str:
    lower = {t.lower() for t in taken}
    while name in lower:
        name += "_"
    return name


# --- hot keys -------------------------------------------------------------------------------------------------------

#: A key with more than this share of all rows is hot: there are fewer than its reciprocal of them.
HOT_SHARE = 1 / 2000


def hot_join(rows: DataFrame, groups: DataFrame, key: str, how: str = "left", total: int | None = None) -> DataFrame:
    """``rows`` joined with ``groups`` (one row for each key, with its number of rows in ``size``). Hot keys' rows stay
    where they are and meet their groups by broadcast, at most ``1 / HOT_SHARE`` rows; all others meet by a shuffle, where
    no key has more than that share. Both sides should be written tables."""
    limit = (rows.count() if total is None else total) * HOT_SHARE
    hot = groups.where(F.col("size") > limit)
    keys = F.broadcast(hot.select(key))
    there = rows.join(F.broadcast(hot), key)
    rest = rows.join(keys, key, "left_anti").join(groups.where(F.col("size") <= limit), key, how)
    return there.unionByName(rest)
