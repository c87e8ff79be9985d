"""Stages that are written once to the folder that all machines share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, one of our own, but in local mode only: on a cluster a
    machine's own folder would lose stages, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file:///tmp/checkpoints/pageflow-{os.getpid()}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders of the stages that this process has written and not deleted.
_MADE: set[str] = set()


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path for files of any kind, which :func:`clear` deletes too."""
    path = new_path(spark, name)
    _MADE.add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once in the shared folder: its lineage ends here, and a lost executor costs nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    _MADE.add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _MADE.discard(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table just as :func:`written` returned it; nothing may read it again."""
    if getattr(df, "_stage", None) in _MADE:
        _delete(df.sparkSession, df._stage)


def clear(spark: SparkSession) -> None:
    """Deletes all stages of this process, those of failed runs too, once their results have been consumed."""
    for path in list(_MADE):
        _delete(spark, path)
