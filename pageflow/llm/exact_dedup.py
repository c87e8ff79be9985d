"""Exact duplicates by recipes of content-defined chunks, in DataFrame functions only.

A text is normalised (every run of ASCII white space becomes one space) and cut where its own content says so: after at
least ``MIN_CHUNK`` characters, at the first place that looks like ``CUT`` (common word endings of several scripts, and
full stops and commas of scripts without spaces), or at ``MAX_CHUNK`` characters. A chunk gets a 128-bit identifier. The
chunk texts are moved once, deduplicated before the shuffle, to verify that every identifier stands for one text only.
From then on only the ordered lists of identifiers, the recipes, are compared. Rows are known by their file and place, and
dropped where they are read, so no whole text is ever moved.

Nulls count as empty. Empty texts are equal to one another. Very long texts are cut as any other; a task holds one text
and its chunks. Rows that share the smallest doc_id of a group tie: one of them, the first by file and place, stays. A null
doc_id stays only if its group has no other. Extra columns are ignored, and kept by ``drop_exact_duplicates`` whatever
their names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import from_files, hot_join, numbered, row_maps, split_by_rows, written

MIN_CHUNK, MAX_CHUNK = 512, 4096
#: Where a chunk may end. A vowel, a frequent consonant and a space; in other scripts the end of a word, or a
#: stop or comma where words aren't spaced. ASCII characters leave the second form at once.
CUT = "(?:[aeiou][nrst] |[^ -~](?:[^ -~] |[。、，！？]))"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunks(norm: Column) -> Column:
    """All chunks, in order; put together they are the text."""
    return F.regexp_extract_all(norm, F.lit(f"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?{CUT}|.{{1,{MAX_CHUNK}}}"), F.lit(0))


def recipes(rows: DataFrame, chunk_id=F.md5) -> DataFrame:
    """_file, _at, doc_id, recipe (the identifiers, of equal length, one after the other) and the text's digest."""
    return rows.select("_file", "_at", "doc_id", normalised(F.col("text")).alias("norm")).select(
        "_file", "_at", "doc_id", F.array_join(F.transform(chunks(F.col("norm")), chunk_id), "").alias("recipe"), F.sha2(F.col("norm"), 256).alias("text_sha256")
    )


def clashes(docs: DataFrame) -> int:
    """The number of identifiers that stand for more than one chunk text."""
    each = docs.select(F.explode(chunks(normalised(F.col("text")))).alias("chunk"))
    texts = each.groupBy(F.md5("chunk").alias("id"), "chunk").agg(F.lit(1).alias("one"))
    return texts.groupBy("id").count().where("count > 1").count()


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: _file, _at, doc_id, keep_id, group_size, kept, text_sha256.

    Should an identifier fail its verification, the recipes are made of the chunks' lengths and texts instead.
    """
    rows = numbered(from_files(docs), "doc_id", "text")
    verified = clashes(rows) == 0
    made = written(recipes(rows) if verified else recipes(rows, lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)), "recipes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_file", "_at")).alias("first")
    groups = written(made.groupBy("recipe").agg(first, F.count(F.lit(1)).alias("size")).where("size > 1"), "recipe-groups")
    joined = hot_join(made, groups, "recipe")
    return joined.select(
        "_file",
        "_at",
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce((F.col("_file") == F.col("first._file")) & (F.col("_at") == F.col("first._at")), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = from_files(docs)
    return split_by_rows(docs, row_maps(exact_duplicates(docs).where(~F.col("kept"))), inside=False)


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""
