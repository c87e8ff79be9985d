"""Benchmark decontamination: windows of benchmark words in a broadcast hash set, in DataFrame functions only.

Words are runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z. A window is ``WINDOW``
consecutive words of an item; an item of fewer words, but not none, is one window. Windows are known by a 64-bit hash of
their words. The scan hashes the words at every place of a text, in the code that reads it, and probes the broadcast set
of hashes; only places that pass become rows, with their words, and are verified against the windows themselves. The set
is broadcast a share at a time, as many shares as keep each below ``MAX_BROADCAST_WINDOWS``; every share is another scan,
so no text and no place that misses is ever moved, however large the benchmark is.

Null or word-less texts have no words and no hits. Very long texts are scanned as any other; a task holds one text's
words. A null item text has no windows; a null item_id is left out of the lists of items. Rows that repeat get one result
row each, as rows are known by file and place. Overlapping hits count each word once. Extra columns are ignored, and kept
by ``remove`` whatever their names. An empty benchmark hits nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import from_files, hot_join, numbered, row_maps, sized, split_by_rows, written

WINDOW = 10
#: The most hashes of windows (8 bytes each, some 60 in a hash table) that are broadcast at once.
MAX_BROADCAST_WINDOWS = 1_000_000

#: Fixed value: what stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, BETWEEN), "")  # a text may begin or end between words


def bound(value: Column, body) -> Column:
    """``body`` of a variable that holds ``value``, computed once."""
    return F.transform(F.array(value), body)[0]


def window_hash(w: Column, at: Column, length: int) -> Column:
    """Hash of so many words from a place on; of fewer where the text ends, which no window's length equals."""
    return F.xxhash64(F.lit(length), *[F.get(w, at + j) for j in range(length)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """window text, its number of words, its hash, and the items that have it."""
    w = F.col("w")
    n = F.size(w)
    starts = F.when(n >= window, F.sequence(F.lit(0), n - window)).when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    grams = (
        benchmark.select("item_id", word_array(F.col("text")).alias("w"))
        .select("item_id", "w", F.explode(starts).alias("at"))
        .select("item_id", F.slice(w, F.col("at") + 1, window).alias("gram"))
        .groupBy("gram")
        .agg(F.collect_set("item_id").alias("items"))
    )
    length, h = F.size("gram"), F.lit(None).cast("long")
    for k in range(1, window + 1):
        h = F.when(length == k, window_hash(F.col("gram"), F.lit(0), k)).otherwise(h)
    return grams.select(F.array_join("gram", " ").alias("window"), length.alias("length"), h.alias("h"), "items")


def _places(rows: DataFrame, length: int, hashes: DataFrame, marks: bool) -> DataFrame:
    """_file, _at, doc_id, n_words, at, length, window: every place whose window of ``length`` words has a known hash and,
    with ``marks``, a row for each document, without a place. Texts are exploded and probed within one stage's code."""
    words = rows.select("_file", "_at", "doc_id", word_array(F.col("text")).alias("w"))
    # Place 0 stands for the document itself; the array is thus never empty, and no filter reads the text once more.
    each = words.select("_file", "_at", "doc_id", F.size("w").alias("n_words"), "w", F.posexplode_outer(F.concat(F.array(F.lit("")), F.col("w"))).alias("p", "_word")).drop("_word")
    if not marks:
        each = each.where("p > 0")
    at = F.col("p") - 1
    met = each.withColumn("h", F.when((F.col("p") > 0) & (at + length <= F.col("n_words")), window_hash(F.col("w"), at, length)))
    met = met.join(F.broadcast(hashes.withColumn("known", F.lit(True))), "h", "left" if marks else "inner").where(F.col("known") | (F.col("p") == 0))
    hit = F.col("known").isNotNull()
    return met.select("_file", "_at", "doc_id", "n_words", F.when(hit, at).alias("at"), F.when(hit, F.lit(length)).alias("length"), F.when(hit, F.array_join(F.slice("w", at + 1, length), " ")).alias("window"))


def places(docs: DataFrame, known: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each document, and one for each place to verify. The marks come from the first share of whole windows."""
    rows = numbered(docs, "doc_id", "text")
    counts = {r[0]: r[1] for r in known.groupBy("length").count().collect()}  # at most ``window`` rows
    out = None
    for length in sorted({window, *counts}, reverse=True):
        shares = max(1, -(-counts.get(length, 0) // MAX_BROADCAST_WINDOWS))
        for k in range(shares):
            hashes = known.where((F.col("length") == length) & (F.pmod("h", F.lit(shares)) == k)).select("h").distinct()
            part = _places(rows, length, hashes, marks=out is None)
            out = part if out is None else out.unionByName(part)
    return out


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs`` (:func:`from_files`): _file, _at, doc_id, n_words, spans (sorted array of at, length in words), items."""
    known = written(benchmark_windows(benchmark, window), "benchmark-windows")
    each = written(places(docs, known, window), "places")
    found = each.where("window is not null").select("_file", "_at", "at", "length", "window")
    side = known.select("window", "items")
    if known.count() <= MAX_BROADCAST_WINDOWS:
        met = found.join(F.broadcast(side), "window")
    else:  # a window that many documents have is met by broadcast, the others by a shuffle
        size = written(found.groupBy("window").agg(F.count(F.lit(1)).alias("size")).join(side, "window"), "found-windows")
        met = hot_join(found, size, "window", "inner").drop("size")
    marks = each.where("window is null").select("_file", "_at", "doc_id", "n_words")
    spans = F.sort_array(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "length")))).alias("spans")
    return marks.unionByName(met.drop("window"), allowMissingColumns=True).groupBy("_file", "_at").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), spans, F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def covered(spans: Column) -> Column:
    """The number of words under any of the sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(
        spans,
        start,
        lambda a, s: F.struct(F.greatest(a["end"], s["at"] + s["length"]).alias("end"), (a["total"] + F.greatest(F.lit(0), s["at"] + s["length"] - F.greatest(a["end"], s["at"]))).alias("total")),
        lambda a: a["total"],
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = hits(from_files(docs), benchmark)
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def _hit(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return hits(docs, benchmark).where(F.size("spans") > 0).select("_file", "_at", "spans")


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, with all their columns."""
    docs = from_files(docs)
    return split_by_rows(docs, row_maps(_hit(docs, benchmark)), inside=False)


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and its words outside all hits, joined by single spaces (normalised words, as the scan sees them). Only texts
    with hits meet their spans."""
    docs = from_files(docs).select("doc_id", "text")
    found = written(_hit(docs, benchmark), "spans")
    maps = row_maps(found)
    clean = split_by_rows(docs, maps, False).select("doc_id", F.array_join(word_array(F.col("text")), " ").alias("text"))
    met = split_by_rows(docs, maps, True, "doc_id", "text", "_file", "_at").join(sized(found), ["_file", "_at"])
    left = bound(word_array(F.col("text")), lambda w: F.array_join(F.filter(w, lambda _, i: ~F.exists(F.col("spans"), lambda s: (i >= s["at"]) & (i < s["at"] + s["length"]))), " "))
    return clean.unionByName(met.select("doc_id", left.alias("text")))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), g AS (
  SELECT item_id, least(len(ws), 10) AS k, unnest(range(greatest(len(ws) - 9, 1))) AS i, ws FROM b WHERE len(ws) > 0
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i + 1 : i + k], ' ') AS s FROM g
), ks AS (SELECT DISTINCT k FROM win), pos AS (
  SELECT doc_id, k, unnest(range(len(ws) - k + 1)) AS i, ws FROM w, ks WHERE len(ws) >= k
), hit AS (
  SELECT p.doc_id, p.i, p.k, win.item_id FROM (SELECT doc_id, k, i, array_to_string(ws[i + 1 : i + k], ' ') AS s FROM pos) p JOIN win ON p.k = win.k AND p.s = win.s
), cover AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""
