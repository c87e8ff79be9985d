"""Row identity, row maps and hot keys: what the stages rest on."""

import random

import pytest
from pyspark.sql import functions as F

from pageflow.llm import common, decontaminate, exact_dedup, jaccard_join, quality
from pageflow.llm.common import from_files, hot_join, numbered, row_maps, split_by_rows

CLASHES = "doc_id long, text string, _row long, _id long, _h long, _file string, _at int, _block int, _bits string, row long, w string, spans int"


def docs_of(spark, tmp_path, texts, partitions=3):
    rows = [(i, t, -1, 7, 8, "f", 0, 1, "b", 2, "w", 3) for i, t in texts]
    path = str(tmp_path / f"d{random.random()}")
    spark.createDataFrame(rows, CLASHES).repartition(partitions).write.parquet(path)
    return spark.read.parquet(path)


def test_rows_keep_their_number(spark, tmp_path):
    docs = docs_of(spark, tmp_path, [(i, f"t{i}") for i in range(500)])
    before = {r["doc_id"]: (r["_file"], r["_at"]) for r in numbered(docs.drop("_file", "_at"), "doc_id").collect()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "9")
    try:
        assert {r["doc_id"]: (r["_file"], r["_at"]) for r in numbered(docs.drop("_file", "_at"), "doc_id").collect()} == before
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert len(set(before.values())) == 500


def test_other_frames_are_written_once(spark, tmp_path):
    docs = docs_of(spark, tmp_path, [(1, "a"), (2, "b")])
    assert from_files(docs.where("doc_id > 1").select("doc_id", "text")) is not None and common._scan_only(docs.where("doc_id > 1"))
    joined = docs.join(spark.range(2).withColumnRenamed("id", "k"))
    assert not common._scan_only(joined) and not common._scan_only(docs.union(docs)) and not common._scan_only(spark.range(3).toDF("doc_id"))
    assert numbered(from_files(joined.select("doc_id", "text")), "doc_id").select("_file", "_at").distinct().count() == 4


@pytest.mark.parametrize("most", [64 << 20, 4000])
def test_split_by_rows(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(common, "MAX_MAP_BYTES", most)  # with little room, each file is a share of its own
    docs = docs_of(spark, tmp_path, [(i, f"t{i}") for i in range(300)], 5)
    picked = numbered(docs.drop("_file", "_at"), "doc_id").where("doc_id % 3 = 0 OR doc_id = 298")
    maps = row_maps(picked)
    want = {i for i in range(300) if i % 3 == 0} | {298}
    inside, outside = split_by_rows(docs, maps, True), split_by_rows(docs, maps, False)
    assert inside.columns == outside.columns == docs.columns
    assert sorted(r["doc_id"] for r in inside.collect()) == sorted(want)
    assert sorted(r["doc_id"] for r in outside.collect()) == sorted(set(range(300)) - want)


def test_no_text_is_moved(spark, tmp_path, monkeypatch):
    """With no room for broadcasts at all, the stages' plans still have no exchange that holds a text."""
    monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "MAX_MAP_BYTES", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = docs_of(spark, tmp_path, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "q"), (4, "one two three four five six seven eight nine ten")]).select("doc_id", "text")
        bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
        for out, want in ((exact_dedup.drop_exact_duplicates(docs), [1, 3, 4]), (jaccard_join.keep_one_of_each(docs), [1, 3, 4]), (decontaminate.remove(docs, bench), [1, 2, 3])):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
            assert sorted(r["doc_id"] for r in out.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing names, long texts, and empty tables, through every filtering stage."""
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, long), (3, long), (None, "x y z"), (5, "x y  z"), (6, "one two three four five six seven eight nine ten"), (7, "solo")]
    bench = spark.createDataFrame([(1, "One two three four five six seven eight nine TEN"), (None, "none"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(5, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    docs, none = docs_of(spark, tmp_path, texts), docs_of(spark, tmp_path, [], 1)
    key = lambda r: (r["doc_id"] is None, r["doc_id"])
    ids = lambda df: [r["doc_id"] for r in sorted(df.collect(), key=key)]
    stages = [(lambda d: quality.keep_good(d, labels), [1, 2, 3, 3, 5, 6, 7, None]), (exact_dedup.drop_exact_duplicates, [1, 3, 5, 6, 7]), (jaccard_join.keep_one_of_each, [1, 2, 3, 5, 6, 7]), (lambda d: decontaminate.remove(d, bench), [1, 2, 3, 3, 5, 7, None])]
    for stage, want in stages:
        out = stage(docs)
        assert out.columns == docs.columns and ids(out) == want
        assert stage(none).columns == docs.columns and stage(none).count() == 0


def test_hot_join(spark, tmp_path):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least")).where("k % 2 = 0")
    got = hot_join(rows, groups, "k").select("id", "least")
    want = rows.join(groups, "k", "left").select("id", "least")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == 3000
    inner = hot_join(rows, groups, "k", "inner")
    assert inner.count() == rows.join(groups, "k").count()


def test_links_near_the_threshold_are_found(spark, tmp_path):
    """Recall: pairs between 0.85 and 0.87, the hardest, one by one, each against its exact similarity."""
    r = random.Random(4)
    texts, pairs = [], 0
    while pairs < 300:
        n = r.randrange(60, 200)
        words = [f"w{r.randrange(10**6)}" for _ in range(n)]
        own = list(words)
        for at in r.sample(range(n), r.randrange(1, 6)):
            own[at] = f"v{r.randrange(10**6)}"
        a, b = ({tuple(x[i : i + 4]) for i in range(n - 3)} for x in (words, own))
        if 0.85 <= len(a & b) / len(a | b) < 0.87:
            texts += [(2 * pairs, " ".join(words)), (2 * pairs + 1, " ".join(own))]
            pairs += 1
    got = jaccard_join.jaccard_components(docs_of(spark, tmp_path, texts), 4, 85).where("doc_id % 2 = 1 AND component_id = doc_id - 1").count()
    assert got == pairs
