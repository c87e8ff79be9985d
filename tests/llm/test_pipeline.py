"""The pipeline's stages, one by one on what the one before kept, against brute force."""

import hashlib
import re

import corpus_pipeline
from pageflow.llm import quality
from pageflow.llm.common import table, written
from tests.llm.test_text_operators import py_components, py_decontaminate

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = written(stage(spark, docs, DIR), "stage")
        assert out.columns == columns
        ids = {r["doc_id"] for r in out.collect()}
        if name == "quality classifier":
            want = {r["doc_id"] for r in quality.quality(docs, table(spark, DIR, "labels")).where("predicted = 1").collect()}
        elif name == "exact dedup":
            first = {}
            for i, t in sorted(before):
                first.setdefault(hashlib.md5(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).digest(), i)
            want = set(first.values())
        elif name == "n-gram Jaccard join":
            want = {c for _, _, c in py_components(before, 5, 80)}
        else:
            items = [(r["item_id"], r["text"]) for r in table(spark, DIR, "benchmark").collect()]
            want = {t[0] for t in py_decontaminate(before, items) if not t[5]}
        assert ids == want, name
        kept[name], docs = ids, out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).toPandas()
    assert set(packed.doc_id) == kept["benchmark decontamination"]
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert len(corpus_pipeline.run(spark, DIR).toPandas()) == len(packed)


def test_no_documents(spark, tmp_path):
    """Every stage on empty tables, and the whole."""
    for name in ("documents", "labels", "benchmark"):
        table(spark, DIR, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
