import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageflow.operators import confidence, lm, scorers
from pageflow.plans import jobs
from pageflow.sources import readers, sinks
from pageflow.streaming import resume


def test_coordinates(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("Unicode,Image,X,Y,Width,Height,extra\nU+3042, b_1_1 ,1,2,3,4,x\nU+3044,b_1_1,5,6,7,8,y\n", encoding="utf-8")
    assert [tuple(r) for r in readers.coordinates(spark, str(p)).orderBy("X").collect()][1] == ("U+3044", "b_1_1", 5.0, 6.0, 7.0, 8.0)
    g = readers.coordinates_by_image(spark, str(p)).collect()
    assert len(g) == 1 and [b["x"] for b in g[0]["boxes"]] == [1.0, 5.0]
    (tmp_path / "bad.csv").write_text("Unicode,Image,X\na,b,1\n")
    with pytest.raises(ValueError):
        readers.coordinates(spark, str(tmp_path / "bad.csv"))


def test_coordinates_by_position(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("Unicode,Image,X,Y,Block,Char,Width,Height\nU+3042,i,1,2,B,C,3,4\nU+3042,i,z,2,B,C,3,4\nU+3042,i,1,2,B,C,0,4\n")
    assert [tuple(r) for r in readers.coordinates_by_position(spark, str(p)).collect()] == [("U+3042", "i", 1.0, 2.0, 3.0, 4.0)]


def test_page_texts(spark, tmp_path):
    d = tmp_path / "100"
    d.mkdir()
    (d / "100_1_1.txt").write_bytes("あ　い\n\U0002000b".encode() + b"\xff")
    got = readers.page_characters(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["book_id"], r["page"], r["gt"]) for r in got] == [("100", "100_1_1", c) for c in "あい\U0002000b"]


def recognition_files(tmp_path):
    for folder, body in (("a", [{"x1": 0, "y1": 0, "x2": 5, "y2": 5, "char": "あ", "prob": 0.9, "top5": [["あ", 0.9], ["い", 0.1]]}, {"x1": 0, "y1": 0, "x2": 5, "y2": 5}]), ("b", [])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "arc_result.json").write_text(json.dumps(body), encoding="utf-8")
    (tmp_path / "c").mkdir()


def test_recognitions(spark, tmp_path):
    recognition_files(tmp_path)
    got = readers.recognitions(spark, str(tmp_path)).orderBy("folder", "pos").collect()
    assert [(r["folder"], r["char"], r["prob"], len(r["top5"])) for r in got] == [("a", "あ", 0.9, 2), ("a", "?", 0.0, 0)]
    assert sorted(r[0] for r in readers.folders_with(spark, str(tmp_path), "arc_result.json").collect()) == ["a", "b"]


def test_boxes_json_in_both_forms(spark, tmp_path):
    for folder, body in (("a", [[1, 2, 3, 4, 0.5]]), ("b", [{"x1": 1, "y1": 2, "x2": 3, "y2": 4, "score": 0.5}])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "bboxes.json").write_text(json.dumps(body))
    assert {tuple(r)[2:] for r in readers.boxes_json(spark, str(tmp_path)).collect()} == {(1, 2, 3, 4, 0.5)}


def test_classes(spark, tmp_path):
    (tmp_path / "c.txt").write_text("U+3042\n\n U+3044 \n")
    assert [tuple(r) for r in readers.class_list(spark, str(tmp_path / "c.txt")).orderBy("class_id").collect()] == [(0, "U+3042", "あ"), (1, "U+3044", "い")]
    (tmp_path / "m.json").write_text('{"3": "U+3042"}')
    assert tuple(readers.class_map(spark, str(tmp_path / "m.json")).first()) == (3, "U+3042", "あ")
    (tmp_path / "e.txt").write_text("\n\n")
    with pytest.raises(ValueError):
        readers.class_list(spark, str(tmp_path / "e.txt"))


def test_scan_and_resolve(spark, tmp_path):
    for n in ("a.png", "a.jpg", "b.PNG", ".hidden.png", "mask_a.txt"):
        (tmp_path / n).write_bytes(b"x")
    files = readers.scan(spark, str(tmp_path))
    assert sorted(r["name"] for r in files.collect()) == ["a.jpg", "a.png", "b.PNG", "mask_a.txt"]
    assert [r["name"] for r in readers.scan(spark, str(tmp_path), keyword="a").where("ext = '.txt'").collect()] == ["mask_a.txt"]
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    got = {r["k"]: r["path"] and r["path"].rsplit("/", 1)[1] for r in readers.resolve(keys, files, "k", readers.IMAGE_EXTENSIONS).collect()}
    assert got == {"a": "a.jpg", "b": "b.PNG", "c": None}


def test_flows(spark, tmp_path):
    dx, dy = np.arange(6.0).reshape(2, 3), np.ones((2, 3))
    (tmp_path / "f.flo").write_bytes(readers.flow_bytes(dx, dy))
    got = readers.flows(spark, str(tmp_path)).orderBy("y", "x").collect()
    assert [r["dx"] for r in got] == list(range(6)) and {r["dy"] for r in got} == {1.0}


def test_options():
    nested = readers.options("train:\n  names:\n  - a\n  - b\n  sets:\n    - name: x\n      n: 1\n    - name: y\nempty:\n")
    assert nested == {"train": {"names": ["a", "b"], "sets": [{"name": "x", "n": 1}, {"name": "y"}]}, "empty": None}
    with pytest.raises(ValueError):
        readers.options("a: 1\n  b: 2\n")
    o = readers.options("a: 1\nb:\n  weights_path: w.pth\n  flag: true  # yes\nc: [1, 2]\n", "/base")
    assert o == {"a": 1, "b": {"weights_path": "/base/w.pth", "flag": True}, "c": [1, 2]}


def read(path):
    return "".join(sorted(p.read_text(encoding="utf-8") for p in path.iterdir() if p.name.startswith("part-")))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, 'x,"y"'), ("a", 1, None)], "k string, n int, t string")
    sinks.csv_report(df, str(tmp_path / "csv"), ["k"])
    assert read(tmp_path / "csv") == sinks.BOM + 'k,n,t\na,1,\nb,2,"x,""y"""\n'
    sinks.json_array(df.select("k", "n"), str(tmp_path / "json"), ["k"])
    assert json.loads(read(tmp_path / "json")) == [{"k": "a", "n": 1}, {"k": "b", "n": 2}]
    store = spark.createDataFrame([("k1", b"png", 2, 3, 1)], "key string, png binary, h int, w int, c int")
    sinks.image_store(store, str(tmp_path / "store"))
    assert readers.store_get(spark, str(tmp_path / "store"), ["k1"]).first()["meta"] == "k1.png (2,3,1) 1"
    sinks.corpus(spark.createDataFrame([("p", "ab")], "page string, text string"), str(tmp_path / "corpus"))
    assert read(tmp_path / "corpus" / "preview") == "ab\n"


def test_batch_report(spark, tmp_path):
    recognition_files(tmp_path)
    jobs.batch_report(spark, str(tmp_path), str(tmp_path / "out"))
    assert json.loads(read(tmp_path / "out" / "report"))["summary"]["total"] == 2
    assert "| predictions | 2 |" in read(tmp_path / "out" / "markdown")


def test_page_job(spark):
    pages = spark.createDataFrame([("p", 640, 640)], "page string, width int, height int")
    det = spark.createDataFrame([("p", 0, 0, 300, 300, 320, 320, 0.9, 1.0, 0, 0, 640, 640)], "page string, tile_idx int, idx int, x1 int, y1 int, x2 int, y2 int, obj double, cls_conf double, x0 int, y0 int, w int, h int")
    bare = jobs.pages_to_characters(pages, det).first()
    assert (bare["char_id"], bare["width"], bare["unicode"]) == ("char_0000.png", 20, None)
    read_ = jobs.pages_to_characters(pages, det, lambda: scorers.load_hash_recogniser(["あ", "い"])).first()
    assert read_["unicode"] in "あい" and 0 < read_["confidence"] <= 1


def test_evaluation_job(spark):
    b = spark.createDataFrame([("p", i, 100, 20 * i, 120, 20 * i + 15, [("a", -0.1), ("b", -2.0)]) for i in range(3)], "page string, idx int, x1 int, y1 int, x2 int, y2 int, candidates array<struct<char:string,logp:double>>")
    t = spark.createDataFrame([("p", i, c) for i, c in enumerate("aab")], "page string, pos int, gt string")
    bigrams = lm.bigram_logprob(spark.createDataFrame([("aab",)], "text string"))
    out = jobs.evaluate(b, t, bigrams, lambda df: df.withColumn("mlm", F.lit(0.0))).orderBy("pos").collect()
    assert [r["greedy"] for r in out] == ["a", "a", "a"] and len(out) == 3 and out[0]["topk_chars"] == ["a", "b"]


def test_resume_reads_new_files_once(spark, tmp_path):
    src, args = str(tmp_path / "in"), (str(tmp_path / "cp"), str(tmp_path / "out"), lambda df: df.withColumn("y", F.col("x") * 2))
    spark.range(3).select(F.col("id").alias("x")).write.parquet(src)
    assert resume.run_pending(spark, src, "x bigint", *args) == 3
    spark.range(2).select(F.col("id").alias("x")).write.mode("append").parquet(src)
    assert resume.run_pending(spark, src, "x bigint", *args) == 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_summary_of_files_equals_rows(spark, tmp_path):
    recognition_files(tmp_path)
    assert confidence.summary(readers.recognitions(spark, str(tmp_path))).first()["total"] == 2


def test_coco_document(spark, tmp_path):
    images = spark.createDataFrame([(1, "b.jpg"), (0, "a.jpg")], "id int, file_name string")
    notes = spark.createDataFrame([(0, 1, [1.0, 2.0, 3.0, 4.0])], "id int, image_id int, bbox array<double>")
    sinks.coco_document(images, notes, str(tmp_path / "coco"))
    doc = json.loads(read(tmp_path / "coco"))
    assert [i["file_name"] for i in doc["images"]] == ["a.jpg", "b.jpg"] and doc["categories"] == [{"id": 1, "name": "char"}] and doc["annotations"][0]["image_id"] == 1
