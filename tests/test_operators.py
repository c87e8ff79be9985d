import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageflow import catalogue, schemas
from pageflow.operators import confidence, datasets, decode, detect, evalstats, image_quality, layout, lm, raster, recognise, tiling

BOXES = "page string, idx int, x1 int, y1 int, x2 int, y2 int"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def random_boxes(n, pages=3, seed=1, size=300):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.randrange(size), r.randrange(size)
        out.append((f"p{r.randrange(pages)}", i, x, y, x + r.randrange(1, 60), y + r.randrange(1, 60)))
    return out


def py_order(boxes):
    boxes = [(b, (b[2] + b[4]) / 2, (b[3] + b[5]) / 2) for b in boxes]
    gap = max(int(np.median([max(1, b[4] - b[2]) for b, _, _ in boxes]) * 0.8), 5)
    boxes.sort(key=lambda t: (-t[1], t[0][1]))
    col, placed = 0, []
    for k, t in enumerate(boxes):
        if k and abs(t[1] - boxes[k - 1][1]) > gap:
            col += 1
        placed.append((col, t[2], t[0][1]))
    return [i for _, _, i in sorted(placed)]


def test_reading_order_against_a_loop(spark):
    data = random_boxes(200)
    got = layout.reading_order(spark.createDataFrame(data, BOXES))
    for page in ("p0", "p1", "p2"):
        order = [r["idx"] for r in got.where(F.col("page") == page).orderBy("pos").collect()]
        assert order == py_order([b for b in data if b[0] == page])


def test_reading_order_cuts_coordinates(spark):
    data = [("p", 0, 99.9, 0.0, 110.9, 10.0), ("p", 1, 91.2, 20.0, 102.2, 30.0)]  # whole numbers: centres 104.5, 96.5, gap 8
    got = layout.reading_order(spark.createDataFrame(data, "page string, idx int, x1 double, y1 double, x2 double, y2 double"))
    assert rows(got, "idx", "col_id") == [(0, 0), (1, 0)]


def test_gap_equal_to_threshold_stays_in_column(spark):
    data = [("p", 0, 100, 0, 110, 10), ("p", 1, 92, 20, 102, 30), ("p", 2, 83, 40, 93, 50)]  # gap 8: 8 stays, 9 parts
    got = {r["idx"]: r["col_id"] for r in layout.reading_order(spark.createDataFrame(data, BOXES)).collect()}
    assert got == {0: 0, 1: 0, 2: 1}


def test_islands(spark):
    df = spark.createDataFrame([("p", 0, 10), ("p", 10, 20), ("p", 21, 30), ("p", 40, 40)], "page string, s int, e int")
    assert rows(layout.islands(df, ["page"], "s", "e"), "start", "end", "members") == [(0, 20, 2), (21, 30, 1)]


def test_xy_cut_reads_rows_then_columns(spark):
    data = [("p", 0, 50, 0, 60, 10), ("p", 1, 0, 0, 10, 10), ("p", 2, 0, 30, 10, 40), ("p", 3, 5, 5, 5, 5)]
    got = layout.xy_cut(spark.createDataFrame(data, BOXES)).orderBy("pos").collect()
    assert [r["idx"] for r in got] == [1, 0, 2]


def test_tiles_cover_the_page(spark):
    pages = spark.createDataFrame([("p", 1000, 700)], "page string, width int, height int")
    got = tiling.tiles(pages, 640, 320).collect()
    assert max(r["x0"] + r["w"] for r in got) == 1000 and max(r["y0"] + r["h"] for r in got) == 700
    assert sorted(r["tile_idx"] for r in got) == list(range(len(got)))


def test_boxes_fall_into_half_open_tiles(spark):
    data = [("p", 0, 630, 0, 650, 20, 1280, 640), ("p", 1, 0, 0, 1, 30, 1280, 640)]
    df = spark.createDataFrame(data, BOXES + ", width int, height int")
    assert rows(tiling.tiles_of_boxes(df), "idx", "tile_idx") == [(0, 1), (0, 2)]  # centre 640 is outside tile 0; box 1 is too thin


def test_centre_zone_is_inclusive(spark):
    df = spark.createDataFrame([("p", 0, 20, 20, 30, 30, 100, 100), ("p", 1, 19, 20, 29, 30, 100, 100), ("p", 2, 70, 70, 80, 80, 100, 100)], BOXES + ", w int, h int")
    assert rows(tiling.centre_zone(df), "idx") == [(0,), (2,)]


def py_iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / u if w * h else 0.0


def test_suppression_against_a_loop(spark):
    r = random.Random(2)
    data = [(*b, r.randrange(50) / 50) for b in random_boxes(300, seed=3)]
    got = detect.suppress(spark.createDataFrame(data, BOXES + ", score double"), ["page"], 0.3)
    want = []
    for page in ("p0", "p1", "p2"):
        kept = []
        for b in sorted((b for b in data if b[0] == page), key=lambda b: (-b[6], b[1])):
            if all(py_iou(b[2:6], k[2:6]) <= 0.3 for k in kept):
                kept.append(b)
        want += [(page, b[1]) for b in kept]
    assert rows(got, "page", "idx") == sorted(want)


def test_matching_rules(spark):
    t = spark.createDataFrame([("p", 0, 0, 0, 10, 10, "a"), ("p", 1, 0, 0, 10, 20, "b"), ("p", 2, 500, 500, 510, 510, "c")], BOXES + ", char string")
    p = spark.createDataFrame([("p", 0, 0, 0, 10, 10, "a", 0.9), ("p", 1, 0, 0, 10, 10, "x", 0.2), ("p", 2, 300, 300, 310, 310, "q", 0.1)], BOXES + ", char string, conf double")
    pairs = detect.candidate_pairs(t, p)
    assert pairs.count() == 4
    best = detect.best_for_truth(pairs)
    assert rows(best, "t_idx", "p_idx") == [(0, 0)]  # 0.5 exactly is no match; the lower index wins
    back = detect.best_for_prediction(p, pairs)
    assert {r["idx"]: r["t_idx"] for r in back.collect()} == {0: 0, 1: 0, 2: None}
    f1 = {r["image"]: (r["gt_count"], r["pred_count"], r["correct"]) for r in detect.f1_table(t, p, best).collect()}
    assert f1 == {"p": (3, 3, 1), "TOTAL": (3, 3, 1)}


def test_pairs_have_no_nested_loop_and_each_once(spark):
    a, b = random_boxes(150, seed=5), random_boxes(150, seed=6)
    pairs = detect.candidate_pairs(spark.createDataFrame(a, BOXES), spark.createDataFrame(b, BOXES), cell=32)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and py_iou(x[2:], y[2:]) > 0)
    assert rows(pairs, "t_idx", "p_idx") == want


def test_merge_tiles(spark):
    data = [("p", 0, 0, 300, 300, 320, 320, 0.9, 1.0, 0, 0, 640, 640), ("p", 0, 1, 10, 10, 30, 30, 0.9, 1.0, 0, 0, 640, 640), ("p", 1, 2, 200, 300, 220, 320, 0.8, 1.0, 100, 0, 640, 640), ("p", 1, 3, 300, 300, 310, 310, 0.3, 1.0, 100, 0, 640, 640)]
    df = spark.createDataFrame(data, "page string, tile_idx int, idx int, x1 int, y1 int, x2 int, y2 int, obj double, cls_conf double, x0 int, y0 int, w int, h int")
    assert rows(detect.merge_tiles(df), "x1", "y1", "x2", "y2") == [(300, 300, 320, 320)]


REC = "folder string, pos int, char string, prob double"


def test_confidence(spark):
    rec = spark.createDataFrame([("f", 0, "a", 0.5), ("f", 1, "b", 0.9), ("g", 0, "b", 0.2), ("g", 1, "a", 0.95)], REC)
    hist = {r["bin"]: r["n"] for r in confidence.histogram(rec).collect()}
    assert hist == {"0.9-1.0": 2, "0.8-0.9": 0, "0.7-0.8": 0, "0.6-0.7": 0, "0.5-0.6": 1, "0.0-0.5": 1}
    assert rows(confidence.low_confidence(rec), "folder", "pos") == [("g", 0)]
    top = confidence.most_common(rec, 2, ["folder", "pos"]).orderBy("rank").collect()
    assert [r["char"] for r in top] == ["a", "b"]  # equal counts: first seen first
    assert confidence.summary(rec.limit(1)).first()["std_conf"] == 0.0
    empty = confidence.summary(rec.limit(0)).first()
    assert empty["total"] == 0 and empty["mean_conf"] == 0.0
    assert confidence.low_confidence_share(rec.limit(0)).first()["percent"] == 0.0
    defaults = confidence.with_defaults(spark.createDataFrame([(None, None, None)], "char string, prob double, top5 array<string>")).first()
    assert (defaults["char"], defaults["prob"], defaults["top5"]) == ("?", 0.0, [])
    folders = spark.createDataFrame([("f",), ("h",)], "folder string")
    assert rows(confidence.folder_status(folders, rec), "folder", "status") == [("f", "ok"), ("h", "failed")]


def test_evaluation(spark):
    d = spark.createDataFrame([("p", 0, "a", "a", "a", "a", ["a"]), ("p", 1, "a", "b", "a", "a", ["b", "a"]), ("p", 2, "b", "b", "c", "c", ["b"]), ("p", 3, "b", "x", "x", "y", ["x"])], schemas.DECODED)
    t = evalstats.outcome_tally(d).first()
    assert (t["total"], t["ok"], t["fix"], t["worse"], t["bothx"], t["repair_rate"]) == (4, 1, 1, 1, 1, 0.5)
    assert [r["hits"] for r in evalstats.oracle_at_k(d, [1, 2]).orderBy("k").collect()] == [2, 3]
    s = {r["char_gt"]: r for r in evalstats.char_stats(d).collect()}
    assert s["a"]["repair_rate_char"] == 1.0 and s["b"]["final_err"] == 2
    assert rows(evalstats.confusion(d, min_pair=2), "gt", "pred", "count", "is_correct") == [("a", "a", 2, 1)]
    assert rows(evalstats.annotations(d), "pos", "colour") == [(0, "grey"), (1, "green"), (2, "red"), (3, "yellow")]


def test_alignment_skips_pages_of_other_length(spark):
    o = spark.createDataFrame([("p", 0, "a"), ("p", 1, "b"), ("q", 0, "c")], "page string, pos int, greedy string")
    t = spark.createDataFrame([("p", 0, "a"), ("p", 1, "x"), ("q", 0, "c"), ("q", 1, "d")], "page string, pos int, gt string")
    assert evalstats.accuracy(evalstats.align(o, t)).first().asDict() == {"n": 2, "greedy_acc": 0.5}
    pages = spark.createDataFrame([("p",), ("q",), ("r",)], "page string")
    assert rows(evalstats.page_status(pages, o, t), "page", "status") == [("p", "evaluated"), ("q", "length_mismatch"), ("r", "no_text")]


ITEMS = "page string, pos int, candidates array<struct<char:string,logp:double>>"


def test_beams_agree_with_a_loop(spark):
    r = random.Random(4)
    chars = "abc"
    table = {(x, y): -r.randrange(1, 5) / 2 for x in chars for y in chars}
    data = [(f"p{p}", i, [(c, -r.randrange(0, 4) / 2) for c in r.sample(chars, 3)]) for p in range(6) for i in range(7)]
    items = spark.createDataFrame(data, ITEMS)
    bigrams = spark.createDataFrame([(x, y, v) for (x, y), v in table.items()], "w1 string, w2 string, log10_p double")
    scorer = lambda seq: {c: table.get((seq[-1] if seq else "<s>", c), decode.FLOOR) for c in chars}
    a = {r["page"]: r for r in decode.beam_search(items, bigrams, 1.0, 3).collect()}
    b = {r["page"]: r for r in decode.beam_search_scored(items, scorer, 1.0, 3).collect()}
    for p in a:
        beams = [(0.0, ())]
        for _, _, cands in sorted(d for d in data if d[0] == p):
            beams = sorted(((s + lp + scorer(q)[c], (*q, c)) for s, q in beams for c, lp in cands), key=lambda t: -t[0])[:3]
        assert a[p]["seq"] == b[p]["seq"] == list(beams[0][1]) and math.isclose(a[p]["score"], beams[0][0])


def test_masked_rerank_reads_the_pass_before(spark):
    items = spark.createDataFrame([("p", 0, [("a", -1.0), ("b", -1.0)], "a"), ("p", 1, [("a", -1.0), ("b", -1.0)], "z")], ITEMS + ", greedy string")
    scorer = lambda df: df.withColumn("mlm", F.when((F.col("right") == "z") & (F.col("char") == "b"), 1.0).otherwise(0.0))
    assert rows(decode.masked_rerank(items, scorer), "pos", "final") == [(0, "b"), (1, "z")]
    assert rows(decode.masked_rerank(items, scorer, freeze=False), "pos", "final") == [(0, "b"), (1, "a")]


def test_language_model(spark):
    t = spark.createDataFrame([("aba",), ("ab",)], "text string")
    assert rows(lm.ngram_counts(t, 2), "gram", "n") == [("a b", 2), ("b a", 1)]
    meta = lm.corpus_meta(spark.createDataFrame([("a",), ("abc",), ("ab",), ("abcd",)], "text string")).first()
    assert (meta["num_texts"], meta["min_len"], meta["max_len"], meta["median_len_approx"]) == (4, 1, 4, 3)
    table = lm.backoff_table(t, 2).collect()
    assert {r["n"] for r in table} == {1, 2} and all(r["log10_p"] <= 0 for r in table)
    ctx = [r for r in table if r["n"] == 2 and list(r["ctx"]) == ["a"]]
    assert 0 < sum(10 ** r["log10_p"] for r in ctx) <= 1.0


def py_backoff(texts, order, discount=0.75):
    seqs = [[lm.BEGIN, *t, lm.END] for t in texts if t is not None]
    count = {n: Counter(tuple(s[i : i + n]) for s in seqs for i in range(len(s) - n + 1)) for n in range(1, order + 1)}
    p, bow = {}, {}
    for n in range(1, order + 1):
        own = {g: c if n == order else max(1, sum(h[1:] == g for h in count[n + 1])) for g, c in count[n].items()}
        for ctx in {g[:-1] for g in own}:
            here = {g: c for g, c in own.items() if g[:-1] == ctx}
            left = discount * len(here) / sum(here.values())
            bow[ctx] = math.log10(left)
            for g, c in here.items():
                p[g] = max(c - discount, 0) / sum(here.values()) + left * (p.get(g[1:], 1e-7) if n > 1 else 1e-5)
    return sorted((len(g), g[:-1], g[-1], round(math.log10(v), 6), round(bow.get(g, 0.0) if len(g) < order else 0.0, 6)) for g, v in p.items())


@pytest.mark.parametrize("order", [2, 3, 4])
def test_backoff_against_brute_force(spark, order):
    texts = ["abab cab", "ab", "", "a", None, "b\U0002000b\u00e9a", "abab cab", "\x01a\x01"]
    got = lm.backoff_table(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), order).collect()
    assert sorted((r["n"], tuple(r["ctx"]), r["token"], round(r["log10_p"], 6), round(r["log10_backoff"], 6)) for r in got) == py_backoff(texts, order)


def test_backoff_query_reads_texts(spark, tmp_path):
    spark.createDataFrame([(1, "ab", "web"), (2, "ba", "web")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.QUERIES["backoff_model"](spark, str(tmp_path)).collect()
    assert sorted((r["n"], tuple(r["ctx"].split()), r["token"], r["log10_p"], r["log10_backoff"]) for r in got) == py_backoff(["ab", "ba"], 3)


def test_recognition(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (2, [0.0, 1.0], 1)], "id int, embedding array<float>, label int")
    w = recognise.class_weights(e)
    a = {r["id"]: r["topk"] for r in recognise.topk_candidates(e, w, 2).collect()}
    b = {r["id"]: r["topk"] for r in recognise.topk_matrix(e, w, 2).collect()}
    for k in a:
        assert [t["class_id"] for t in a[k]] == [t["class_id"] for t in b[k]]
        assert np.allclose([t["logp"] for t in a[k]], [t["logp"] for t in b[k]])
    assert a[2][0]["class_id"] == 1


def pix(spark, values, image="i"):
    return spark.createDataFrame([(image, y, x, int(v)) for y, row in enumerate(values) for x, v in enumerate(row)], "image string, y int, x int, v int")


def test_rasters(spark):
    df = pix(spark, [[10, 10, 200], [10, 200, 200]])
    th = raster.otsu(df)
    assert th.first()["threshold"] == 10
    mask = raster.binary_mask(df, th)
    assert rows(mask.where("m = 0"), "y", "x") == [(0, 0), (0, 1), (1, 0)]
    assert raster.dilate(mask).where("m = 0").count() == 6
    assert raster.channel_mode(df.where("x < 2"), ["image"]).first()["mode"] == 10
    tv = raster.total_variation(df).first()
    assert (tv["horizontal"], tv["vertical"]) == (380, 190)
    same = image_quality.psnr(df, df).first()
    assert same["psnr"] == math.inf
    parts = df.select("image", F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("x").alias("px"), F.col("y").alias("py"), "v")
    assert rows(raster.feather_blend(parts.unionByName(parts), 4, 2), "y", "x", "v") == rows(df, "y", "x", "v")


def test_quality_measures(spark):
    r = np.random.default_rng(0)
    a = r.integers(0, 256, (24, 24))
    rgb = pix(spark, a).select("image", "y", "x", F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b"))
    got = image_quality.no_reference(rgb, background=F.col("r") > 1000).first()
    x = a.ravel().astype(float)
    assert math.isclose(got["kurtosis_R"], ((x - x.mean()) ** 4).mean() / x.var() ** 2, rel_tol=1e-9)
    assert math.isclose(got["brightness_std"], x.std(), rel_tol=1e-9)  # nothing is background: all pixels
    assert math.isclose(image_quality.ssim(pix(spark, a), pix(spark, a)).first()["ssim"], 1.0)
    feats = image_quality.block_features(pix(spark, r.integers(0, 256, (96, 96))))
    assert len(feats.first()["features"]) == 36
    m, c = image_quality.moments(spark.createDataFrame([([1.0, 2.0],), ([3.0, 5.0],), ([float("nan"), 1.0],)], "features array<double>"))
    assert np.allclose(m, [2, 3.5]) and np.allclose(c, [[2, 3], [3, 4.5]])
    assert abs(image_quality.frechet(m, c, m, c)) < 1e-6


def test_blocks_are_cut_from_the_normalised_image(spark):
    img = np.random.default_rng(3).integers(0, 256, (200, 100)).astype(float)
    whole = image_quality.normalised_luma(img[:192, :96])
    got = image_quality.image_features(img)
    assert got.shape == (2, 36) and np.allclose(got[1, :18], image_quality.natural_features(whole[96:192, :96]))
    half = image_quality.normalised_luma(img[:192, :96].reshape(96, 2, 48, 2).mean((1, 3)))
    assert np.allclose(got[0, 18:], image_quality.natural_features(half[:48]))


def test_mean_row(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 3.0, 4.0)], "file string, x double, y double")
    assert {r["file"]: (r["x"], r["y"]) for r in image_quality.mean_row(df).collect()}["MEAN"] == (2.0, 4.0)


def test_ids_and_splits(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k int")
    got = datasets.dense_ids(df, ["k"]).collect()
    assert all(r["k"] == r["id"] for r in got) and len(got) == 101
    split = datasets.validation_split(df, "k")
    assert split.where("split = 'val'").count() == 10
    tiny = datasets.validation_split(df.limit(3), "k")
    assert tiny.where("split = 'val'").count() == 1
    draws = datasets.weighted_draws(spark.createDataFrame([("a", i) for i in range(90)] + [("b", i) for i in range(100, 110)], "cls string, k int"), 400, "k")
    share = draws.where("cls = 'b'").count() / 400
    assert 0.35 < share < 0.65


@pytest.mark.parametrize("partitions", [4, 211])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_dense_ids_keep_wide_rows(spark, partitions, adaptive):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 300_000
        df = spark.range(0, n, 1, 8).select((F.col("id") * 7919 % n).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("wide"))
        got = datasets.dense_ids(df, ["k"])
        assert got.agg(F.count(F.lit(1)), F.countDistinct("id"), F.count_if(F.col("id") != F.col("k")), F.countDistinct("wide")).first() == (n, n, 0, n)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_incremental(spark):
    work, done, need = (spark.createDataFrame([(i,) for i in ids], "k int") for ids in (range(6), (1, 2), (2, 3, 4)))
    assert rows(datasets.pending(work, done, "k", [need]), "k") == [(3,), (4,)]
    assert datasets.progress(work, done, "k").first().asDict() == {"processed": 2, "remaining": 4}
    assert rows(datasets.missing_members(work.select(F.col("k").cast("string").alias("k")), {"a": ["1", "9"]}, "k"), "split", "k") == [("a", "9")]


def test_early_stop(spark):
    vals = [0.1, 0.5, 0.5001, 0.4, 0.4, 0.9]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(vals)], "run string, epoch int, value double")
    assert tuple(datasets.early_stop(df, patience=3).first()) == ("r", 0.5, 1, 4)


def test_coco(spark):
    pages = spark.createDataFrame([("p", 700, 640)], "page string, width int, height int")
    b = spark.createDataFrame([("p", 0, 10, 10, 40, 50)], BOXES)
    images, notes = datasets.coco(pages, b)
    assert images.first()["file_name"] == "p_000.jpg"
    n = notes.first()
    assert (n["image_id"], list(n["bbox"]), n["area"], list(n["segmentation"][0])) == (0, [10, 10, 30, 40], 1200, [10, 10, 40, 10, 40, 50, 10, 50])


def test_required_columns(spark):
    with pytest.raises(ValueError, match="Width"):
        schemas.require_columns(spark.range(1).selectExpr("'a' AS Unicode"), ["Unicode", "Width"])


def test_resize_and_letterbox(spark):
    flat = pix(spark, np.full((6, 8), 77))
    got = raster.resize(flat, 6, 8, 3, 4)
    assert {round(r["v"], 6) for r in got.collect()} == {77.0} and got.count() == 12
    big = raster.letterboxed(flat, 6, 8, 16)
    assert big.count() == 256 and big.where("v = 255").count() == 256 - 16 * 12
    ramp = pix(spark, [[10 * x for x in range(8)]] * 4)
    up = {r["x"]: r["v"] for r in raster.resize(ramp, 4, 8, 4, 16).where("y = 1").collect()}
    assert abs(up[7] - 32.5) < 1e-6 and abs(up[8] - 37.5) < 1e-6


def test_degradations(spark):
    base = pix(spark, [[255, 0, 255, 255]])
    assert [r["v"] for r in raster.ghost(base, 1, 0.5).orderBy("x").collect()] == [255, 0, 127, 255]
    mask = spark.createDataFrame([("i", 0, 0, 255)], "image string, y int, x int, m int")
    assert [r["v"] for r in raster.blend(base, mask, 55, 0.5).orderBy("x").collect()] == [155, 0, 255, 255]
    assert [r["v"] for r in raster.inpainted(base, pix(spark, [[1, 2, 3, 4]]), mask).orderBy("x").collect()] == [1, 0, 255, 255]
    blobs = raster.blob_masks(base, 20, 20)
    assert 0 < blobs.count() <= 400 and sorted(blobs.collect()) == sorted(raster.blob_masks(base, 20, 20).collect())


def test_padding(spark):
    rgb = pix(spark, [[1, 2]]).select("image", "y", "x", *[F.col("v").alias(c) for c in "rgb"])
    colours = spark.createDataFrame([("i", 9, 8, 7)], "image string, r int, g int, b int")
    out = raster.padded(rgb, colours, 1, 2, 4)
    assert out.count() == 16 and out.where("r = 9 AND g = 8 AND b = 7").count() == 14


def test_selection_and_partners(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "Image string")
    assert datasets.selected_pages(df, "all").count() == 3 and rows(datasets.selected_pages(df, "a, ,c"), "Image") == [("a",), ("c",)]
    have, lack = datasets.with_text(df, df.limit(0).unionByName(spark.createDataFrame([("b",)], "Image string")), "Image")
    assert rows(have, "Image") == [("b",)] and rows(lack, "Image") == [("a",), ("c",)]
    assert datasets.random_partners(df, df, "Image").count() == 3


def test_inference_folders(spark):
    masks = spark.createDataFrame([("p1_mask.png", "/m/p1"), ("p2_mask.png", "/m/p2"), ("p3_mask.png", "/m/p3"), ("x.png", "/m/x")], "name string, path string")
    pages = spark.createDataFrame([("p1", "/i/p1"), ("p2", "/i/p2")], "stem string, path string")
    ready, missing = datasets.prepare_inference(masks, pages, spark.createDataFrame([("p2",)], "page string"), "_mask.png")
    assert rows(ready, "page", "image_path") == [("p1", "/i/p1")] and rows(missing, "page") == [("p3",)]


def test_pixels_to_images(spark):
    rgb = pix(spark, [[1, 2], [3, 300]]).select("image", "y", "x", F.col("v").alias("r"), F.lit(0).alias("g"), F.lit(9).alias("b"))
    got = raster.packed_images(rgb).first()
    assert (got["height"], got["width"]) == (2, 2) and bytes(got["data"]) == bytes([9, 0, 1, 9, 0, 2, 9, 0, 3, 9, 0, 255])


def test_backoff_search_against_all_sequences(spark):
    """The beam is as wide as there are sequences, so the best of all of them must come out; scores by the back-off rule."""
    import itertools

    texts = spark.createDataFrame([("abcab",), ("bcaac",), ("abb",), ("cab",)], "text string")
    table = lm.backoff_table(texts, 3)
    p = {(*r["ctx"], r["token"]): r["log10_p"] for r in table.collect()}
    b = {(*r["ctx"], r["token"]): r["log10_backoff"] for r in table.collect()}

    def score(history, token):
        context = tuple(history[-2:])
        if (*context, token) in p:
            return p[*context, token]
        if not context:
            return decode.FLOOR
        return b.get(context, 0.0) + (score(context[1:], token) if len(context) > 1 else p.get((token,), decode.FLOOR))

    r = random.Random(6)
    steps = [[(c, -r.random()) for c in "abcx"] for _ in range(4)]
    best = max((sum(q for _, q in seq) + 1.6 * sum(score((lm.BEGIN, *[c for c, _ in seq[:i]]), seq[i][0]) for i in range(4)), [c for c, _ in seq]) for seq in itertools.product(*steps))
    items = spark.createDataFrame([("p", i, [tuple(x) for x in s]) for i, s in enumerate(steps)], "page string, pos int, candidates array<struct<char:string,logp:double>>")
    got = decode.beam_search_backoff(items, table, 1.6, 256).first()
    assert got["seq"] == best[1] and math.isclose(got["score"], best[0], abs_tol=1e-9)
    with pytest.raises(ValueError):
        lm.backoff_model(table, most=3)


def test_reranking_on_whole_texts(spark):
    data = [("p", 0, [("a", -0.1), ("b", -0.2), ("b", -0.05)], "a"), ("p", 1, [("c", -1.0), ("d", -1.0)], "c"), ("p", 2, [("e", 0.0)], "z")]
    items = spark.createDataFrame(data, "page string, pos int, candidates array<struct<char:string,logp:double>>, greedy string")
    got = decode.masked_rerank_text(items, lambda: lambda text, at, char: {"bcz": 1.0, "acz": 0.0, "adz": 0.0}.get(text, -9.0), weight=0.5).orderBy("pos").collect()
    assert [(r["final"], r["score"]) for r in got] == [("b", 0.45), ("c", -1.0), ("z", -1e9)]
    encode = lambda s: [ord(c) - 97 for c in s for _ in range(1 + (c == "b"))]
    log_probs = lambda before, targets, after: [[-float(k + len(before) + 10 * len(after))] * 26 for k in range(len(targets))]
    assert decode.multi_mask_score(encode, log_probs, "axc", 1, "b") == -(11 + 12)
    assert decode.multi_mask_score(encode, log_probs, "axc", 3, "b") == decode.multi_mask_score(encode, log_probs, "axc", 0, "") == -1e9


def test_small_joins_and_names(spark):
    names = spark.createDataFrame([("module._orig_mod.a.w",), ("_orig_mod.module.b",), ("x.total_ops",), ("c",)], "name string")
    assert rows(datasets.parameter_names(names), "name") == [("a.w",), ("c",), ("module.b",)]
    files = spark.createDataFrame([("p_02_text_black.png",), ("p_fin.png",), ("p.png",)], "name string")
    assert rows(datasets.without_derived(files), "name") == [("p.png",)]
    examples = spark.createDataFrame([(1, [1, 2]), (2, [1, 2, 3]), (3, None)], "k int, ids array<int>")
    assert rows(datasets.long_enough(examples), "k") == [(2,)]
    one, two = (spark.createDataFrame(d, "name string, path string") for d in ([("a", "r/a"), ("b", "r/b")], [("a", "g/a")]))
    assert {tuple(r) for r in datasets.compared_files(one, two, two).select("name", "reference_path", "mask_path").collect()} == {("a", "g/a", "g/a"), ("b", None, None)}
    stems = [f.withColumnRenamed("name", "stem") for f in (one, two)]
    assert rows(datasets.training_pairs(*stems), "stem", "lq_path", "gt_path") == [("a", "r/a", "g/a")]
    pages = spark.createDataFrame([("b1", "p1"), ("b1", "p2"), ("b2", "p1")], "book_id string, page string")
    boxes = spark.createDataFrame([("b1", "p1", 0, 1, 2, 3, 4)], "book_id string, page string, idx int, x1 int, y1 int, x2 int, y2 int")
    got = {r["page"]: [tuple(b) for b in r["boxes"]] for r in datasets.boxes_of_books(spark.createDataFrame([("b1",)], "book_id string"), pages, boxes).collect()}
    assert got == {"p1": [(0, 1, 2, 3, 4)], "p2": []}
    assert tiling.fixed_cut(pages.limit(1)).count() == 121
