"""End-to-end jobs: a page to characters, an evaluation with language models, and batch statistics with a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import confidence, decode, detect, evalstats, layout, recognise, scorers
from ..sources import readers, sinks

#: Recommended settings of the evaluation: candidates, beam, weights of the n-gram and the masked model, passes.
DEFAULTS = {"topk": 5, "beam": 5, "lm_weight": 1.6, "mlm_weight": 0.8, "passes": 1}


def crops(pages: DataFrame, boxes: DataFrame, min_side: int = 2) -> DataFrame:
    """Clamped boxes (page, idx, x1, y1, x2, y2, score) of pages (page, width, height) as named crops. Names keep the
    index from before small ones go."""
    sized = boxes.join(pages, "page")
    c = geometry.clamp_box(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("width"), F.col("height"))
    named = sized.select("page", F.format_string("char_%04d.png", F.col("idx")).alias("char_id"), c["x1"].alias("x"), c["y1"].alias("y"), (c["x2"] - c["x1"]).alias("width"), (c["y2"] - c["y1"]).alias("height"), "score")
    return named.where((F.col("width") >= min_side) & (F.col("height") >= min_side))


def pages_to_characters(pages: DataFrame, detections: DataFrame, load_recogniser: Callable | None = None) -> DataFrame:
    """Tile detections to crops with a character and its confidence (null without a recogniser)."""
    merged = detect.merge_tiles(detections.join(pages.select("page", "width", "height"), "page"), width=F.col("width"), height=F.col("height")) if "width" in detections.columns else detect.merge_tiles(detections)
    numbered = merged.withColumn("idx", F.row_number().over(_by_page()) - 1)
    cut = crops(pages, numbered)
    if load_recogniser is None:
        return cut.withColumns({"unicode": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", candidates array<struct<char:string,logp:double>>"
    read = scorers.apply_model(cut, "recogniser", load_recogniser, schema)
    best = F.get("candidates", F.lit(0))
    return read.withColumns({"unicode": best["char"], "confidence": F.exp(best["logp"])}).drop("candidates")


def _by_page():
    from pyspark.sql import Window

    return Window.partitionBy("page").orderBy(F.desc("score"), "x1", "y1")


def evaluate(boxes: DataFrame, truth: DataFrame, bigrams: DataFrame, masked_scorer: Callable[[DataFrame], DataFrame], settings: dict | None = None) -> DataFrame:
    """Boxes with candidates (page, idx, corners, candidates) and true characters (page, pos, gt) to one row a character:
    page, pos, gt, greedy, lm, final, topk_chars. ``bigrams`` may be a back-off table of any order instead. The page is the
    partition key throughout."""
    s = DEFAULTS | (settings or {})
    ordered = layout.reading_order(boxes)
    items = decode.greedy(evalstats.align(ordered, truth).withColumn("candidates", F.slice("candidates", 1, s["topk"])))
    search = decode.beam_search_backoff if "log10_backoff" in bigrams.columns else decode.beam_search
    best = search(items, bigrams, s["lm_weight"], s["beam"]).select("page", F.posexplode("seq").alias("_i", "lm"))
    # The beam's sequence is in the order of positions, which may have gaps only if boxes do: join by rank.
    from pyspark.sql import Window

    ranked = items.withColumn("_i", F.row_number().over(Window.partitionBy("page").orderBy("pos")) - 1).join(best, ["page", "_i"]).drop("_i")
    final = decode.masked_rerank(ranked, masked_scorer, s["mlm_weight"], s["passes"], current="lm")
    return final.select("page", "pos", "gt", "greedy", "lm", "final", F.transform("candidates", lambda c: c["char"]).alias("topk_chars"))


def batch_report(spark: SparkSession, results: str, out: str) -> None:
    """Statistics of recognition files: a JSON document and a Markdown report. The files are scanned once."""
    rec = readers.recognitions(spark, results).select("folder", "pos", "char", "prob").cache()
    try:
        confidence.report(rec).coalesce(1).write.mode("overwrite").text(f"{out}/report")
        sinks.markdown_report(confidence.summary(rec), confidence.histogram(rec), confidence.largest_folders(rec), confidence.most_common(rec, 30, ["folder", "pos"]), f"{out}/markdown", "overwrite")
    finally:
        rec.unpersist()


def classify(embeddings: DataFrame, classes: DataFrame, weights: DataFrame, k: int = 5) -> DataFrame:
    """Embeddings to characters: cosine candidates by class, then names."""
    return recognise.with_characters(recognise.topk_candidates(embeddings, weights, k), classes)
