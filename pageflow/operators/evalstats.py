"""Accuracy of decoded characters: one row for each character (page, pos, gt, greedy, lm, final, topk_chars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import safe_ratio

G, L, E = F.col, F.lit, F.expr


def align(ordered: DataFrame, truth: DataFrame, page: str = "page") -> DataFrame:
    """Boxes in reading order joined with the characters of their page by position, for pages where both have as many."""
    counts = ordered.groupBy(page).agg(F.count(F.lit(1)).alias("_b")).join(truth.groupBy(page).agg(F.count(F.lit(1)).alias("_t")), page).where("_b = _t").select(page)
    return ordered.join(counts, page, "left_semi").join(truth, [page, "pos"])


def page_status(pages: DataFrame, boxes: DataFrame, truth: DataFrame, page: str = "page") -> DataFrame:
    """page, n_boxes, n_chars, and status: no_text, no_boxes, length_mismatch or evaluated."""
    b = boxes.groupBy(page).agg(F.count(F.lit(1)).alias("n_boxes"))
    t = truth.groupBy(page).agg(F.count(F.lit(1)).alias("n_chars"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    both = pages.select(page).distinct().join(b, page, "left").join(t, page, "left").select(page, zero("n_boxes").alias("n_boxes"), zero("n_chars").alias("n_chars"))
    status = F.when(F.col("n_chars") == 0, "no_text").when(F.col("n_boxes") == 0, "no_boxes").when(F.col("n_boxes") != F.col("n_chars"), "length_mismatch").otherwise("evaluated")
    return both.withColumn("status", status)


def accuracy(decoded: DataFrame, keys: list[str] | None = None) -> DataFrame:
    rate = lambda c: F.coalesce(F.avg((F.col(c) == F.col("gt")).cast("int")), F.lit(0.0)).alias(f"{c}_acc")
    return decoded.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n"), *[rate(c) for c in ("greedy", "lm", "final") if c in decoded.columns])


def outcome(greedy: str = "greedy", final: str = "final"):
    """ok, fix, worse or bothx, by whether the greedy and the final character are right."""
    g, f = F.col(greedy) == F.col("gt"), F.col(final) == F.col("gt")
    return F.when(g & f, "ok").when(~g & f, "fix").when(g & ~f, "worse").otherwise("bothx")


def outcome_tally(decoded: DataFrame) -> DataFrame:
    """One row: total, ok, fix, worse, bothx, and the share of greedy errors that were mended."""
    out = decoded.withColumn("_o", outcome()).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("_o") == o).alias(o) for o in ("ok", "fix", "worse", "bothx")])
    return out.withColumn("repair_rate", safe_ratio(F.col("fix"), F.col("fix") + F.col("bothx")))


def oracle_hit(k: int):
    return F.array_contains(F.slice("topk_chars", 1, k), F.col("gt"))


def oracle_at_k(decoded: DataFrame, ks: list[int]) -> DataFrame:
    parts = [decoded.agg(F.lit(k).alias("k"), F.count_if(oracle_hit(k)).alias("hits"), F.count(F.lit(1)).alias("total")) for k in ks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("rate", safe_ratio(F.col("hits"), F.col("total")))


def char_stats(decoded: DataFrame, k: int = 5, min_count: int = 1) -> DataFrame:
    """Per true character: outcomes, errors by stage, oracle hits and their rates; frequent and error-prone ones first."""
    n = F.count(F.lit(1))
    wrong = lambda c: F.count_if(F.col(c) != F.col("gt"))
    rows = decoded.withColumn("_o", outcome()).groupBy(F.col("gt").alias("char_gt")).agg(
        n.alias("count"), *[F.count_if(F.col("_o") == o).alias(o) for o in ("ok", "fix", "worse", "bothx")],
        wrong("greedy").alias("greedy_err"), wrong("lm").alias("kenlm_err"), wrong("final").alias("final_err"), F.count_if(oracle_hit(k)).alias("oracle_in_topK"),
    ).where(F.col("count") >= min_count)
    rate = lambda a, b="count": safe_ratio(F.col(a), F.col(b))
    return rows.withColumns({
        "greedy_miss_rate": rate("greedy_err"), "kenlm_miss_rate": rate("kenlm_err"), "final_miss_rate": rate("final_err"), "oracle_rate": rate("oracle_in_topK"),
        "fix_rate_total": rate("fix"), "worse_rate_total": rate("worse"), "bothx_rate_total": rate("bothx"), "repair_rate_char": safe_ratio(F.col("fix"), F.col("fix") + F.col("bothx")),
    }).orderBy(F.desc("count"), F.desc("final_miss_rate"), "char_gt")


def confusion(decoded: DataFrame, stage: str = "final", min_pair: int = 1, n: int = 50, order: list[str] | None = None) -> DataFrame:
    """The most frequent (gt, pred) pairs, first seen first on ties."""
    seen = F.min(F.struct(*(order or ["page", "pos"]))).alias("_seen")
    pairs = decoded.groupBy("gt", F.col(stage).alias("pred")).agg(F.count(F.lit(1)).alias("count"), seen).where(F.col("count") >= min_pair)
    return pairs.orderBy(F.desc("count"), "_seen").limit(n).select("gt", "pred", "count", (F.col("gt") == F.col("pred")).cast("int").alias("is_correct"))


def annotations(decoded: DataFrame) -> DataFrame:
    """What an overlay draws: label of greedy, true, LM and final character, and a colour by outcome."""
    colour = F.when(F.col("_o") == "fix", "green").when(F.col("_o") == "worse", "red").when(F.col("_o") == "bothx", "yellow").otherwise("grey")
    return decoded.withColumn("_o", outcome()).withColumns({"label": F.concat("greedy", "gt", "lm", "final"), "colour": colour}).drop("_o")


def text_check(boxes: DataFrame, texts: DataFrame, target: str = "?", page: str = "page") -> DataFrame:
    """Pages that have both boxes and a text (page, text): bbox_n, gt_n (characters of the text without white
    space), target_n, diff, status, and why a text counts as blank, else null."""
    from ..functions import text as T

    line = T.strip_white_space(F.col("text"))
    reason = F.when(F.col("text") == "", "size==0").when(T.strip_invisible(F.col("text")) == "", "only_whitespace/invisible")
    counted = texts.select(page, F.length(line).cast("long").alias("gt_n"), T.count_of(line, target).alias("target_n"), reason.alias("blank_reason"))
    both = boxes.groupBy(page).agg(F.count(F.lit(1)).alias("bbox_n")).join(counted, page)
    return both.withColumns({"diff": F.col("bbox_n") - F.col("gt_n"), "status": F.when(F.col("bbox_n") == F.col("gt_n"), "OK").otherwise("NG")})


def text_check_totals(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count_if(F.col("status") == "OK").alias("matched"), F.count_if(F.col("status") == "NG").alias("mismatched"), F.count_if(F.col("target_n") > 0).alias("target_pages"),
        F.coalesce(F.sum("target_n"), F.lit(0)).cast("long").alias("targets"), F.count_if(F.col("blank_reason").isNotNull()).alias("blank_pages"),
    )
