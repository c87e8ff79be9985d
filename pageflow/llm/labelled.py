"""Bounded samples of labelled documents, and a logistic regression on sparse rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, written


#: Bytes of the longest text that a model learns from (all are scored), and of the texts that it learns from together.
MAX_TEXT, MAX_BYTES = 256 << 10, 48 << 20


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, y (0 or 1) and weight (how many labelled rows of its class a row stands for) of at most about ``most``
    labelled training documents of each class, and at most about ``MAX_BYTES`` of text, picked by a hash of their ids.
    Texts above ``MAX_TEXT`` bytes are not learnt from. The picked ids, so bounded, are broadcast, and no text is moved.
    Labels that are null or given twice for a document with different values are left out. Written."""
    marks = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_y")).where("y = _y").drop("_y")
    marks = marks.where(~held_out())
    counts = {r[0]: r[1] for r in marks.groupBy("y").count().collect()}  # two rows
    rate = F.when(F.col("y") == 1, F.lit(most / max(counts.get(1, 0), 1))).otherwise(F.lit(most / max(counts.get(0, 0), 1)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    picked = marks.where(place < rate)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= MAX_TEXT)
    made = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", F.col("y").cast("int").alias("y"), F.greatest(F.lit(1.0), 1 / rate).alias("weight"))
    sample = written(made, "labelled-sample")
    size = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= MAX_BYTES:
        return sample
    share = MAX_BYTES / size
    return sample.where(place < F.least(F.lit(1.0), 1 / F.col("weight")) * share).withColumn("weight", F.col("weight") / share)


def fit_logistic(start: np.ndarray, index: np.ndarray, value: np.ndarray, n_features: int, y: np.ndarray, weight: np.ndarray, l2: float, rounds: int = 60) -> np.ndarray:
    """Weights and, last, the intercept, by limited-memory quasi-Newton steps. Row i has the entries start[i]:start[i+1]."""
    row = np.repeat(np.arange(len(y)), np.diff(start))
    sign = np.where(y > 0, 1.0, -1.0)

    def loss(w):
        margin = sign * (np.bincount(row, weights=w[index] * value, minlength=len(y)) + w[-1])
        g = -sign * weight / (1 + np.exp(np.clip(margin, -500, 500)))
        grad = np.bincount(index, weights=g[row] * value, minlength=n_features + 1).astype(float)  # whole numbers if there is no feature
        grad[:-1] += l2 * w[:-1]
        grad[-1] = g.sum()
        return float((weight * np.logaddexp(0, -margin)).sum() + 0.5 * l2 * (w[:-1] ** 2).sum()), grad

    w = np.zeros(n_features + 1)
    f, g = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, alphas = -g.copy(), []
        for s, t in reversed(pairs):
            a = s @ d / (s @ t)
            d -= a * t
            alphas.append(a)
        d *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(np.abs(g).max(), 1e-12)
        for (s, t), a in zip(pairs, reversed(alphas), strict=True):
            d += s * (a - t @ d / (s @ t))
        step, slope = 1.0, g @ d
        while True:
            new = w + step * d
            f_new, g_new = loss(new)
            if f_new <= f + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, t = new - w, g_new - g
        if s @ t > 1e-12:
            pairs = [*pairs[-7:], (s, t)]
        done = abs(f - f_new) < 1e-6 * max(1.0, abs(f))
        w, f, g = new, f_new, g_new
        if done:
            break
    return w
