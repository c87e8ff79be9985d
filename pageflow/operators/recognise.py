"""Cosine classification of embeddings against class weights, and top-k candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import dot, let, log_softmax, norm

#: Classes up to which their weights travel as one broadcast row.
MAX_CLASSES = 20_000


def class_weights(embeddings: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean vector of each label, coordinate by coordinate: no vector is gathered in one place."""
    each = embeddings.select(label, F.posexplode(vector).alias("k", "v"))
    means = each.groupBy(label, "k").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("weight"))


def topk_candidates(embeddings: DataFrame, weights: DataFrame, k: int = 5, scale: float = 16.0) -> DataFrame:
    """Adds ``topk``: the k best classes with log-probabilities. All class weights are one broadcast row (a bounded
    number of classes is checked), so embeddings stay where they are."""
    n = weights.count()
    if n > MAX_CLASSES:
        raise ValueError(f"{n} classes; at most {MAX_CLASSES} can be broadcast")
    one = weights.withColumn("norm", F.greatest(norm(F.col("weight")), F.lit(1e-12))).agg(F.sort_array(F.collect_list(F.struct("label", "weight", "norm"))).alias("_w"))
    joined = embeddings.crossJoin(F.broadcast(one))
    size = let(norm(F.col("embedding")), lambda n: F.greatest(n, F.lit(1e-12)))
    logits = let(size, lambda n: F.transform("_w", lambda w: scale * dot(F.col("embedding"), w["weight"]) / (n * w["norm"])))

    def best(logp: Column) -> Column:
        entry = F.transform(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.struct((-F.get(logp, i)).alias("neg"), F.get(F.col("_w"), i)["label"].alias("class_id")))
        return F.transform(F.slice(F.array_sort(entry), 1, k), lambda s: F.struct(s["class_id"].alias("class_id"), (-s["neg"]).alias("logp")))

    return joined.withColumn("topk", let(log_softmax(logits), best)).drop("_w")


def topk_matrix(embeddings: DataFrame, weights: DataFrame, k: int = 5, scale: float = 16.0) -> DataFrame:
    """The same by matrix products on Arrow batches, for many classes: id columns and topk."""
    import numpy as np

    rows = sorted((r["label"], r["weight"]) for r in weights.limit(MAX_CLASSES + 1).collect())
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    labels, matrix = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    sent = embeddings.sparkSession.sparkContext.broadcast((labels, matrix.T))
    keep = [c for c in embeddings.columns if c != "embedding"]

    def run(frames):
        import pandas as pd

        names, w = sent.value
        for pdf in frames:
            x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, w.shape[0]))
            z = scale * (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)) @ w
            z -= z.max(1, keepdims=True) if len(z) else 0
            z -= np.log(np.exp(z).sum(1, keepdims=True))
            order = np.argsort(-z, axis=1, kind="stable")[:, :k]
            top = [[{"class_id": int(names[c]), "logp": float(z[i, c])} for c in row] for i, row in enumerate(order)]
            yield pd.DataFrame({c: pdf[c] for c in keep} | {"topk": top})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in embeddings.schema if f.name in keep)
    return embeddings.mapInPandas(run, f"{schema}, topk array<struct<class_id:int,logp:double>>")


def with_characters(items: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds ``candidates`` (char, logp) from ``topk``; unknown classes are ``?``. The class list is one broadcast map."""
    names = classes.agg(F.map_from_entries(F.collect_list(F.struct("class_id", "char"))).alias("_names"))
    named = F.transform("topk", lambda t: F.struct(F.coalesce(F.element_at(F.col("_names"), t["class_id"]), F.lit("?")).alias("char"), t["logp"].alias("logp")))
    return items.crossJoin(F.broadcast(names)).withColumn("candidates", named).drop("_names")
