"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts are read as lower-cased bytes with everything but letters as spaces. The features of a text are the distinct hashed
n-grams of ``ORDERS`` bytes that it has anywhere. From labelled training texts come the ratios r of a feature's smoothed
document counts in toxic and other texts; the features with the largest evidence stay, x is scaled by r, and a logistic
regression on x * r gives the weights. A text's score is the logistic function of the sum of its features' weights.

The fit reads at most about ``MAX_PER_CLASS`` labelled documents a class (``labelled`` bounds their bytes too), each with
the weight of the labelled rows it stands for. Features of equal evidence are taken by number. Nulls and empty texts have
no feature and so the score of the intercept. Very long texts are scored whole, alone in memory. Rows that repeat are
scored each; extra columns are ignored. An empty table gives an empty table. Without training rows of both classes every
score is the share of toxic labels seen (0 for none).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .labelled import fit_logistic, training_sample
from .langid import padded
from .textvec import buffers, mix, prefix_hash, powers, slices

MAX_PER_CLASS = 4000
ORDERS = (4, 5, 6)
BUCKET_BITS = 20
MAX_FEATURES = 20_000
MIN_DOCS = 3
THRESHOLD = 0.5
L2 = 1.0


def _gram_buckets(text: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram from every position on."""
    prefix = prefix_hash(text)
    _, inv = powers(len(prefix))
    out = []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(text) >= n:
                out.append((mix((prefix[n:] - prefix[:-n]) * inv[: len(text) - n + 1]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
            else:
                out.append(np.zeros(0, np.int32))
    return out


class Features:
    """The distinct features of texts; with ``keep``, only those of the buckets it marks."""

    def __init__(self, keep: np.ndarray | None = None):
        self.keep, self.last = keep, np.full(1 << BUCKET_BITS, -1, np.int32)

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """For each text of the slice, its distinct buckets."""
        text, at = padded(data, offsets)
        grams = _gram_buckets(text)
        kept = [np.flatnonzero(self.keep[g]) for g in grams] if self.keep is not None else None
        for i in range(len(offsets) - 1):
            a, b = int(at[i]) - 1, int(at[i + 1])  # with the spaces around
            parts = []
            for k, (n, g) in enumerate(zip(ORDERS, grams, strict=True)):
                if kept is None:
                    parts.append(g[a : max(a, b - n + 1)])
                else:
                    x, y = np.searchsorted(kept[k], (a, max(a, b - n + 1)))
                    parts.append(g[kept[k][x:y]])
            own = np.concatenate(parts)
            order = np.arange(len(own), dtype=np.int32)
            self.last[own] = order  # the last writer of a bucket stands for it
            yield own[self.last[own] == order]


class Model:
    def __init__(self, weight: np.ndarray, intercept: float):
        self.weight, self.intercept = weight, intercept


def _featured(sample: DataFrame, keep: np.ndarray | None) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        make = Features(keep)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            y = batch.column("y").to_pylist()
            for i, j in slices(offsets):
                own = [x.astype("<i4").tobytes() for x in make(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
                yield pa.RecordBatch.from_pydict({"y": pa.array(y[i:j], pa.int32()), "x": pa.array(own, pa.binary())})

    return sample.select("text", "y").mapInArrow(run, "y int, x binary")


def _counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each class (n x 2) and of all, by bucket."""
    size = 1 << BUCKET_BITS

    def add(batches):
        import pyarrow as pa

        total = np.zeros((size, 2), np.int64)
        for b in batches:
            data, offsets = buffers(b.column("x"))
            y = b.column("y").to_numpy().astype(np.int64)
            total += np.bincount(data.view("<i4").astype(np.int64) * 2 + np.repeat(y, np.diff(offsets) // 4), minlength=2 * size).reshape(size, 2)
        at = np.flatnonzero(total.sum(1))
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "neg": pa.array(total[at, 0], pa.int64()), "pos": pa.array(total[at, 1], pa.int64())})

    out = np.zeros((size, 2))
    common = _featured(sample, None).coalesce(4).mapInArrow(add, "at long, neg long, pos long").groupBy("at").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).where(F.col("neg") + F.col("pos") >= MIN_DOCS)
    got = common.toArrow()  # at most a row for each bucket
    at = got.column("at").to_numpy()
    out[at, 0], out[at, 1] = got.column("neg").to_numpy(), got.column("pos").to_numpy()
    return out


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    sample = training_sample(docs, labels, label, MAX_PER_CLASS)
    size = {r[0]: (r[1], r[2]) for r in sample.groupBy("y").agg(F.count(F.lit(1)), F.sum("weight")).collect()}  # two rows
    n = np.array([size.get(k, (0, 0))[0] for k in (0, 1)], float)
    full = np.array([size.get(k, (0, 0))[1] for k in (0, 1)], float)  # the labelled rows that the sample stands for
    weight = np.zeros(1 << BUCKET_BITS, np.float32)
    if not n.all():
        share = np.clip(full[1] / max(full.sum(), 1), 1e-6, 1 - 1e-6)
        return Model(weight, float(np.log(share / (1 - share))))
    counts = _counts(sample)
    smoothed = (counts + 0.5) / (n + 1)
    ratio = np.log(smoothed[:, 1] / smoothed[:, 0])
    # Evidence: how much a feature's presence tells in the documents that have it.
    evidence = np.where(counts.sum(1) >= MIN_DOCS, np.abs(smoothed[:, 1] - smoothed[:, 0]) / np.sqrt(smoothed.sum(1) / n.sum()), 0)
    chosen = np.sort(np.argsort(-evidence, kind="stable")[:MAX_FEATURES])
    chosen = chosen[evidence[chosen] > 0]
    keep = np.zeros(1 << BUCKET_BITS, bool)
    keep[chosen] = True
    number = np.zeros(1 << BUCKET_BITS, np.int32)
    number[chosen] = np.arange(len(chosen), dtype=np.int32)
    y, start, index = [], [0], []
    for row in _featured(sample, keep).toLocalIterator():  # bounded: MAX_PER_CLASS texts a class, MAX_FEATURES each
        x = number[np.frombuffer(row["x"], "<i4")]
        y.append(row["y"])
        index.append(x)
        start.append(start[-1] + len(x))
    y, index = np.array(y), np.concatenate(index)
    # A row counts for the labelled rows that it stands for, so the odds that the fit sees don't depend on the sample.
    stands_for = np.where(y > 0, full[1] / n[1], full[0] / n[0])
    weight_of = np.where(y > 0, np.sqrt(full[0] / full[1]), 1.0) * stands_for
    w = fit_logistic(np.array(start), index, ratio[chosen][index], len(chosen), y, weight_of * len(y) / full.sum(), L2)
    weight[chosen] = w[:-1] * ratio[chosen]
    return Model(weight, float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weight, model.intercept))

    def run(batches):
        import pyarrow as pa

        weight, intercept = sent.value
        make = Features(weight != 0)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                sums = [float(weight[x].sum(dtype=np.float64)) for x in make(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
                p = 1 / (1 + np.exp(-np.clip(np.array(sums) + intercept, -500, 500)))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(i, j - i).cast(pa.int64()),
                    "held_out": batch.column("held_out").slice(i, j - i),
                    "score": pa.array(p, pa.float64()),
                    "predicted": pa.array((p >= THRESHOLD).astype(np.int32), pa.int32()),
                })

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))
