"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes that cover its whole text. A passage is encoded from its hashed byte
pairs and triples, and from how varied they are, by a learned layer; a gated attention (tanh times sigmoid) gives every passage a weight within its
document; the weighted sum of the encodings is scored by a logistic unit. All layers are learned together from document
labels alone, by mini-batch gradient steps on at most about ``MAX_PER_CLASS`` labelled documents a class.

A null or empty text is one empty passage. Very long texts are encoded whole, a piece at a time, and pooled over all their
passages. Rows that repeat are scored each, equal texts alike; extra columns are ignored by ``quality`` and kept by
``keep_good``. An empty table gives an empty table. Without training rows of both classes every score is the share of good
labels seen (1 for none).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .labelled import training_sample
from .textvec import SLICE_BYTES, buffers, slices

MAX_PER_CLASS = 2500
PASSAGE = 512
BUCKETS, STATS = 1024, 8
WIDTH = BUCKETS + STATS
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE = 16, 32, 0.006
#: Counts that a passage is taken to have beyond its own, so that short passages tell less.
PRIOR = 100
THRESHOLD = 0.3


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (n x WIDTH, no entry above 1) and the number of each text's passages."""
    size = np.diff(offsets)
    n = np.maximum(-(-size // PASSAGE), 1)
    first = np.cumsum(n) - n
    of_byte = np.repeat(first, size) + (np.arange(len(data)) - np.repeat(offsets[:-1], size)) // PASSAGE
    wide = data.astype(np.uint32)
    out = np.zeros((int(n.sum()), WIDTH), np.float32)
    stats = out[:, BUCKETS:]
    half = BUCKETS // 2
    shift = np.uint32(32 - (half.bit_length() - 1))
    for k, width in enumerate((2, 3)):
        if len(data) < width:
            continue
        code = wide[: len(data) - width + 1].copy()
        for j in range(1, width):
            code = (code << np.uint32(8)) | wide[j : len(data) - width + 1 + j]
        bucket = ((code * np.uint32(2654435761)) >> shift).astype(np.int64)
        same = of_byte[: len(bucket)] == of_byte[width - 1 :]
        counts = np.bincount(of_byte[: len(bucket)][same] * half + bucket[same], minlength=len(out) * half)
        counts = counts.reshape(len(out), half).astype(np.float32)
        total = counts.sum(1)
        stats[:, 3 * k] = (counts > 0).sum(1) / (total + 1)
        stats[:, 3 * k + 1] = np.sqrt((counts**2).sum(1)) / (total + 1)
        stats[:, 3 * k + 2] = counts.max(1) / (total + 1)
        out[:, k * half : (k + 1) * half] = np.sqrt(counts / (2 * total[:, None] + PRIOR))
    capital = (data >= 0x41) & (data <= 0x5A)
    size_of = np.bincount(of_byte, minlength=len(out)).astype(np.float32)
    stats[:, 6] = np.bincount(of_byte[capital], minlength=len(out)) / (size_of + 1)
    stats[:, 7] = size_of / PASSAGE
    return out, n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Net:
    """encode (w, b), attend (v, u, a), decide (c, d)."""

    NAMES = ("w", "b", "v", "u", "a", "c", "d")

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, seed: int = 7) -> "Net":
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        return cls({"w": 6 * g(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": g(HIDDEN, GATE), "u": g(HIDDEN, GATE), "a": g(GATE, 1)[:, 0], "c": g(HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32)})

    def forward(self, x: np.ndarray, n: np.ndarray):
        p, first = self.p, np.cumsum(n) - n
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * s) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        att = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(att[:, None] * h, first, axis=0)
        return h, t, s, att, z, _sigmoid(z @ p["c"] + p["d"][0])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of texts; of a text longer than a slice only encodings and attention are held, not its features."""
        p = self.p
        if len(offsets) != 2 or len(data) <= SLICE_BYTES:
            return self.forward(*passages(data, offsets))[-1].astype(np.float64)
        hs, es = [], []
        for a in range(0, len(data), SLICE_BYTES):  # a multiple of PASSAGE, and no feature crosses passages
            own = data[a : a + SLICE_BYTES]
            x, _ = passages(own, np.array([0, len(own)]))
            h = np.tanh(x @ p["w"] + p["b"])
            hs.append(h)
            es.append((np.tanh(h @ p["v"]) * _sigmoid(h @ p["u"])) @ p["a"])
        e = np.concatenate(es)
        e = np.exp(e - e.max())
        return np.array([_sigmoid((e / e.sum()) @ np.concatenate(hs) @ p["c"] + p["d"][0])], np.float64)

    def gradient(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, np.cumsum(n) - n
        h, t, s, att, z, score = self.forward(x, n)
        go = (weight * (score - y)).astype(np.float32)
        gz = np.repeat(go[:, None] * p["c"], n, axis=0)
        gh, ga = att[:, None] * gz, (gz * h).sum(1)
        ge = att * (ga - np.repeat(np.add.reduceat(att * ga, first), n))
        gt, gs = ge[:, None] * p["a"] * s * (1 - t**2), ge[:, None] * p["a"] * t * s * (1 - s)
        gh = (gh + gt @ p["v"].T + gs @ p["u"].T) * (1 - h**2)
        return {"w": x.T @ gh, "b": gh.sum(0), "v": h.T @ gt, "u": h.T @ gs, "a": (t * s).T @ ge, "c": z.T @ go, "d": np.array([go.sum()], np.float32)}


def fit(x: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Net:
    """``x``: passage features of all documents one after the other, as bytes of at most 255."""
    net, r = Net.fresh(seed), np.random.default_rng(seed)
    first = np.cumsum(n) - n
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    epochs = max(EPOCHS, -(-2000 // max(1, len(y) // BATCH)) if len(y) < 2000 else 0)
    for _ in range(min(epochs, 60)):
        order = r.permutation(len(y))
        for a in range(0, len(y), BATCH):
            own = order[a : a + BATCH]
            rows = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in own])
            g = net.gradient(x[rows].astype(np.float32) / 255, n[own], y[own], weight[own] / len(own))
            step += 1
            for k, v in g.items():
                v = v + 1e-4 * net.p[k]
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.001 * (v * v - s[k])
                net.p[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Net | float:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ids, y, weight = (batch.column(c).to_pylist() for c in ("doc_id", "y", "weight"))
            for i, j in slices(offsets):
                x, n = passages(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                x = np.minimum(np.round(x * 255), 255).astype(np.uint8)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[i:j], pa.int64()), "y": pa.array(y[i:j], pa.int32()), "weight": pa.array(weight[i:j], pa.float64()), "x": pa.array([x[b - k : b].tobytes() for b, k in zip(ends, n, strict=True)], pa.binary())})

    rows = sorted(((r["doc_id"], r["y"], r["x"], r["weight"]) for r in training_sample(docs, labels, label, MAX_PER_CLASS).mapInArrow(run, "doc_id long, y int, weight double, x binary").toLocalIterator()), key=lambda r: r[:2])
    y = np.array([r[1] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 1.0
    n = np.array([len(r[2]) // WIDTH for r in rows], np.int64)
    x = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, WIDTH)
    weight = np.array([r[3] for r in rows], np.float32)
    del rows
    return fit(x, n, y, weight / weight.mean())


def score(docs: DataFrame, net: Net | float) -> DataFrame:
    """All columns of ``docs``' ids: doc_id, held_out, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net if isinstance(net, float) else net.p)

    def run(batches):
        import pyarrow as pa

        own = sent.value if isinstance(sent.value, float) else Net(sent.value)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                if isinstance(own, float):
                    p = np.full(j - i, own)
                else:
                    p = own.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(i, j - i).cast(pa.int64()),
                    "held_out": batch.column("held_out").slice(i, j - i),
                    "score": pa.array(p, pa.float64()),
                    "predicted": pa.array((p >= THRESHOLD).astype(np.int32), pa.int32()),
                })

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns; texts are scored where they are."""
    net = learn(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(net if isinstance(net, float) else net.p)

    def run(batches):
        import pyarrow as pa

        own = sent.value if isinstance(sent.value, float) else Net(sent.value)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            good = []
            for i, j in slices(offsets):
                p = np.full(j - i, own) if isinstance(own, float) else own.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                good += (p >= THRESHOLD).tolist()
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
