"""Language identification of mixed-language text.

The script of a word (by ranges of code points) leaves only the languages that were seen in that script. Every word gets
a score under each remaining language: the log-likelihood of its byte trigrams, word boundaries among them. A Viterbi
pass over the words of a text, with a penalty for every switch, labels spans; the language that covers the most bytes of
words is the text's, and its share of them is the score.

Trigram counts are learned from at most about ``MAX_DOCS_PER_LANG`` documents a language, picked by a hash of their ids.
Null texts and texts without a letter are ``und`` with score 0. Rows that repeat are labelled each; extra columns are
ignored. Equal shares go to the alphabetically first language. Without any training row all texts are ``und``.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .textvec import LOWER, WORD_ALNUM, buffers, slices, words

MAX_DOCS_PER_LANG = 4000
BUCKET_BITS = 18
SWITCH_PENALTY = 12.0
SMOOTHING = 0.2
#: Trigrams count as evidence at this rate, as they overlap.
TEMPER = 0.7
SLICE = 4 << 20

# First code points of script ranges, and the scripts' names.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_STARTS = np.array([a for a, _ in SCRIPT_RANGES])
_SCRIPT_OF = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[WORD_ALNUM] = LOWER[WORD_ALNUM]
_LETTERS[0x30:0x3A] = 0x20
_IS_LETTER = _LETTERS != 0x20


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with everything but letters as spaces and a space before, between and after texts; new offsets."""
    out = np.full(len(data) + len(offsets), 0x20, np.uint8)
    shift = np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    out[np.arange(len(data)) + shift] = _LETTERS[data]
    return out, offsets + np.arange(1, len(offsets) + 1)


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the three bytes from each position on."""
    wide = data.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def word_scripts(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Script of each word's first character."""
    b = [data[np.minimum(start + k, len(data) - 1)].astype(np.int64) for k in range(4)]
    tail = [x & 0x3F for x in b]
    point = np.select([b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0], [b[0], ((b[0] & 0x1F) << 6) | tail[1], ((b[0] & 0x0F) << 12) | (tail[1] << 6) | tail[2]], ((b[0] & 0x07) << 18) | (tail[1] << 12) | (tail[2] << 6) | tail[3])
    return _SCRIPT_OF[np.searchsorted(_STARTS, point, side="right") - 1]


def sample(docs: DataFrame) -> DataFrame:
    """At most about MAX_DOCS_PER_LANG training documents of each language."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rate = (F.lit(1e6 * MAX_DOCS_PER_LANG) / F.col("n")).alias("rate")
    return known.join(F.broadcast(counts.select("lang", rate)), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("rate")).select("lang", "text")


class Model:
    """log_prob: languages x buckets; allowed: scripts x languages."""

    def __init__(self, langs: list[str], log_prob: np.ndarray, allowed: np.ndarray):
        self.langs, self.log_prob, self.allowed = langs, log_prob, allowed


def learn(docs: DataFrame) -> Model:
    def count(batches):
        import pyarrow as pa

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                raw = data[offsets[i] : offsets[j]]
                text, at = padded(raw, offsets[i : j + 1] - offsets[i])
                start, end, n = words(text, at, _IS_LETTER)
                if not len(start):
                    continue
                size = end - start  # one trigram for each byte: from the space before to the one that ends at the space after
                pos = np.repeat(start - 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                bucket = trigram_buckets(text)[np.minimum(pos, len(text) - 3)]
                names, of = np.unique(langs[i:j], return_inverse=True)
                lang_of_word = np.repeat(of, n)
                key = np.repeat(lang_of_word, size).astype(np.int64) << BUCKET_BITS | bucket
                u, c = np.unique(key, return_counts=True)
                s, k = np.unique(lang_of_word * len(SCRIPTS) + word_scripts(text, start), return_counts=True)
                rows_lang = np.concatenate((names[u >> BUCKET_BITS], names[s // len(SCRIPTS)]))
                kind = np.concatenate((u & ((1 << BUCKET_BITS) - 1), -1 - s % len(SCRIPTS)))
                yield pa.RecordBatch.from_pydict({"lang": pa.array(rows_lang.tolist(), pa.string()), "bucket": pa.array(kind, pa.int64()), "n": pa.array(np.concatenate((c, k)), pa.int64())})

    rows = sample(docs).mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(rows["lang"]))
    counts, scripts = np.zeros((1 << BUCKET_BITS, len(langs))), np.zeros((len(SCRIPTS), len(langs)))
    of = rows["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(np.int64) if langs else np.zeros(0, np.int64)
    bucket, n = rows["bucket"].to_numpy(np.int64), rows["n"].to_numpy(float)
    tri = bucket >= 0
    counts[bucket[tri], of[tri]] = n[tri]
    scripts[-1 - bucket[~tri], of[~tri]] = n[~tri]
    seen = max(int((counts.sum(1) > 0).sum()), 1)
    log_prob = np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * seen)
    log_prob -= log_prob.mean(1, keepdims=True) if langs else 0
    allowed = scripts >= 0.005 * np.maximum(scripts.sum(0), 1)
    allowed[~allowed.any(1)] = True
    return Model(langs, np.ascontiguousarray((TEMPER * log_prob).T.astype(np.float32)), allowed)


def viterbi(score: np.ndarray, n: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best label of every word; texts' words stand one after the other, n of each. Texts advance together."""
    order = np.argsort(-n, kind="stable")
    n_sorted, first = n[order], (np.cumsum(n) - n)[order]
    steps = int(n_sorted[0]) if len(n_sorted) else 0
    active = np.searchsorted(-n_sorted, -np.arange(1, steps + 1), side="right")
    stay, best = np.zeros(score.shape, bool), np.zeros(len(score), np.int8 if score.shape[1] < 128 else np.int32)
    label = np.zeros(len(score), best.dtype)
    v = np.zeros((len(n), score.shape[1]), np.float32)
    for t in range(steps):
        k = int(active[t])
        at, w = first[:k] + t, v[:k]
        top = w.argmax(1)
        best[at] = top
        rest = w[np.arange(k), top][:, None] - np.float32(penalty)
        stay[at] = w >= rest
        np.maximum(w, rest, out=w)
        w += score[at]
    now = v.argmax(1)
    for t in range(steps - 1, -1, -1):
        k = int(active[t])
        at = first[:k] + t
        cur = now[:k]
        label[at] = cur
        now[:k] = np.where(stay[at, cur], cur, best[at])
    return label


def label_words(model: Model, text: np.ndarray, start: np.ndarray, end: np.ndarray, n: np.ndarray) -> np.ndarray:
    score = np.empty((len(start), len(model.langs)), np.float32)
    bucket = trigram_buckets(text)
    edges = np.stack((start - 1, end - 1), 1).ravel()  # trigrams that begin at the space before a word up to its last but one byte
    for k in range(len(model.langs)):
        score[:, k] = np.add.reduceat(model.log_prob[k][bucket], np.minimum(edges, len(bucket) - 1))[::2]
    score[~model.allowed[word_scripts(text, start)]] = -1e4
    return viterbi(score, n)


def has_letter(text: str | None) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text or "")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the spans' number of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.log_prob, model.allowed))
    ascii_letter = np.zeros(256, bool)
    ascii_letter[list(range(0x41, 0x5B)) + list(range(0x61, 0x7B))] = True

    def label(batches):
        import pyarrow as pa

        m = Model(*sent.value)
        for batch in batches:
            column = batch.column("text")
            data, offsets = buffers(column)
            for i, j in slices(offsets, SLICE):
                raw, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                sums = np.concatenate(([0], np.cumsum(ascii_letter[raw])))
                letters = sums[own[1:]] > sums[own[:-1]]
                for k in np.flatnonzero(~letters & (own[1:] > own[:-1])):
                    letters[k] = has_letter(column[i + int(k)].as_py())
                share, pred = np.zeros((j - i, max(len(m.langs), 1))), np.full(j - i, -1)
                spans = np.zeros(j - i, np.int64)
                text, at = padded(raw, own)
                start, end, n = words(text, at, _IS_LETTER)
                if m.langs and len(start):
                    got = label_words(m, text, start, end, n).astype(np.int64)
                    doc = np.repeat(np.arange(j - i), n)
                    share = np.bincount(doc * len(m.langs) + got, weights=end - start, minlength=(j - i) * len(m.langs)).reshape(j - i, -1)
                    pred = np.where(letters & (n > 0), share.argmax(1), -1)
                    change = np.concatenate(([True], (got[1:] != got[:-1]) | (doc[1:] != doc[:-1])))
                    spans = np.bincount(doc[change], minlength=j - i)
                total = np.maximum(share.sum(1), 1)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(i, j - i).cast(pa.int64()),
                    "held_out": batch.column("held_out").slice(i, j - i),
                    "lang_pred": pa.array([m.langs[p] if p >= 0 else "und" for p in pred], pa.string()),
                    "score": pa.array(np.where(pred >= 0, share[np.arange(j - i), np.maximum(pred, 0)] / total, 0.0), pa.float64()),
                    "n_spans": pa.array(np.where(pred >= 0, spans, 0), pa.int64()),
                })

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double, n_spans long")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, first and last byte and language of every span of words with one label."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.log_prob, model.allowed))

    def cut(batches):
        import pyarrow as pa

        m = Model(*sent.value)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets, SLICE):
                own = offsets[i : j + 1] - offsets[i]
                text, at = padded(data[offsets[i] : offsets[j]], own)
                start, end, n = words(text, at, _IS_LETTER)
                if not m.langs or not len(start):
                    continue
                got, doc = label_words(m, text, start, end, n), np.repeat(np.arange(j - i), n)
                first = np.flatnonzero(np.concatenate(([True], (got[1:] != got[:-1]) | (doc[1:] != doc[:-1]))))
                last = np.concatenate((first[1:], [len(start)])) - 1
                base = at[:-1][doc[first]]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(i, j - i).cast(pa.int64()).take(pa.array(doc[first])), "first": pa.array(start[first] - base, pa.int64()), "last": pa.array(end[last] - 1 - base, pa.int64()), "lang": pa.array([m.langs[k] for k in got[first]], pa.string())})

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, first long, last long, lang string")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs))
