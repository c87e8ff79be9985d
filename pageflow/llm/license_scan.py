"""Licence notices in texts.

Words are runs of ASCII letters and digits and non-ASCII characters, lower-cased. A match may miss a bounded number of a
template's words, so it has at least one of any choice of one more; the longest words are chosen as seeds, and every word
of a text probes them. Around a seed there must also be enough words of the template's vocabulary. What passes is aligned
with the template word by word, in a band around every diagonal that the seed is within; so nothing is lost against an
alignment of every template at every place. A match counts if the matched words cover enough of the template.

One row for each match: doc_id, license, coverage (matched words / template words), first_word and last_word in the
text, first_byte and end_byte. The templates are whole notices and whole short licences, see ``license_texts``. Where
matches overlap, the one with more matched words stays, then the one with the larger coverage (so a licence wins over a
look-alike that it matches but for a word), then the alphabetically first; what is left on its sides is aligned anew, so
notices in a row have a row each. Null, empty and word-less texts have no row. Rows that repeat are each reported; extra
columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
from pyspark.sql import DataFrame

from .license_texts import TEMPLATES
from .textvec import WORD_ALNUM, buffers, prefix_hash, slices, span_hash, words, _CODES, LOWER

BAND = 6
MIN_COVERAGE = 0.8
MATCH, MISMATCH, GAP = 2, -1, -1


def text_words(data: np.ndarray, offsets: np.ndarray):
    """Hash, start and end byte of every word, and the number of each text's."""
    start, end, n = words(data, offsets, WORD_ALNUM)
    return span_hash(prefix_hash(data, _CODES[LOWER]), start, end), start, end, n


class Index:
    """Words of the templates, and the seeds of each: the longest words, one more than a match may miss, so that no match lacks them all."""

    def __init__(self, templates: dict[str, str], min_coverage: float = MIN_COVERAGE):
        self.names, self.words, self.need = [name.partition("#")[0] for name in sorted(templates)], [], []
        rows: list[tuple[int, int, int]] = []
        for k, name in enumerate(sorted(templates)):
            raw = templates[name].encode()
            w, start, end, _ = text_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            self.words.append(w)
            need = next(x for x in range(1, len(w) + 2) if x > len(w) or x / len(w) >= min_coverage)
            self.need.append(need)
            for place in np.argsort(start - end, kind="stable")[: len(w) - need + 1].tolist():
                rows.append((int(w[place]), k, place))
        rows = sorted(set(rows))
        self.seed = np.array([r[0] for r in rows], np.uint64)
        self.place = np.array([r[1:] for r in rows], np.int64).reshape(-1, 2)
        self.vocabulary = np.unique(np.concatenate([*self.words, np.zeros(0, np.uint64)]))
        self.member = np.zeros((len(self.words), len(self.vocabulary) + 1), bool)  # the last is any other word
        for k, w in enumerate(self.words):
            self.member[k, np.searchsorted(self.vocabulary, w)] = True
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def candidates(self, w: np.ndarray, first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, template and diagonal (of the place in all words) of every place where a match can be. It needs a seed
        within the band and, around it, as many words of the template's vocabulary as a match has at least."""
        code = np.full(len(w), len(self.vocabulary))
        at = np.flatnonzero(self.maybe[(w & np.uint64(0xFFFF)).astype(np.int64)])
        known = np.minimum(np.searchsorted(self.vocabulary, w[at]), max(len(self.vocabulary) - 1, 0))
        same = self.vocabulary[known] == w[at] if len(self.vocabulary) else np.zeros(len(at), bool)
        at = at[same]
        code[at] = known[same]
        low = np.searchsorted(self.seed, w[at])
        n = np.searchsorted(self.seed, w[at], side="right") - low
        row = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        at, k = np.repeat(at, n), self.place[row, 0]
        diagonal = at - self.place[row, 1]
        out = [(np.zeros(0, np.int64),) * 3]
        for t in np.unique(k).tolist():
            mine, m = k == t, len(self.words[t])
            d, doc = diagonal[mine], np.searchsorted(first_word, at[mine], side="right") - 1
            lo, hi = first_word[doc], first_word[doc + 1]
            count = np.concatenate(([0], np.cumsum(self.member[t][code])))

            def enough(d, lo, hi, slack, count=count, m=m, t=t):
                return count[np.clip(d + m + slack, lo, hi)] - count[np.clip(d - slack, lo, hi)] >= self.need[t]

            ok = enough(d, lo, hi, 2 * BAND)
            pairs = np.unique((doc[ok][:, None] << 40) + (d[ok][:, None] + np.arange(-BAND, BAND + 1) + (1 << 20)))
            doc, d = pairs >> 40, (pairs & ((1 << 40) - 1)) - (1 << 20)
            ok = enough(d, first_word[doc], first_word[doc + 1], BAND)
            out.append((doc[ok], np.full(int(ok.sum()), t), d[ok]))
        doc, k, d = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(doc, kind="stable")
        return doc[order], k[order], d[order]


def align_all(template: np.ndarray, text: np.ndarray, diagonal: np.ndarray, low: np.ndarray, high: np.ndarray, need: int) -> list[tuple[int, int, int]]:
    """Banded local alignments around text place = template place + diagonal, each within the text places low to high.
    Matched words and first and last matched place in the text of each; (0, -1, -1) where fewer than ``need`` can match."""
    out = [(0, -1, -1)] * len(diagonal)
    m, width = len(template), 2 * BAND + 1
    for begin in range(0, len(diagonal), 256):
        d, lo, hi = diagonal[begin : begin + 256, None], low[begin : begin + 256, None], high[begin : begin + 256, None]
        j = d[:, None] - BAND + np.arange(m)[:, None] + np.arange(width)
        inside = (j >= lo[:, None]) & (j < hi[:, None])
        same = inside & (text[np.clip(j, 0, len(text) - 1)] == template[:, None])
        left = np.flatnonzero(same.any(2).sum(1) >= need)
        inside, same = inside[left], same[left]
        score, move = np.zeros((len(left), m + 1, width)), np.zeros((len(left), m + 1, width), np.int8)
        ramp, edge = GAP * np.arange(width), np.full((len(left), 1), -np.inf)
        for i in range(1, m + 1):
            step = score[:, i - 1] + np.where(same[:, i - 1], MATCH, MISMATCH)
            skip = np.concatenate((score[:, i - 1, 1:], edge), 1) + GAP  # a template word without a text word
            own = np.where(inside[:, i - 1], np.maximum(np.maximum(step, skip), 0), 0)
            own_move = np.where(step >= skip, 1, 2)
            run = np.maximum.accumulate(own - ramp, 1) + ramp  # text words without a template word
            move[:, i] = np.where(run > own, 3, np.where(own > 0, own_move, 0))
            score[:, i] = np.where(inside[:, i - 1], run, 0)
        for x, best in enumerate(score.reshape(len(left), (m + 1) * width).argmax(1).tolist() if len(left) else []):
            i, c = divmod(best, width)
            matched, first, last, shift = 0, -1, -1, int(diagonal[begin + left[x]]) - BAND - 1
            while i > 0 and score[x, i, c] > 0 and move[x, i, c]:
                if move[x, i, c] == 1:
                    if same[x, i - 1, c]:
                        matched, first = matched + 1, i + shift + c
                        last = first if last < 0 else last
                    i -= 1
                elif move[x, i, c] == 2:
                    i, c = i - 1, c + 1
                else:
                    c -= 1
            out[begin + left[x]] = (matched, first, last)
    return out


def align(template: np.ndarray, text: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """The alignment around one diagonal of the whole text."""
    return align_all(template, text, np.array([diagonal]), np.array([0]), np.array([len(text)]), 0)[0]


def matches(index: Index, text: np.ndarray, template: np.ndarray, diagonal: np.ndarray) -> list[tuple[str, float, int, int]]:
    """name, coverage, first and last word of the matches in one text, given its candidates. The best one is taken, those
    that meet it are aligned again in what is left on its sides, and so on."""
    size = np.array([len(w) for w in index.words])[template]
    begin, end = np.maximum(diagonal - BAND, 0), np.minimum(diagonal + size + BAND, len(text))
    heap: list[tuple] = []
    version = np.zeros(len(template), np.int64)

    def add(who: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        for t in np.unique(template[who]).tolist():
            own = np.flatnonzero(template[who] == t)
            for x, (matched, first, last) in zip(who[own].tolist(), align_all(index.words[t], text, diagonal[who[own]], low[own], high[own], index.need[t]), strict=True):
                if matched >= index.need[t]:
                    heapq.heappush(heap, (-matched, -matched / len(index.words[t]), index.names[t], last - first, first, last, x, int(version[x])))

    add(np.arange(len(template)), begin, end)
    starts, ends = [-1], [0]  # places taken, in order; before the text nothing is left
    kept: list[tuple[str, float, int, int]] = []
    while heap:
        _, coverage, name, _, first, last, x, v = heapq.heappop(heap)
        if v != version[x]:
            continue
        kept.append((name, -coverage, first, last))
        i = bisect.bisect(starts, first)
        starts.insert(i, first)
        ends.insert(i, last + 1)
        met = np.flatnonzero((begin <= last) & (end > first))
        version[met] += 1
        who, low, high = [], [], []
        for y in met.tolist():
            a, b = int(begin[y]), int(end[y])
            i = bisect.bisect(ends, a)  # the first taken place that ends after a
            while a < b:
                stop = min(b, starts[i]) if i < len(starts) else b
                if stop - a >= index.need[template[y]]:
                    who.append(y), low.append(a), high.append(stop)
                a, i = (ends[i] if i < len(ends) else b), i + 1
        if who:
            add(np.array(who), np.array(low), np.array(high))
    return sorted(kept, key=lambda x: x[2])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    templates = TEMPLATES if templates is None else templates

    def run(batches):
        import pyarrow as pa

        index = Index(templates, min_coverage)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            out: dict[str, list] = {c: [] for c in ("doc_id", "license", "coverage", "first_word", "last_word", "first_byte", "end_byte")}
            for i, j in slices(offsets):
                own = offsets[i : j + 1] - offsets[i]
                w, start, end, n = text_words(data[offsets[i] : offsets[j]], own)
                first_word = np.concatenate(([0], np.cumsum(n)))
                doc, template, diagonal = index.candidates(w, first_word)
                for d in np.unique(doc).tolist():
                    mine = slice(*np.searchsorted(doc, (d, d + 1)))
                    a = int(first_word[d])
                    for name, coverage, first, last in matches(index, w[a : int(first_word[d + 1])], template[mine], diagonal[mine] - a):
                        for c, v in zip(out, (ids[i + d], name, coverage, first, last, int(start[a + first] - own[d]), int(end[a + last] - own[d])), strict=True):
                            out[c].append(v)
            types = dict(zip(out, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True))
            yield pa.RecordBatch.from_pydict({c: pa.array(v, types[c]) for c, v in out.items()})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, coverage double, first_word long, last_word long, first_byte long, end_byte long")
