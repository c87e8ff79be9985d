"""Token ids of whole texts, by the tokenizers library.

Where a tokenizer's own pre-tokens are letter runs, single digits and runs of other signs, with white space dropped, a
text is cut into these units here, and every distinct unit is encoded once a worker, many in one call; that is several
times as fast as whole texts. Words with characters for which normalising could move a boundary, and texts that hold a
special token's string, go to the tokenizer as they are. Any other tokenizer encodes all texts as they are.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

#: Units a worker remembers; beyond them it starts anew.
MAX_UNITS = 1_000_000
#: Fixed value: the pre-tokenizer pattern for which units are independent of one another.
UNITWISE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that lower-casing and composing leave single letters (Latin, without the dotted capital I).
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ"
_SIGN = r"!-/:-@\[-`{-~"
_UNIT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[0-9]|[{_SIGN}]+")
_OTHER = re.compile(rf"[^{_LETTER}0-9{_SIGN} \t\n\r\f\v]")
_WORD = re.compile(r"[^ \t\n\r\f\v]+")
#: Stands before what goes to the tokenizer as it is; no unit holds it.
_ODD = "\0"
_ENCODERS: dict[str, "Encoder"] = {}


class _Numbers(dict):
    """Numbers new keys as they are asked for, and lists them."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key):
        self.new.append(key)
        self[key] = k = len(self)
        return k


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unitwise = self._is_unitwise(json.loads(self.tokenizer.to_str()))
        if self.unitwise:
            self.plain = Tokenizer(self.tokenizer.model)  # shares the vocabulary; no normaliser
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.vocabulary, bool)
            self.ends[[i for s, i in self.tokenizer.get_vocab().items() if s.endswith("</w>")]] = True
        self._forget()

    @staticmethod
    def _is_unitwise(spec: dict) -> bool:
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        norm = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = {"behavior": "Removed", "invert": True, "pattern": {"Regex": UNITWISE}}
        return split.items() <= steps[0].items() and steps[1].get("type") == "ByteLevel" and norm == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>"

    def _forget(self) -> None:
        self.known = _Numbers()
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0
        self.starts, self.lengths, self.learned = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _learn(self) -> None:
        """Encodes the units that were new, in their order: plain ones many at a time."""
        new, self.known.new = self.known.new, []
        for a in range(0, len(new), 4096):
            part = new[a : a + 4096]
            text = " ".join(part)
            if _ODD in text:
                odd = [u[0] == _ODD for u in part]
                text = " ".join(u for u, o in zip(part, odd, strict=True) if not o)
            else:
                odd = []
            plain = self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids
            plain = np.array(plain, np.uint32)
            cuts = np.concatenate(([0], np.flatnonzero(self.ends[plain]) + 1))
            if len(cuts) - 1 != len(part) - sum(odd) or cuts[-1] != len(plain):
                raise ValueError("the tokenizer doesn't keep units apart")
            if not odd:
                self._store(plain, np.diff(cuts))
                continue
            k = 0
            for u, o in zip(part, odd, strict=True):
                own = np.array(self.tokenizer.encode(u[1:], add_special_tokens=False).ids, np.uint32) if o else plain[cuts[k] : cuts[k + 1]]
                k += not o
                self._store(own, np.array([len(own)]))

    def _store(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        while self.learned + len(lengths) > len(self.starts):
            self.starts, self.lengths = (np.concatenate((x, np.zeros(len(x), np.int64))) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + len(ids)] = ids
        s = slice(self.learned, self.learned + len(lengths))
        self.starts[s], self.lengths[s] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used += len(ids)
        self.learned += len(lengths)

    def _units(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            return [_ODD + text]
        if _OTHER.search(text) is None:
            return _UNIT.findall(text.lower())
        return list(chain.from_iterable([_ODD + w] if _OTHER.search(w) else _UNIT.findall(w.lower()) for w in _WORD.findall(text)))

    def __call__(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and the number of each text's ids with it."""
        if not self.unitwise:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts = np.array([len(x) + 1 for x in each], np.int64)
            return np.fromiter(chain.from_iterable(chain(x, (end_id,)) for x in each), np.uint32, int(counts.sum())), counts
        if len(self.known) > MAX_UNITS:
            self._forget()
        units = [self._units(t) for t in texts]
        n = np.array([len(x) for x in units], np.int64)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(units)), np.int64, int(n.sum()))
        self._learn()
        length = self.lengths[at]
        ends = np.concatenate(([0], np.cumsum(length)))
        unit_ends = np.cumsum(n)
        counts = ends[unit_ends] - ends[unit_ends - n]
        ids = self.ids[np.repeat(self.starts[at] - ends[:-1], length) + np.arange(ends[-1])]
        return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Forgets this worker's encoders; later stages that run in it have the memory for themselves."""
    if _ENCODERS:
        import ctypes
        import gc

        _ENCODERS.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def encoded(batch, path: str, end_id: int, limit: int = 1_000_000):
    """(first row, row after the last, ids, counts) for runs of the batch's texts; null counts as empty."""
    from .textvec import buffers, slices

    column = batch.column("text")
    _, offsets = buffers(column)
    for i, j in slices(offsets, limit):
        yield i, j, *encoder(path)([x or "" for x in column.slice(i, j - i).to_pylist()], end_id)
