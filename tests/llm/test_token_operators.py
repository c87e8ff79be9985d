"""Encoding, packing and token files, against brute force and round trips."""

import bisect
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageflow.llm import packing, token_output
from pageflow.llm.queries import tokenizer_path
from pageflow.llm.tokens import Encoder

TEXTS = [(5, "The quick brown fox, it's here: 3.14!"), (1, None), (2, ""), (3, "word " * 5000), (9, "naïve Größe — ½ “quotes” 日本語 İstanbul é"), (8, "<|endoftext|> we'll"), (8, "<|endoftext|> we'll"), (None, "no id"), (4, "a\x1cb\x85c d")]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, length int, part string")


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids


def test_units_equal_the_library():
    r = random.Random(1)
    signs = "abzAZ'sStTrReEvVmlLdD09 .,!<|>\n\t\x0b\x1c\x85\xa0éÉİıßﬁ́Ως日—’½²_ªº×÷​\U0001f600"
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(40))) for _ in range(3000)] + [t or "" for _, t in TEXTS] + ["'S 'RE 1's --'s a's"]
    e = Encoder(tokenizer_path())
    ids, counts = e(texts, 0)
    want = [x.ids + [0] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    e.unitwise = False
    plain, _ = e(texts, 0)
    assert (plain == ids).all()


def test_packing(spark):
    got = packing.packed(docs(spark), tokenizer_path(), with_ids=True).toPandas()
    want = {}
    for i, t in TEXTS:
        ids = library_ids(t) + [0]
        for a in range(0, len(ids), 2048):
            want.setdefault((i, a // 2048), []).append((a, ids[a : a + 2048]))
    assert len(got) == sum(len(v) for v in want.values())
    for r in got.itertuples():
        key = (None if np.isnan(r.doc_id) else int(r.doc_id), r.piece)
        start, ids = want[key][0]
        raw = np.array(ids, "<u4").tobytes()
        assert (r.start, r.length, r.ids_crc32, r.ids) == (start, len(ids), zlib.crc32(raw), raw)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    assert got.sequence_id.nunique() == -(-got.length.sum() // 2048)


def test_sequences_hold_their_pieces(spark):
    got = packing.sequences(docs(spark), tokenizer_path()).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in got)
    assert sum(r["n_tokens"] for r in got) == sum(len(library_ids(t)) + 1 for _, t in TEXTS)


def simulate(plan, counts, capacity):
    level, seen = {}, {length: [] for length in counts}
    for length, rank, number, first, offset in plan.tolist():
        seen[length] += range(rank, rank + number)
        for s in range(first, first + number):
            level.setdefault(s, []).append((offset, length))
    assert all(sorted(seen[x]) == list(range(n)) for x, n in counts.items())
    for parts in level.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(level)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_a_packing_near_the_bound(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 500])
    counts = {x: r.randrange(1, 200) for x in r.sample(range(1, capacity + 1), min(capacity, 40))}
    n = simulate(packing.plan(counts, capacity), counts, capacity)
    items = sorted((x for x, c in counts.items() for _ in range(c)), reverse=True)
    gaps: list[int] = []
    for x in items:  # best fit, one by one
        fits = [g for g in gaps if g >= x]
        if fits:
            g = min(fits)
            gaps.remove(g)
            gaps.append(g - x)
        else:
            gaps.append(capacity - x)
    assert n <= len(gaps) * 1.02 + 1


def rounds_by_rows(lengths, capacity):
    """Bulk-synchronous rounds on single pieces: each finds its successor among the gaps, the i-th of those that want a size
    takes the i-th gap of it, the rest waits; what has no successor opens as many sequences as its volume needs."""
    left, gaps, opened, rounds = sorted(lengths, reverse=True), [], 0, 0
    while left:
        rounds += 1
        gaps.sort()
        sizes, free = sorted(set(gaps)), {}
        for g in gaps:
            free[g] = free.get(g, 0) + 1
        waiting, lost, taken = [], [], []
        for x in left:
            at = bisect.bisect_left(sizes, x)
            if at == len(sizes):
                lost.append(x)
            elif free[sizes[at]]:
                free[sizes[at]] -= 1
                taken.append(sizes[at] - x)
            else:
                waiting.append(x)
        new = lost[: -(-sum(lost) // capacity)]
        opened += len(new)
        gaps = [g for g, n in free.items() for _ in range(n)] + [g for g in taken + [capacity - x for x in new] if g]
        left = sorted(waiting + lost[len(new) :], reverse=True)
    return opened, rounds


@pytest.mark.parametrize("seed", range(4))
def test_plan_needs_no_more_sequences_than_rounds_by_rows(seed):
    r = random.Random(100 + seed)
    lengths = [min(2048, int(r.lognormvariate(5.5, 1.2)) + 1) for _ in range(3000)]
    counts = {x: lengths.count(x) for x in set(lengths)}
    n = simulate(packing.plan(counts, 2048), counts, 2048)
    opened, rounds = rounds_by_rows(lengths, 2048)
    assert -(-sum(lengths) // 2048) <= n <= opened and rounds > 50


def test_no_documents(spark):
    none = docs(spark, [])
    assert packing.packed(none, tokenizer_path()).count() == 0
    assert token_output.round_trip(none, tokenizer_path()).count() == 0


def test_numeral_system_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 31, 5000, 300_000):
        ids = np.minimum(r.geometric(0.01, n), 999).astype(np.int64)
        table = token_output.Table.fit(np.bincount(ids, minlength=1000))
        assert int(table.freq.sum()) == 1 << table.bits
        raw = token_output.write_block([1, None], np.array([n, 0]), ids, table)
        block = token_output.Block(raw, table)
        assert (block.ids() == ids).all() and block.null.tolist() == [False, True]
        for k in range(len(block.marks)):
            size = block.every * block.lanes
            assert (block.stretch(k) == ids[k * size : (k + 1) * size]).all()
        if n == 300_000:
            p = np.bincount(ids) / n
            bits = -(p[p > 0] * np.log2(p[p > 0])).sum()
            assert len(block.marks) > 1 and len(raw) * 8 / n < bits * 1.1


def test_damage_is_found():
    ids = np.arange(2000) % 50
    table = token_output.Table.fit(np.bincount(ids, minlength=60))
    raw = bytearray(token_output.write_block([1], np.array([2000]), ids, table))
    raw[200] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_output.Block(bytes(raw), table)


def test_rare_ids_keep_a_frequency():
    counts = np.zeros(50_000, np.int64)
    counts[:40_000] = 1
    counts[0] = 10**12
    table = token_output.Table.fit(counts)
    assert (table.freq[:40_000] > 0).all() and int(table.freq.sum()) == 1 << table.bits


def test_token_files(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_output.write_files(docs(spark), tokenizer_path(), path)
    got = token_output.read_files(spark, path, with_ids=True).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:]) and len(ids) == len(TEXTS)
    start, texts = 0, {}
    for i, t in TEXTS:
        texts.setdefault(i, t)
    for r in got:
        want = np.array(library_ids(texts[r["doc_id"]]) + [2], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (start, len(want) // 4, zlib.crc32(want), want)
        start += r["n_tokens"]
    assert spark.read.parquet(f"{path}/blocks").agg(F.sum("n_tokens")).first()[0] == start
