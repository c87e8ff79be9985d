"""Exact duplicates, decontamination, licences, repeated passages and similarity joins, against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pageflow.llm import components, decontaminate, exact_dedup, jaccard_join, license_scan, queries, suffix_dedup, textvec

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row long, kept boolean"  # extra columns with clashing names


def from_files(spark, tmp_path, texts, name="d"):
    rows = [(i, t, -1, None) for i, t in texts]
    path = str(tmp_path / name)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def word_text(r, n, vocabulary=60):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "x" * 50_000), (None, "same words here as there"), (904, "same words here as there"), (904, "same words here as there")]


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op5_decontamination", "op10_jaccard_join"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    rel = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(row[i] for i in at)) for row in rel.fetchall())


# --- exact duplicates -----------------------------------------------------------------------------------------------


def test_exact_duplicates(spark, tmp_path):
    r = random.Random(1)
    base = [word_text(r, n) for n in (3, 400, 3000)]
    texts = [(i, base[i % 3].replace(" ", r.choice([" ", "\n", " \t "]))) for i in range(30)] + [(100 + i, base[2] + f" {i}") for i in range(5)] + ODD
    got = exact_dedup.exact_duplicates(from_files(spark, tmp_path, texts)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in texts:
        groups.setdefault(norm(t), []).append(i)
    assert len(got) == len(texts)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for row in got:
        g = by_sha[row["text_sha256"]]
        known = [x for x in g if x is not None]
        assert row["group_size"] == len(g) and row["keep_id"] == (min(known) if known else None)
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_duplicates_without_verified_identifiers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "clashes", lambda rows: 1)
    got = exact_dedup.exact_duplicates(from_files(spark, tmp_path, [(1, "a b"), (2, "a  b"), (3, "ab")])).orderBy("doc_id").collect()
    assert [r["keep_id"] for r in got] == [1, 1, 3]


def test_clashes_are_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("same"))
    assert exact_dedup.clashes(from_files(spark, tmp_path, [(1, "a"), (2, "b")])) == 1


def test_empty_tables(spark, tmp_path):
    none = from_files(spark, tmp_path, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert decontaminate.report(none, bench).count() == 0
    assert license_scan.scan(none).count() == 0
    assert suffix_dedup.without_repeats(none).count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0


def test_stages_keep_columns(spark, tmp_path):
    docs = from_files(spark, tmp_path, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "q")])
    for out in (exact_dedup.drop_exact_duplicates(docs), jaccard_join.keep_one_of_each(docs)):
        assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]


# --- decontamination ------------------------------------------------------------------------------------------------

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def py_decontaminate(texts, items):
    windows = {}
    for i, t in items:
        w = WORDS.findall(ascii_lower(t))
        k = min(10, len(w))
        for a in range(len(w) - k + 1) if k else []:
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for d, t in texts:
        w, hit, found = WORDS.findall(ascii_lower(t)), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    found |= windows[tuple(w[a : a + k])]
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        n = len([x for x in found if x is not None])
        out.append((d, len(w), len(hit), n, hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_decontamination(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", most)
    r = random.Random(3)
    items = [(1, word_text(r, 14)), (2, "Größe, É one"), (3, "solo"), (4, "two words"), (5, None), (6, "!!"), (7, word_text(r, 10)), (11, word_text(r, 9))]
    texts = [(i, word_text(r, r.randrange(0, 60), 25)) for i in range(40)]
    texts += [(100, "A " + items[0][1].upper().replace(" ", "; ") + " z"), (101, items[6][1] + " " + items[6][1]), (102, "größe É ONE"), (103, "SOLO two-words"), *ODD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = from_files(spark, tmp_path, texts)
    got = sorted((tuple(x) for x in decontaminate.report(docs, bench).collect()), key=repr)
    assert got == py_decontaminate(texts, items)
    clean = {t[0] for t in py_decontaminate(texts, items) if not t[5]}
    assert {x["doc_id"] for x in decontaminate.remove(docs, bench).collect()} == clean
    left = {x["doc_id"]: x["text"] for x in decontaminate.remove_spans(docs, bench).collect()}
    assert left[100] == "a z" and left[103] == ""


# --- licences -------------------------------------------------------------------------------------------------------


def test_licences(spark, tmp_path):
    r = random.Random(5)
    mit = license_scan.TEMPLATES["MIT-text"]
    damaged = mit.split()
    del damaged[10]
    damaged.insert(20, "extra")
    texts = [(1, word_text(r, 200) + "\nReleased under the MIT License.\n" + word_text(r, 50)), (2, " ".join(damaged)), (3, word_text(r, 300)), (4, "released under a licence"), (5, "é " + license_scan.TEMPLATES["GPL-3.0"] + " and " + license_scan.TEMPLATES["Apache-2.0"]), *ODD]
    got = license_scan.scan(from_files(spark, tmp_path, texts)).orderBy("doc_id", "first_word").collect()
    assert [(x["doc_id"], x["license"]) for x in got] == [(1, "MIT"), (2, "MIT-text"), (5, "GPL-3.0"), (5, "Apache-2.0")]
    assert got[0]["coverage"] == 1.0 and got[0]["first_word"] == 200
    assert texts[0][1].encode()[got[0]["first_byte"] : got[0]["end_byte"]] == b"Released under the MIT License"
    n = len(re.findall(r"[A-Za-z0-9]+", mit))
    assert abs(got[1]["coverage"] - (n - 1) / n) < 1e-9


def test_look_alike_licences(spark, tmp_path):
    t = license_scan.TEMPLATES
    gnu = lambda kind, v: f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
    texts = {"BSD-2-Clause": t["BSD-2-Clause#0"], "BSD-3-Clause": t["BSD-3-Clause#0"], "GPL-2.0-statement": gnu("", "2"), "GPL-3.0-statement": gnu("", "3"), "AGPL-3.0-statement": gnu("Affero ", "3"), "LGPL-2.1-statement": gnu("Lesser ", "2.1")}
    texts |= {n: t[f"{n}#program-url"] for n in ("GPL-2.0-header", "GPL-3.0-header", "LGPL-3.0-header", "AGPL-3.0-header")} | {n: t[n] for n in ("ISC", "0BSD", "MIT-text", "MIT-0-text", "Apache-2.0-header", "CC-BY-4.0", "CC-BY-NC-SA-4.0")}
    docs = from_files(spark, tmp_path, [(i, "before " + x + " after") for i, x in enumerate(texts.values())])
    got = license_scan.scan(docs).orderBy("doc_id").collect()
    assert [(x["license"], x["coverage"], x["first_word"]) for x in got] == [(n, 1.0, 1) for n in texts]
    for x, whole in zip(got, texts.values(), strict=True):  # the span ends with the text's last word
        assert x["last_word"] == len(re.findall(r"[A-Za-z0-9]+", whole))


def py_licenses(index, text, low=0):
    """The best of all alignments of every template at every place, then the same on its left and right."""
    if not len(text):
        return []
    best = None
    for name, w, need in zip(index.names, index.words, index.need, strict=True):
        for d in range(-len(w) - license_scan.BAND, len(text) + license_scan.BAND):
            matched, first, last = license_scan.align(w, text, d)
            if matched >= need:
                best = min(best or (1,), (-matched, -matched / len(w), name, last - first, first, last))
    if best is None:
        return []
    _, coverage, name, _, first, last = best
    return [*py_licenses(index, text[:first], low), (name, -coverage, low + first, low + last), *py_licenses(index, text[last + 1 :], low + last + 1)]


def test_licences_against_every_place():
    r = random.Random(8)
    some = {k: license_scan.TEMPLATES[k] for k in ("MIT", "BSD", "Apache-2.0", "CC-BY-NC-4.0", "GPL-3.0", "MPL-2.0")}
    index = license_scan.Index(some)
    pool = sorted({w for t in some.values() for w in re.findall(r"[A-Za-z0-9]+", t)}) + ["x", "y", "the", "of"]
    texts = ["Released under an MIT License", "Distributed under the MIT License", "Released under the MIT Licence", "Released under the MIT License. " * 3, "Released under MIT License Released under the MIT License"]
    for _ in range(25):
        text = []
        for _ in range(r.randrange(1, 4)):
            text += r.choices(pool, k=r.randrange(6))
            for w in r.choice(list(some.values())).split():
                text += [[w], [w], [w], [w], [w], [w], [r.choice(pool)], [], [w, r.choice(pool)]][r.randrange(9)]
        texts.append(" ".join(text))
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    w, _, _, n = license_scan.text_words(data, offsets)
    first = np.concatenate(([0], np.cumsum(n)))
    doc, template, diagonal = index.candidates(w, first)
    got = [license_scan.matches(index, w[first[i] : first[i + 1]], template[doc == i], diagonal[doc == i] - first[i]) for i in range(len(texts))]
    assert [[m[0] for m in x] for x in got[:4]] == [["MIT"]] * 3 + [["MIT"] * 3]
    assert sum(map(len, got)) > 30
    assert got == [py_licenses(index, w[first[i] : first[i + 1]]) for i in range(len(texts))]


def test_alignment_against_full_table():
    r = np.random.default_rng(0)
    for _ in range(30):
        t = r.integers(0, 6, 12).astype(np.uint64)
        x = np.concatenate((r.integers(0, 6, 5), t[:6], r.integers(0, 6, 1), t[6:], r.integers(0, 6, 5))).astype(np.uint64)
        best = np.zeros((len(t) + 1, len(x) + 1))
        for i in range(1, len(t) + 1):
            for j in range(1, len(x) + 1):
                best[i, j] = max(0, best[i - 1, j - 1] + (2 if t[i - 1] == x[j - 1] else -1), best[i - 1, j] - 1, best[i, j - 1] - 1)
        matched, first, last = license_scan.align(t, x, 5)
        assert matched >= 8 and first <= 6 and last >= 15 and 2 * matched >= best.max() - 6


# --- repeated passages ----------------------------------------------------------------------------------------------


def py_repeats(texts, k=200):
    count = Counter()
    raw = [(d, (t or "").encode()) for d, t in texts]
    for _, b in raw:
        for i in range(len(b) - k + 1):
            count[b[i : i + k]] += 1
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if count[b[i : i + k]] > 1:
                gone[i : i + k] = b"\x01" * k
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [4000, 2])
def test_repeated_passages(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "TASK_BYTES", 5000)
    r = random.Random(7)
    fresh = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    p, q = fresh(260), fresh(199)
    texts = [(1, fresh(300) + p + fresh(100)), (2, p + fresh(50)), (3, fresh(20) + q), (4, q + fresh(30)), (5, "ab" * 300), (6, fresh(40) + p[20:230] + fresh(40)), (7, "z" * 200), (8, "z" * 199), (9, fresh(100) + "y" * 450)]
    copy = fresh(500)
    texts += [(20 + i, copy) for i in range(6)] + [(40 + i, fresh(30) + p[30:] + fresh(250)) for i in range(8)] + ODD
    got = sorted((tuple(x) for x in suffix_dedup.without_repeats(from_files(spark, tmp_path, texts)).collect()), key=repr)
    assert got == py_repeats(texts)


def test_levels_grow_logarithmically():
    levels = suffix_dedup.SuffixLevels()
    r = np.random.default_rng(1)
    keys = r.integers(0, 300, 4000).astype(np.uint64)
    for a in range(0, 4000, 100):
        levels.add(keys[a : a + 100], keys[a : a + 100])
        sizes = [len(x[0]) for x in levels.levels]
        assert all(a > b for a, b in zip(sizes, sizes[1:])) and len(sizes) <= 10
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    assert (levels.repeated == (n[at] > 1)).all()


def test_anchors_of_equal_windows_are_equal():
    r = np.random.default_rng(2)
    p = r.integers(97, 101, 230).astype(np.uint8)
    a = np.concatenate((r.integers(97, 101, 77), p, r.integers(97, 101, 50))).astype(np.uint8)
    b = np.concatenate((p, r.integers(97, 101, 90))).astype(np.uint8)
    fps = [dict() for _ in range(2)]
    for text, out in ((a, fps[0]), (b, fps[1])):
        first, last, fp = suffix_dedup.runs(text, np.array([0, len(text)]))
        assert (np.diff(first) > 0).all() and first[0] == 0 and last[-1] == len(text) - 200
        for f, e, x in zip(first, last, fp):
            for w in range(f, e + 1):
                out[text[w : w + 200].tobytes()] = x
    common = fps[0].keys() & fps[1].keys()
    assert len(common) >= 31 and all(fps[0][w] == fps[1][w] for w in common)


# --- similarity join ------------------------------------------------------------------------------------------------


def py_components(texts, k, percent):
    sets = []
    for i, (_, t) in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
        sets.append({tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    root[find(a)] = find(b)
    members = {}
    for a in range(len(texts)):
        members.setdefault(find(a), []).append(texts[a][0])
    least = {c: min((x for x in m if x is not None), default=None) for c, m in members.items()}
    return sorted(((texts[a][0], len(sets[a]), least[find(a)]) for a in range(len(texts))), key=repr)


@pytest.mark.parametrize(("k", "percent", "part"), [(4, 85, 2_000_000), (5, 80, 400), (2, 60, 2_000_000)])
def test_similarity_join(spark, tmp_path, monkeypatch, k, percent, part):
    monkeypatch.setattr(jaccard_join, "PART_SHINGLES", part)
    r = random.Random(11)
    texts, n = list(ODD), 0
    for _ in range(12):
        base = word_text(r, r.randrange(4, 150), 400).split()
        for _ in range(r.randrange(1, 9)):
            own = list(base)
            for _ in range(r.randrange(0, 4)):
                own[r.randrange(len(own))] = f"v{r.randrange(100)}"
            texts.append((n, " ".join(own)))
            n += 1
    got = sorted((tuple(x) for x in jaccard_join.jaccard_components(from_files(spark, tmp_path, texts), k, percent).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == py_components(texts, k, percent)


def test_links_within_equal_all_pairs():
    r = np.random.default_rng(3)
    base = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (20, 90, 400)]
    sets = [np.unique(np.concatenate((b[r.random(len(b)) > 0.05], r.integers(0, 2**63, 3).astype(np.uint64)))) for b in base for _ in range(40)]
    root = list(range(len(sets)))
    find = lambda a: a if root[a] == a else find(root[a])
    for a, b in jaccard_join.links_within(sets, 80):
        root[find(a)] = find(b)
    want = list(range(len(sets)))
    wfind = lambda a: a if want[a] == a else wfind(want[a])
    for a in range(len(sets)):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                want[wfind(a)] = wfind(b)
    same = lambda f: {frozenset(x for x in range(len(sets)) if f(x) == f(a)) for a in range(len(sets))}
    assert same(find) == same(wfind)


def test_components(spark):
    edges = [(a, a + 1) for a in range(0, 40)] + [(100, 90), (100, 95), (200, 200)]
    got = {r["u"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{a: 0 for a in range(1, 41)}, 95: 90, 100: 90}


def test_word_hashes_don_t_depend_on_place():
    raw = "Ab cdé ab CDé".encode()
    h, n = textvec.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert n.tolist() == [4] and h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
