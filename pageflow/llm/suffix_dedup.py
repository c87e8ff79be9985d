"""Removal of repeated passages with a logarithmic family of suffix arrays.

Texts are bytes. Any byte under a ``LENGTH``-byte string that starts at some other place too, in the same text or in
another, is removed; places are judged on the input.

1. Every ``LENGTH``-byte window has an anchor: its ``SEED``-byte piece of smallest hash, the first of equals. Equal
   windows have equal anchors at equal offsets, so they meet under their anchor's fingerprint. Neighbouring windows share
   an anchor; such a run of windows is one stretch of text.
2. A first scan counts the runs under each fingerprint; those of two or more are marked in a bit map of bounded size, put
   together from blocks that the executors make (a false mark costs time only). A second scan writes the stretches of
   marked anchors. Equal stretches are one from here
   on, and all their windows repeat.
3. Distinct stretches are dealt by fingerprint. A task takes them in batches; each batch gets the suffix array of its
   window starts, sorted by a fingerprint of the next ``LENGTH`` bytes (any order serves in which equal windows are
   neighbours), is merge-scanned against the existing levels, and is put in as a new level; levels of equal size merge,
   so there are logarithmically many. Fingerprints under which too many distinct stretches meet are not given to one
   task: their windows are dealt singly.
4. The repeated windows go back to all places of their stretch, and from there to the texts. Rows are known by file and
   place, the same at every scan; a row map tells which texts lose something, and only those move to meet their spans.

Nulls count as empty. Texts shorter than ``LENGTH`` lose nothing. Texts of any length are taken in pieces that overlap by
``LENGTH - 1`` bytes, so the arrays of a task have a bound. Repeated rows lose all (if long enough), as each starts in the
other too. Extra columns are ignored; an empty table gives an empty table. Fingerprints of windows have 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, drop_written, from_files, numbered, row_maps, split_by_rows, written
from .textvec import _CODES, _RNG, SLICE_BYTES, buffers, mix, powers, prefix_hash, slices

LENGTH, SEED = 200, 32
#: Distinct stretches under one fingerprint beyond which their windows are dealt singly.
HOT = 4000
#: Bytes of stretches that a task takes.
TASK_BYTES = 6 << 20
#: Bits of the map for each marked fingerprint, and the most bits of a map (128 MB).
BITS_EACH, MAX_BITS = 16, 30
_AT = np.uint64((1 << 28) - 1)
_CODES2 = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _window_hash(data: np.ndarray, width: int, codes: np.ndarray = _CODES) -> np.ndarray:
    """Hash of the ``width`` bytes from each place on."""
    prefix = prefix_hash(data, codes)
    _, inv = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[width:] - prefix[:-width]) * inv[: len(data) - width + 1])


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start and the anchor's fingerprint of all runs, in order."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none.astype(np.uint64)
    h = _window_hash(data, SEED)
    span = LENGTH - SEED + 1
    key = (h & ~_AT) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(key) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    block = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - LENGTH + 1
    anchor = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & _AT
    valid = np.zeros(n, bool)
    size = np.diff(offsets)
    edge = np.zeros(n + 1, np.int32)
    long = size >= LENGTH
    edge[offsets[:-1][long]] += 1
    np.subtract.at(edge, np.minimum(offsets[1:][long] - LENGTH + 1, n), 1)
    valid = np.cumsum(edge[:n]) > 0
    starts = valid.copy()
    starts[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    starts[offsets[:-1][long]] = True
    first = np.flatnonzero(starts)
    # A run ends before the next one or where valid starts end.
    stop = np.flatnonzero(valid & ~np.concatenate((valid[1:], [False])))
    last = np.minimum(np.concatenate((first[1:] - 1, [n - 1])), stop[np.searchsorted(stop, first)]) if len(first) else none
    return first, last, h[anchor[first].astype(np.int64)]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES):
    """(first row, bytes, offsets, place in the row) of whole rows of at most ``limit`` bytes together, or of pieces of one
    longer row, every window of which is in one of them."""
    for i, j in slices(offsets, limit):
        start, end = int(offsets[i]), int(offsets[j])
        if end - start <= limit:
            yield i, data[start:end], offsets[i : j + 1] - start, 0
            continue
        for a in range(start, end - LENGTH + 1, limit):
            own = data[a : min(a + limit + LENGTH - 1, end)]
            yield i, own, np.array([0, len(own)]), a - start


def _anchor_counts(docs: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, own, at, _ in pieces(*buffers(batch.column("text"))):
                yield pa.RecordBatch.from_pydict({"fp": pa.array(runs(own, at)[2].view(np.int64), pa.int64())})

    return docs.select("text").mapInArrow(run, "fp long").groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")


def _bit_map(fps: DataFrame) -> np.ndarray:
    """Bit map of the fingerprints, mixed anew (anchors are smallest hashes, so their leading bits are alike). The executors
    make its blocks; the driver gets those, 2**MAX_BITS bits at most, and no fingerprint."""
    bits = min(MAX_BITS, max(16, (fps.count() * BITS_EACH).bit_length()))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at = np.unique(mix(b.column("fp").to_numpy().view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64())})

    place = F.col("at") + 1
    blocks = fps.mapInArrow(run, "at long").groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in blocks.toLocalIterator():
        own = np.frombuffer(bytes(row["bits"]), np.uint8)
        first = (row["block"] - 1) * len(own)
        out[first : first + len(own)] = own[: len(out) - first]
    return out


def _stretches(docs: DataFrame, marks) -> DataFrame:
    """fp, the stretch of text, its row and the place in the row, of every run with a marked anchor."""

    def run(batches):
        import pyarrow as pa

        packed = marks.value
        shift = np.uint64(64 - (len(packed) * 8).bit_length() + 1)
        for batch in batches:
            file, place = (batch.column(c).to_numpy() for c in ("_file", "_at"))
            for i, own, at, begin in pieces(*buffers(batch.column("text"))):
                first, last, fp = runs(own, at)
                bit = (mix(fp) >> shift).astype(np.int64)
                keep = (packed[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
                first, last, fp = first[keep], last[keep], fp[keep]
                size = last - first + LENGTH
                ends = np.concatenate(([0], np.cumsum(size)))
                text = own[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
                doc = np.searchsorted(at, first, side="right") - 1
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(text.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_pydict({"fp": pa.array(fp.view(np.int64), pa.int64()), "stretch": column, "_file": pa.array(file[i + doc], pa.int64()), "_at": pa.array(place[i + doc], pa.int64()), "at": pa.array(begin + first - at[doc], pa.int64())})

    made = numbered(docs, "text").mapInArrow(run, "fp long, stretch binary, _file long, _at long, at long")
    return made.withColumn("x", F.xxhash64("stretch"))


class SuffixLevels:
    """Suffix arrays of distinct windows: sizes fall geometrically, equal sizes are merged. A level is the sorted window
    fingerprints (two words each) and the number of a window that has each."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.repeated = np.zeros(0, bool)

    def add(self, key: np.ndarray, check: np.ndarray) -> None:
        """Puts in the next windows; marks those, and earlier ones, that are equal to another."""
        base = len(self.repeated)
        self.repeated = np.concatenate((self.repeated, np.zeros(len(key), bool)))
        order = np.lexsort((check, key))
        key, check, number = key[order], check[order], base + order
        same = (key[1:] == key[:-1]) & (check[1:] == check[:-1])
        head = np.concatenate(([True], ~same))[: len(key)]
        self.repeated[number[1:][same]] = True
        self.repeated[number[:-1][same]] = True
        fresh = head.copy()
        for old_key, old_check, old_number in self.levels:
            at = np.searchsorted(old_key, key)
            # Equal first words are almost always one entry; look at the following ones while there are any.
            while True:
                inside = np.flatnonzero(at < len(old_key))
                inside = inside[old_key[at[inside]] == key[inside]]
                if not len(inside):
                    break
                hit = inside[old_check[at[inside]] == check[inside]]
                self.repeated[number[hit]] = True
                self.repeated[old_number[at[hit]]] = True
                fresh[hit] = False
                at[inside] += 1
        level = (key[fresh], check[fresh], number[fresh])
        while self.levels and len(self.levels[-1][0]) <= len(level[0]):
            level = tuple(np.concatenate(pair) for pair in zip(self.levels.pop(), level, strict=True))
            order = np.argsort(level[0], kind="stable")
            level = tuple(x[order] for x in level)
        self.levels.append(level)


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint words of all windows within each stretch, and the number of each stretch's."""
    n = np.diff(offsets) - LENGTH + 1
    at = np.repeat(offsets[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return _window_hash(data, LENGTH)[at], _window_hash(data, LENGTH, _CODES2)[at], n


def _intervals(repeated: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each stretch, first and last repeated window of every unbroken row of them, as int32 pairs."""
    edge = np.zeros(len(repeated) + 1, bool)
    edge[np.concatenate(([0], np.cumsum(n)))] = True
    first = np.flatnonzero(repeated & (edge[:-1] | ~np.concatenate(([False], repeated[:-1]))))
    last = np.flatnonzero(repeated & (edge[1:] | ~np.concatenate((repeated[1:], [False]))))
    base = np.cumsum(n) - n
    of = np.searchsorted(base, first, side="right") - 1
    pairs = np.stack((first - base[of], last - base[of]), 1).astype("<i4")
    cuts = np.searchsorted(of, np.arange(len(n) + 1))
    return [pairs[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _repeats(distinct: DataFrame, tasks: int) -> DataFrame:
    """fp, x, pairs: the repeated windows of each distinct stretch."""

    def run(batches):
        import pyarrow as pa

        levels, fps, xs, sizes, several = SuffixLevels(), [], [], [], []
        for b in batches:
            data, offsets = buffers(b.column("stretch"))
            for i, j in slices(offsets):
                key, check, n = _windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                levels.add(key, check)
                sizes.append(n)
            fps.append(b.column("fp").to_numpy())
            xs.append(b.column("x").to_numpy())
            several.append(b.column("n").to_numpy() > 1)
        if not fps:
            return
        n = np.concatenate(sizes)
        repeated = levels.repeated | np.repeat(np.concatenate(several), n)
        pairs = _intervals(repeated, n)
        found = np.array([len(p) > 0 for p in pairs], bool)
        yield pa.RecordBatch.from_pydict({"fp": pa.array(np.concatenate(fps)[found], pa.int64()), "x": pa.array(np.concatenate(xs)[found], pa.int64()), "pairs": pa.array([p for p in pairs if p], pa.binary())})

    return distinct.repartition(tasks, "fp").select("fp", "x", "n", "stretch").mapInArrow(run, "fp long, x long, pairs binary")


def _hot_repeats(distinct: DataFrame) -> DataFrame:
    """The same for stretches whose fingerprint has too many: every window is a row."""

    def expand(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = buffers(b.column("stretch"))
            for i, j in slices(offsets, 1 << 18):
                key, check, n = _windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                of = i + np.repeat(np.arange(j - i), n)
                yield pa.RecordBatch.from_pydict({c: b.column(c).take(pa.array(of)) for c in ("fp", "x", "n")} | {"w1": pa.array(key.view(np.int64), pa.int64()), "w2": pa.array(check.view(np.int64), pa.int64()), "o": pa.array(np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), pa.int32())})

    each = written(distinct.select("fp", "x", "n", "stretch").mapInArrow(expand, "fp long, x long, n long, w1 long, w2 long, o int"), "hot-windows")
    more = each.groupBy("w1", "w2").agg(F.sum("n").alias("all")).where("all > 1")
    singles = each.join(more, ["w1", "w2"], "left_semi").select("fp", "x", "o")

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            os = b.column("os")
            pairs = np.repeat(os.flatten().to_numpy().astype("<i4"), 2)
            ends = np.concatenate(([0], np.cumsum(os.value_lengths().to_numpy()))).astype(np.int64) * 8
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(os), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(pairs.tobytes())])
            yield pa.RecordBatch.from_pydict({"fp": b.column("fp"), "x": b.column("x"), "pairs": packed.cast(pa.binary())})

    grouped = singles.groupBy("fp", "x").agg(F.collect_list("o").alias("os"))  # at most LENGTH windows a stretch
    return grouped.mapInArrow(pack, "fp long, x long, pairs binary")


def removals(docs: DataFrame) -> DataFrame:
    """_file, _at, spans: what is removed of each row that loses anything, as sorted (first, end) int64 pairs of bytes that
    neither overlap nor touch. ``docs``: :func:`from_files`."""
    spark = docs.sparkSession
    fps = written(_anchor_counts(docs), "anchors")
    marks = spark.sparkContext.broadcast(_bit_map(fps))
    drop_written(fps)
    runs_ = written(_stretches(docs, marks), "stretches")
    distinct = runs_.groupBy("fp", "x", "stretch").agg(F.count(F.lit(1)).alias("n"))
    distinct = written(distinct, "distinct-stretches")
    per = distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("stretch")).alias("bytes"))
    hot = written(per.where(F.col("m") > HOT).select("fp"), "hot-anchors")
    total = distinct.agg(F.sum(F.octet_length("stretch"))).first()[0] or 0
    found = _repeats(distinct.join(hot, "fp", "left_anti"), max(1, int(-(-total // TASK_BYTES)))).unionByName(_hot_repeats(distinct.join(hot, "fp", "left_semi")))
    found = written(found, "repeats")
    # A passage that very many rows have is met by broadcast, all others by a shuffle.
    many = runs_.groupBy("fp", "x").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > runs_.count() * HOT_SHARE)
    popular = F.broadcast(written(found.join(F.broadcast(many.drop("size")), ["fp", "x"]), "popular-repeats"))
    at = runs_.select("fp", "x", "_file", "_at", "at")
    keys = popular.select("fp", "x")
    placed = at.join(popular, ["fp", "x"]).unionByName(at.join(keys, ["fp", "x"], "left_anti").join(found, ["fp", "x"])).select("_file", "_at", "at", "pairs")

    def shift(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = buffers(b.column("pairs"))
            pairs = data.view("<i4").astype(np.int64) + np.repeat(b.column("at").to_numpy(), np.diff(offsets) // 4)
            ends = (offsets * 2).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"_file": b.column("_file"), "_at": b.column("_at"), "pairs": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(pairs.tobytes())]).cast(pa.binary())})

    moved = placed.mapInArrow(shift, "_file long, _at long, pairs binary")

    def merge(batches):
        import pyarrow as pa

        for b in batches:
            spans = []
            for own in b.column("pairs").to_pylist():
                p = np.frombuffer(b"".join(own), "<i8").reshape(-1, 2)
                p = p[np.argsort(p[:, 0], kind="stable")]
                end = np.maximum.accumulate(p[:, 1] + LENGTH)
                new = np.concatenate(([True], p[1:, 0] > end[:-1]))
                last = np.append(np.flatnonzero(new)[1:] - 1, len(p) - 1)
                spans.append(np.stack((p[new, 0], end[last]), 1).astype("<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"_file": b.column("_file"), "_at": b.column("_at"), "spans": pa.array(spans, pa.binary())})

    # The pieces of one text meet: no more of them than the text has bytes.
    out = written(moved.groupBy("_file", "_at").agg(F.collect_list("pairs").alias("pairs")).mapInArrow(merge, "_file long, _at long, spans binary"), "removals")
    for x in (runs_, distinct, hot, found):
        drop_written(x)
    return out


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes as text) of every row."""
    docs = from_files(docs.select("doc_id", "text"))
    gone = removals(docs)
    maps = row_maps(gone)
    whole = split_by_rows(docs, maps, False).withColumn("spans", F.lit(None).cast("binary"))
    # Merged at every size: a plan that broadcasts small spans says nothing about large ones.
    cut_ = split_by_rows(docs, maps, True, "doc_id", "text", "_file", "_at").join(gone.hint("merge"), ["_file", "_at"], "left").select("doc_id", "text", "spans")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ids, lists, bounds = batch.column("doc_id").cast(pa.int64()), batch.column("spans").to_pylist(), offsets.tolist()
            for i, j in slices(offsets):
                kept, removed, n_spans = [], [], []
                for t in range(i, j):
                    own = data[bounds[t] : bounds[t + 1]]
                    p = np.frombuffer(lists[t] or b"", "<i8").reshape(-1, 2)
                    if len(p) and p[-1, 1] > len(own):
                        raise ValueError("the documents changed between two scans")
                    if len(p):
                        edges = np.concatenate(([0], p.ravel(), [len(own)])).tolist()
                        kept.append(b"".join(own[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    else:
                        kept.append(own.tobytes())
                    removed.append(int((p[:, 1] - p[:, 0]).sum()))
                    n_spans.append(len(p))
                out = {
                    "doc_id": ids.slice(i, j - i),
                    "n_bytes": pa.array(np.diff(offsets[i : j + 1]), pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "n_spans": pa.array(n_spans, pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                }
                if with_text:
                    out["text"] = pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return whole.unionByName(cut_).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text string" if with_text else ""))
