"""N-gram Jaccard join with a count-vector R-tree.

A document's set is that of its distinct word shingles. Equal sets (by a 128-bit digest and their size) are one class
from the start. Min-hash bands gather the classes that can be similar at all into families, by connected components of
stars around each band value; the bands are so many that a pair at the threshold is missed with a probability below
1e-7, and so long that texts of a similarity of a half rarely meet. (A point of group counts alone can't be placed: the differences a linked pair may have exceed the spread of single
coordinates, so an R-tree over all rows would visit nearly every pair.) Within a family, or a pair of parts of a large
one, shingles are hashed into groups; the group counts are points of an R-tree packed by recursive sorting; the sum of
the coordinate-wise minima of a point and a node's upper corner bounds the overlap; surviving pairs are verified by the
exact intersection of their sets. A pair that is connected already is not verified again, so a family of thousands of
near copies costs a number of verifications in proportion to its size. Verified links are put together to components.

Null or word-less texts have an empty set, link with nothing and are their own component. Rows that repeat are of one
class. A null doc_id takes part; a component's id is its smallest doc_id (null if it has only null ones); rows that share
it tie, and the first by number stays. Very long texts are one set each; a task holds it. Extra columns are ignored, and
kept by ``keep_one_of_each`` whatever their names. An empty table gives an empty table. Texts are scanned twice and rows
are known by file and place, so they agree however many executors there are (sets are verified by their digests all the
same); texts stay where they are read, only the sets of a family's members move.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, from_files, hot_join, numbered, row_maps, sized, split_by_rows, written
from .components import connected
from .textvec import WORD_SPACE, buffers, mix, shingles, slices, word_hashes

#: Shingles (8 bytes each) of one part of a family; two parts are held at once.
PART_SHINGLES = 2_000_000
GROUPS, LEAF, FANOUT = 64, 16, 16


def bands_for(percent: int) -> tuple[int, int]:
    """Rows a band and bands, so that a pair at the threshold is missed with a probability below 1e-7. Long bands keep
    families apart: at 0.85, two sets of similarity 0.5 meet with a probability of 0.18, of 0.3 with one of 0.003."""
    s = percent / 100
    rows = 8 if s >= 0.85 else 6 if s >= 0.8 else 4 if s >= 0.7 else 3 if s >= 0.5 else 2 if s >= 0.3 else 1
    return rows, max(1, math.ceil(math.log(1e-7) / math.log(1 - s**rows)))


def set_digest(own: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(own.sum(dtype=np.uint64).astype(np.int64)), int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, n = shingles(*word_hashes(data, offsets, WORD_SPACE), k)
    ends = np.cumsum(n)
    return [np.unique(h[b - m : b]) for b, m in zip(ends.tolist(), n.tolist(), strict=True)]


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """_file, _at, row (a number of its own), doc_id, n, h1, h2 and the band values (as little-endian int64) of every row."""
    rows, bands = bands_for(percent)
    rng = np.random.default_rng(99)
    a = (rng.integers(0, 2**31, rows * bands, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    b = rng.integers(0, 2**32, rows * bands, dtype=np.uint32)
    weights = rng.integers(0, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                sets = sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                values: list[bytes | None] = [None] * len(sets)
                if len(full):
                    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
                    first = (np.cumsum(size) - size)[full]
                    low = np.empty((len(full), rows * bands), np.uint64)
                    with np.errstate(over="ignore"):
                        for p in range(rows * bands):
                            low[:, p] = np.minimum.reduceat(x * a[p] + b[p], first)
                        v = mix((low.reshape(len(full), bands, rows) * weights).sum(2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    for t, s in zip(full.tolist(), v, strict=True):
                        values[t] = s.tobytes()
                digests = [set_digest(s) for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "_file": batch.column("_file").slice(i, j - i),
                    "_at": batch.column("_at").slice(i, j - i),
                    "row": batch.column("row").slice(i, j - i),
                    "doc_id": batch.column("doc_id").slice(i, j - i).cast(pa.int64()),
                    "n": pa.array(size, pa.int64()),
                    "h1": pa.array([d[0] for d in digests], pa.int64()),
                    "h2": pa.array([d[1] for d in digests], pa.int64()),
                    "bands": pa.array(values, pa.binary()),
                })

    # The number is fixed once this is written; only file and place are asked of the texts again.
    texts = numbered(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return texts.mapInArrow(run, "_file long, _at long, row long, doc_id long, n long, h1 long, h2 long, bands binary")


def band_rows(classes: DataFrame) -> DataFrame:
    """node, band value: one row for each band of each class."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = buffers(b.column("bands"))
            node = np.repeat(b.column("node").to_numpy(), np.diff(offsets) // 8)
            yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "band": pa.array(data.view("<i8"), pa.int64())})

    return classes.select("node", "bands").mapInArrow(run, "node long, band long")


class CountTree:
    """An R-tree over count vectors, packed from points that are sorted recursively by their widest coordinate."""

    def __init__(self, points: np.ndarray, size: np.ndarray):
        self.order = np.concatenate(self._tiles(points, size, np.argsort(size, kind="stable"))) if len(points) else np.zeros(0, np.int64)
        self.points, self.size = points[self.order], size[self.order]
        # levels[0] are the leaves: upper corner, smallest and largest set, first and last child
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        corner, low, high, width = self.points, self.size, self.size, LEAF
        while True:
            first = np.arange(0, len(corner), width)
            last = np.minimum(first + width, len(corner))
            self.levels.append((np.maximum.reduceat(corner, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), first, last))
            corner, low, high, width = *self.levels[-1][:3], FANOUT
            if len(corner) == 1:
                break

    def _tiles(self, points: np.ndarray, size: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        if len(rows) <= LEAF:
            return [rows]
        own = points[rows]
        wide = int((own.max(0) - own.min(0)).argmax())
        rows = rows[np.argsort(own[:, wide], kind="stable")]
        half = max(LEAF, (len(rows) // 2 // LEAF) * LEAF)
        return self._tiles(points, size, rows[:half]) + self._tiles(points, size, rows[half:])

    def labels(self, root: np.ndarray) -> list[np.ndarray]:
        """For each level, the component that all points below a node have, or -1."""
        low = high = root
        out = []
        for _, _, _, first, _ in self.levels:
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            out.append(np.where(low == high, low, -1))
        return out

    def partners(self, query: np.ndarray, root: np.ndarray, labels: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query position, point position) that the bound lets through, of points after the query that are not in
        its component yet."""
        top = len(self.levels) - 1
        q, node = np.repeat(query, len(self.levels[top][3])), np.tile(np.arange(len(self.levels[top][3])), len(query))
        for level in range(top, -1, -1):
            corner, low, high, first, last = self.levels[level]
            keep = labels[level][node] != root[q]
            keep &= (100 * self.size[q] >= percent * low[node]) & (100 * high[node] >= percent * self.size[q])
            q, node = q[keep], node[keep]
            q, node = self._bounded(q, node, corner, self.size[q] + np.maximum(low[node], -(-percent * self.size[q] // 100)), percent)
            width = last[node] - first[node]
            q = np.repeat(q, width)
            node = np.repeat(first[node] - (np.cumsum(width) - width), width) + np.arange(len(q))
        keep = (node > q) & (root[node] != root[q]) & (100 * np.minimum(self.size[q], self.size[node]) >= percent * np.maximum(self.size[q], self.size[node]))
        q, node = q[keep], node[keep]
        return self._bounded(q, node, self.points, self.size[q] + self.size[node], percent)

    def _bounded(self, q: np.ndarray, node: np.ndarray, corner: np.ndarray, both: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Those whose summed minima reach the least overlap that a link between sets of these sizes has."""
        keep = np.zeros(len(q), bool)
        for a in range(0, len(q), 1 << 14):
            s = slice(a, a + (1 << 14))
            keep[s] = np.minimum(self.points[q[s]], corner[node[s]]).sum(1, dtype=np.int64) * (100 + percent) >= percent * both[s]
        return q[keep], node[keep]


def links_within(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Verified links between sets, as many as connect all that links connect."""
    size = np.array([len(s) for s in sets], np.int64)
    groups = GROUPS
    while groups < 512 and size.max() > 64 * groups:
        groups *= 2
    flat = (np.concatenate(sets) >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64)
    points = np.bincount(np.repeat(np.arange(len(sets)), size) * groups + flat, minlength=len(sets) * groups).reshape(len(sets), groups).astype(np.int32)
    tree = CountTree(points, size)
    root, members = np.arange(len(sets)), {i: [i] for i in range(len(sets))}
    out, at, step = [], 0, 1
    while at < len(sets):
        query = np.arange(at, min(at + step, len(sets)))
        for q, p in zip(*(x.tolist() for x in tree.partners(query, root, tree.labels(root), percent)), strict=True):
            if root[q] == root[p]:
                continue
            a, b = tree.order[q], tree.order[p]
            both = len(sets[a]) + len(sets[b])
            common = both - len(np.unique(np.concatenate((sets[a], sets[b]))))
            if 100 * common >= percent * (both - common):
                out.append((int(a), int(b)))
                small, large = sorted((int(root[q]), int(root[p])), key=lambda r: len(members[r]))
                root[members[small]] = large
                members[large] += members.pop(small)
        at += step
        step = min(2 * step, 256)
    return out


def _verified(parts: DataFrame, percent: int) -> DataFrame:
    """u, v: links within each (family, i, j). The input is dealt and sorted by these."""

    def run(batches):
        import pyarrow as pa

        key, nodes, sets = None, [], []

        def close():
            pairs = links_within(sets, percent) if len(sets) > 1 else []
            return pa.RecordBatch.from_pydict({"u": pa.array([nodes[a] for a, _ in pairs], pa.int64()), "v": pa.array([nodes[b] for _, b in pairs], pa.int64())})

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("family", "i", "j")), strict=True))
            data, offsets = buffers(b.column("set"))
            for t, node in enumerate(b.column("node").to_pylist()):
                if keys[t] != key:
                    if sets:
                        yield close()
                    key, nodes, sets = keys[t], [], []
                nodes.append(node)
                sets.append(data[offsets[t] : offsets[t + 1]].copy().view("<u8"))
        if sets:
            yield close()

    dealt = parts.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return dealt.select("family", "i", "j", "node", "set").mapInArrow(run, "u long, v long")


def _sets(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The members with their sets, from a second scan of the texts that computes them where the texts are."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                sets = sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                digests = [set_digest(s) for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "_file": batch.column("_file").slice(i, j - i),
                    "_at": batch.column("_at").slice(i, j - i),
                    "_h1": pa.array([d[0] for d in digests], pa.int64()),
                    "_h2": pa.array([d[1] for d in digests], pa.int64()),
                    "set": pa.array([s.tobytes() for s in sets], pa.binary()),
                })

    own = split_by_rows(docs.select("text"), row_maps(members), True, "_file", "_at", "text")
    made = own.mapInArrow(run, "_file long, _at long, _h1 long, _h2 long, set binary").join(sized(members), ["_file", "_at"])
    same = (F.col("_h1") == F.col("h1")) & (F.col("_h2") == F.col("h2"))
    return made.select("family", "parts", "node", F.when(same, F.col("set")).otherwise(F.raise_error(F.lit("the documents changed between two scans")).cast("binary")).alias("set"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """_file, _at, doc_id, n_shingles, component_id, kept (one row of each component: that of the smallest doc_id)."""
    docs = from_files(docs)
    made = written(signatures(docs, k, percent), "signatures")
    first = F.min(F.struct("row", "_file", "_at", "bands")).alias("first")
    classes = written(
        made.where("n > 0").groupBy("h1", "h2", "n").agg(first).select(F.col("first.row").alias("node"), "first._file", "first._at", "h1", "h2", "n", F.col("first.bands").alias("bands")),
        "classes",
    )
    bands = band_rows(classes)
    centres = bands.groupBy("band").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    near = connected(bands.join(centres, "band").select(F.col("node").alias("u"), "v").where("u <> v"), "families")
    of_family = near.unionByName(near.select(F.col("root").alias("u"), "root").distinct()).withColumnsRenamed({"u": "node", "root": "family"})
    members = classes.select("node", "_file", "_at", "h1", "h2", "n").join(of_family, "node")
    parts = members.groupBy("family").agg(F.ceil(F.sum("n") / F.lit(PART_SHINGLES)).cast("int").alias("parts"))
    members = written(members.join(parts, "family").select("node", "_file", "_at", "family", "parts", "h1", "h2"), "family-members")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = _sets(docs, members, k).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "set")
    links = connected(_verified(dealt, percent), "links")
    drop_written(members)
    rooted = classes.select("node", "h1", "h2", "n").join(links, F.col("node") == F.col("u"), "left").select("h1", "h2", "n", F.coalesce("root", "node").alias("component"))
    placed = written(made.drop("bands").join(rooted, ["h1", "h2", "n"], "left").select("_file", "_at", "row", "doc_id", "n", F.coalesce("component", "row").alias("component")), "placed")
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    drop_written(made)
    joined = hot_join(placed, written(first, "component-groups"), "component")
    return joined.select("_file", "_at", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when every component keeps one, with all their columns."""
    docs = from_files(docs)
    return split_by_rows(docs, row_maps(jaccard_components(docs, k, percent).where(~F.col("kept"))), inside=False)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(list_transform(range(greatest(len(ws) - 3, 1)), lambda i: array_to_string(ws[i + 1 : i + 4], ' '))) AS sh FROM w WHERE len(ws) > 0
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
k AS (SELECT md5(string_agg(g, chr(10) ORDER BY g)) AS h, n, doc_id FROM e GROUP BY doc_id, n),
r AS (SELECT h, n, min(doc_id) AS rep FROM k GROUP BY h, n),
x AS (SELECT e.* FROM e JOIN r ON e.doc_id = r.rep),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT DISTINCT u AS doc_id, u AS c FROM p UNION SELECT reach.doc_id, p.v FROM reach JOIN p ON reach.c = p.u),
root AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(k.n, 0)::BIGINT AS n_shingles, coalesce(root.c, r.rep, w.doc_id) AS component_id
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN r USING (h) LEFT JOIN root ON root.doc_id = r.rep
"""
