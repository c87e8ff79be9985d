"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Texts become token ids with an end id; only what is longer than the capacity is cut, into full pieces and a last one.
Lengths are whole numbers up to the capacity, so pieces and gaps, sorted by size, are runs of equal members: the sorted
order is held as (size, number) and never grows beyond the capacity, however many pieces there are. A round takes one
length, the longest first: a sweep over the gap runs finds the successors (the smallest gaps that are large enough),
members of the run are matched to members of the gaps by rank, the gaps are updated, and the next round begins. What
finds no gap opens new sequences. The rounds are planned on the runs; a plan line says that pieces of ranks r.. of a
length go to sequences s.. at an offset. Pieces get their rank within their length from counts by partition and look
their line up, so no row is shuffled for a round.

Nulls and empty texts are one piece, the end id. Rows that repeat are packed each. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encoded, release

CAPACITY, END_ID = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece; nth: how many pieces of its length came before it in its partition."""

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for i, j, ids, counts in encoded(batch, tokenizer, end_id):
                n = -(-counts // capacity)
                doc = np.repeat(np.arange(j - i), n)
                piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(counts[doc] - start, capacity)
                at = np.concatenate(([0], np.cumsum(length)))
                raw = memoryview(ids.astype("<u4").tobytes())
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                nth = np.empty(len(order), np.int64)
                nth[order] = np.arange(len(order)) - np.searchsorted(ranked, ranked) + seen[ranked]
                seen += np.bincount(length, minlength=capacity + 1)
                out = {
                    "doc_id": batch.column("doc_id").slice(i, j - i).cast(pa.int64()).take(pa.array(doc)),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                    "part": pa.array(np.full(len(doc), part), pa.int32()),
                    "nth": pa.array(nth, pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([bytes(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit rounds on runs. Rows (length, first rank, number, first sequence, offset), sorted by length and rank."""
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap size: runs (first sequence, number)
    filled = np.zeros(capacity + 1, bool)
    lines: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def place(length: int, rank: int, run: tuple[int, int], gap: int, left: int) -> int:
        """Fills sequences of the run with members of one length; returns how many members were placed."""
        first, number = run
        each = gap // length
        whole = min(number, left // each)
        placed = 0
        if whole:
            for k in range(each):
                lines.append((length, rank + placed, whole, first, capacity - gap + k * length))
                placed += whole
            put(gap - each * length, (first, whole))
        if whole < number:
            rest = min(left - placed, each)
            for k in range(rest):
                lines.append((length, rank + placed, 1, first + whole, capacity - gap + k * length))
                placed += 1
            if rest:
                put(gap - rest * length, (first + whole, 1))
            if number > whole + (rest > 0):
                put(gap, (first + whole + (rest > 0), number - whole - (rest > 0)))
        return placed

    def put(gap: int, run: tuple[int, int]) -> None:
        if gap:
            gaps[gap].append(run)
            filled[gap] = True

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            after = np.flatnonzero(filled[length:])
            if not len(after):
                each = capacity // length
                number = -(-(total - rank) // each)
                rank += place(length, rank, (opened, number), capacity, total - rank)
                opened += number
                continue
            gap = length + int(after[0])
            run = gaps[gap].pop()
            filled[gap] = bool(gaps[gap])
            rank += place(length, rank, run, gap, total - rank)
    out = np.array(lines, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    by_part = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = written(by_part.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "piece-counts")
    counts = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("n")).collect()}  # at most one row for each length
    lines = plan(counts, capacity)
    sent = spark.sparkContext.broadcast(lines)  # bounded by the capacity, not by the number of pieces
    names = [f.name for f in cut.schema if f.name not in ("part", "nth")]

    def assign(batches):
        import pyarrow as pa

        release()
        plan_ = sent.value
        first = np.searchsorted(plan_[:, 0], np.arange(capacity + 2)) if len(plan_) else np.zeros(capacity + 2, np.int64)
        top = int(plan_[:, 1].max()) + 1 if len(plan_) else 1
        key = plan_[:, 0] * top + plan_[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            # The last line of this length that begins at or before the rank.
            at = np.minimum(np.searchsorted(key, length * top + np.minimum(rank, top - 1), side="right"), first[length + 1]) - 1
            line = plan_[at]
            out = {c: b.column(c) for c in names}
            out["sequence_id"] = pa.array(line[:, 3] + rank - line[:, 1], pa.int64())
            out["offset"] = pa.array(line[:, 4], pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in names) + ", sequence_id long, offset long"
    ranked = cut.join(by_part.drop("n"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.select(*names, "rank").mapInArrow(assign, schema)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """sequence_id, its number of tokens, and its ids as little-endian unsigned 32-bit integers."""
    parts = packed(docs, tokenizer, capacity, end_id, with_ids=True)
    joined = F.expr("aggregate(transform(sort_array(collect_list(struct(offset, ids))), p -> p.ids), cast('' as binary), (a, b) -> concat(a, b))")
    return parts.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
