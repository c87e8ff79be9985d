"""Token ids in binary files: a static range asymmetric numeral system with shared frequency tables.

A first pass over all ids counts them; the counts become one frequency table whose entries add up to a power of two.
Documents are put in ascending doc_id order by a range partitioning and gathered, whole, into blocks of about
``BLOCK_TOKENS`` ids. A block is coded by itself: its ids are dealt over interleaved lanes, each with its own 64-bit
state, and all lanes step together, so coding is vectorised. A block holds its documents' ids and lengths, the lanes'
states at the start and at every checkpoint, the 32-bit words, and a checksum; any stretch between two checkpoints can
be decoded by itself. Blocks are the rows of Parquet files, in order, with the number of tokens before them in their
part, so Spark's commit protocol covers lost executors.

Layout of a block, little-endian: magic 'RNS1', then eight uint32 (lanes, steps, tokens, documents, checkpoint interval
in steps, number of words, bytes of the document table, crc32 of the frequency table); the document table (zlib: int64
doc_ids, a null mask as bytes, int64 lengths); start states (uint64 a lane); for each checkpoint a uint32 word position
and the states; the words (uint32); crc32 of all before (uint32).

A null text counts as empty: its document holds the end id only. A null doc_id is kept and sorts first. Rows with equal
doc_id stay in the order of their content. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, new_path, written
from .tokens import encoded, encoder, release

END_ID = 2
BLOCK_TOKENS, MAX_LANES, CHECKPOINT_STEPS = 1 << 18, 1024, 128
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4s8I")
BLOCK = "part int, block int, part_start long, n_docs int, n_tokens long, payload binary"


def token_rows(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids: unsigned 16-bit where the vocabulary allows, else 32-bit."""

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j, ids, counts in encoded(batch, tokenizer, end_id):
                width = id_width(max(encoder(tokenizer).vocabulary, end_id + 1))
                raw = ids.astype(f"<u{width}").tobytes()
                offsets = np.concatenate(([0], np.cumsum(counts * width))).astype(np.int64)
                col = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(i, j - i).cast(pa.int64()), "ids": col.cast(pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids binary")


def id_width(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def token_counts(rows: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs, over all rows. The driver gets one row for each id that occurs."""
    width = id_width(vocabulary)

    def count(batches):
        import pyarrow as pa

        from .textvec import buffers

        release()
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            data, _ = buffers(b.column("ids"))
            total += np.bincount(data.view(f"<u{width}"), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(vocabulary, np.int64)
    for i, n in rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


class Table:
    """Frequencies that add up to 2**bits, at least 1 for whatever occurs."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.freq, self.bits = freq.astype(np.uint64), bits
        self.first = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self._symbols: np.ndarray | None = None

    @classmethod
    def fit(cls, counts: np.ndarray) -> "Table":
        bits = max(12, int(len(counts) - 1).bit_length() + 2)
        whole, occurs = 1 << bits, counts > 0
        freq = np.zeros(len(counts), np.int64)
        if not occurs.any():
            freq[0] = whole
            return cls(freq, bits)
        freq[occurs] = np.maximum(1, counts[occurs] * (whole / counts.sum())).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        excess = int(freq.sum()) - whole
        while excess:
            for i in order:
                step = min(excess, int(freq[i]) // 2) if excess > 0 else excess
                freq[i] -= step
                excess -= step
                if not excess:
                    break
        return cls(freq, bits)

    @property
    def symbols(self) -> np.ndarray:
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.freq)), self.freq.astype(np.int64)).astype(np.uint32)
        return self._symbols


def encode_ids(ids: np.ndarray, table: Table) -> tuple[int, int, np.ndarray, list[tuple[int, np.ndarray]], np.ndarray]:
    """lanes, steps, start states, checkpoints (word position, states) and words."""
    lanes = MAX_LANES
    while lanes > 32 and len(ids) < lanes * 64:
        lanes //= 2
    steps = -(-len(ids) // lanes)
    bits, x = np.uint64(table.bits), np.full(lanes, LOW, np.uint64)
    room, word = np.uint64(63 - table.bits), np.uint64(32)
    out: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    for s in range(steps - 1, -1, -1):
        sym = ids[s * lanes : (s + 1) * lanes]
        f, y = table.freq[sym], x[: len(sym)]
        over = y >= (f << room)
        out.append(y[over].astype(np.uint32))
        y = np.where(over, y >> word, y)
        q = y // f
        x[: len(sym)] = (q << bits) + (y - q * f) + table.first[sym]
        if s and s % CHECKPOINT_STEPS == 0:
            marks.append((len(out), x.copy()))
    sizes = np.array([len(w) for w in out], np.int64)
    total = int(sizes.sum())
    before = [total - int(sizes[:k].sum()) for k, _ in marks]
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    return lanes, steps, x, [(b, m) for b, (_, m) in zip(before, marks, strict=True)][::-1], words


def decode_ids(states: np.ndarray, words: np.ndarray, n: int, table: Table) -> np.ndarray:
    """n ids from the given lane states and the words from their position on."""
    lanes, at = len(states), 0
    x, out = states.copy(), np.empty(n, np.uint32)
    bits, mask, word = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), np.uint64(32)
    symbols = table.symbols
    for a in range(0, n, lanes):
        y = x[: min(lanes, n - a)]
        slot = y & mask
        sym = symbols[slot]
        out[a : a + len(y)] = sym
        y = table.freq[sym] * (y >> bits) + slot - table.first[sym]
        under = y < LOW
        k = int(np.count_nonzero(under))
        y[under] = (y[under] << word) | words[at : at + k]
        at += k
        x[: len(y)] = y
    return out


def write_block(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    lanes, steps, states, marks, words = encode_ids(ids, table)
    known = np.array([d or 0 for d in doc_ids], "<i8")
    docs = zlib.compress(known.tobytes() + bytes(d is None for d in doc_ids) + lengths.astype("<i8").tobytes(), 1)
    parts = [HEAD.pack(b"RNS1", lanes, steps, len(ids), len(doc_ids), CHECKPOINT_STEPS, len(words), len(docs), table.crc), docs, states.astype("<u8").tobytes()]
    for at, m in marks:
        parts += [struct.pack("<I", at), m.astype("<u8").tobytes()]
    body = b"".join([*parts, words.astype("<u4").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    def __init__(self, payload: bytes, table: Table):
        if zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
            raise ValueError("a block's checksum does not match")
        magic, self.lanes, self.steps, self.n, n_docs, self.every, n_words, n_table, crc = HEAD.unpack_from(payload)
        if magic != b"RNS1" or crc != table.crc:
            raise ValueError("not a block of this frequency table")
        at = HEAD.size
        docs = zlib.decompress(payload[at : at + n_table])
        self.doc_ids = np.frombuffer(docs, "<i8", n_docs)
        self.null = np.frombuffer(docs, np.uint8, n_docs, 8 * n_docs).astype(bool)
        self.lengths = np.frombuffer(docs, "<i8", n_docs, 9 * n_docs)
        at += n_table
        self.marks = [(0, np.frombuffer(payload, "<u8", self.lanes, at))]
        at += 8 * self.lanes
        for _ in range((self.steps - 1) // self.every if self.steps else 0):
            self.marks.append((struct.unpack_from("<I", payload, at)[0], np.frombuffer(payload, "<u8", self.lanes, at + 4)))
            at += 4 + 8 * self.lanes
        self.words, self.table = np.frombuffer(payload, "<u4", n_words, at), table

    def stretch(self, k: int) -> np.ndarray:
        """The ids between checkpoints k and k + 1, decoded by themselves."""
        size = self.every * self.lanes
        at, states = self.marks[k]
        return decode_ids(states, self.words[at:], min(size, self.n - k * size), self.table)

    def ids(self) -> np.ndarray:
        return np.concatenate([self.stretch(k) for k in range(len(self.marks))]) if self.n else np.zeros(0, np.uint32)


def write_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Writes ``path``/blocks and ``path``/table."""
    spark = docs.sparkSession
    vocabulary = max(encoder(tokenizer).vocabulary, end_id + 1)
    rows = written(token_rows(docs, tokenizer, end_id), "token-ids")
    table = Table.fit(token_counts(rows, vocabulary))
    spark.createDataFrame([(table.bits, table.freq.astype("<u4").tobytes())], "bits int, freq binary").coalesce(1).write.parquet(f"{path}/table")
    sent, width = spark.sparkContext.broadcast((table.freq.astype(np.int64), table.bits)), id_width(vocabulary)

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .textvec import buffers

        release()
        own = Table(*sent.value)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[int] = []

        def close():
            nonlocal block, start
            ids, n = np.concatenate(held).astype(np.int64), sum(sizes)
            row = {"part": [part], "block": [block], "part_start": [start], "n_docs": [len(names)], "n_tokens": [n], "payload": [write_block(names, np.array(sizes, np.int64), ids, own)]}
            block, start = block + 1, start + n
            for x in (held, names, sizes):
                x.clear()
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("payload", pa.binary())]))

        for b in batches:
            data, offsets = buffers(b.column("ids"))
            ids = data.view(f"<u{width}")
            for d, x, y in zip(b.column("doc_id").to_pylist(), (offsets[:-1] // width).tolist(), (offsets[1:] // width).tolist(), strict=True):
                held.append(ids[x:y].copy())
                names.append(d)
                sizes.append(y - x)
                if len(held) % 64 == 0 or y - x >= BLOCK_TOKENS:
                    if sum(sizes) >= BLOCK_TOKENS:
                        yield close()
        if names:
            yield close()

    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
    ordered.mapInArrow(blocks, BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop_written(rows)


def read_table(spark: SparkSession, path: str) -> tuple[np.ndarray, int]:
    row = spark.read.parquet(f"{path}/table").first()
    return np.frombuffer(row["freq"], "<u4").astype(np.int64), row["bits"]


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids, little-endian unsigned 32-bit) of every document, decoded."""
    sent = spark.sparkContext.broadcast(read_table(spark, path))
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    totals = sorted(blocks.groupBy("part").agg(F.sum("n_tokens")).collect())  # one row for each partition
    before, offsets = 0, []
    for part, n in totals:
        offsets.append((part, before))
        before += n
    starts = spark.createDataFrame(offsets, "part int, before long")

    def decode(batches):
        import pyarrow as pa

        release()
        table = Table(*sent.value)
        for b in batches:
            for first, payload in zip((b.column("before").to_numpy() + b.column("part_start").to_numpy()).tolist(), b.column("payload"), strict=True):
                block = Block(payload.as_py(), table)
                raw, ends = memoryview(block.ids().astype("<u4").tobytes()), np.cumsum(block.lengths)
                spans = list(zip((4 * (ends - block.lengths)).tolist(), (4 * ends).tolist(), strict=True))
                out = {
                    "doc_id": pa.array(block.doc_ids, pa.int64(), mask=block.null),
                    "start": pa.array(first + ends - block.lengths, pa.int64()),
                    "n_tokens": pa.array(block.lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[x:y]) for x, y in spans], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([bytes(raw[x:y]) for x, y in spans], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    placed = blocks.join(F.broadcast(starts), "part").select("before", "part_start", "payload")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    path = new_path(docs.sparkSession, "token-files")
    write_files(docs, tokenizer, path, end_id)
    return read_files(docs.sparkSession, path)
