"""Token ids in a binary file format: static range asymmetric numeral system (rANS).

One frequency table, counted over all documents, is shared by every block.  A block holds
whole documents in ascending id order and stands alone: ``LANES`` interleaved coder states
take turns, so all lanes step together in vector operations.  Checkpoints (states and stream
position) let a decoder start inside a block, and checksums cover the header, the stream and
the ids.

An archive is a folder that needs nothing else: ``table`` with the frequency table, ``blocks``
with the blocks in files that ascend with the document ids.  Both are little-endian.

File format of the table: magic "SGT1", u32 precision bits, u32 symbols, u32 frequency of each
symbol, u32 crc32 of everything before.  That of a block:
  magic "SGR2", u32 documents, u64 ids, u32 lanes, u32 precision bits, u32 stream words,
  u32 checkpoints, u32 crc32 of the table, i64 document ids, u8 null flags, u64 ids of each document,
  checkpoints of (u32 step, u32 word position, u64 states), u64 first states,
  u32 stream, u32 crc32 of the ids (as u32), u32 crc32 of everything before.

Null and empty texts are documents of one id (the end id).  A null document id sorts first
and is kept as null; repeated ids are separate documents.  A text longer than a block makes
its block longer.  Empty tables give an empty archive.  Other columns are never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .tokens import token_rows

LANES, BITS, BLOCK_IDS, CHECK_STEPS = 512, 20, 1 << 17, 128
LOW = 1 << 31
BLOCKS = "part int, seq long, first_start long, n_tokens long, block binary"
_HEAD = struct.Struct("<4sIQIIIII")
MAGIC, TABLE = b"SGR2", b"SGT1"


def frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Counts scaled to sum to 2**bits; every symbol that occurs keeps at least one."""
    total, size = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(1, counts * size // total), 0).astype(np.int64)
    if np.count_nonzero(counts) > size:
        raise ValueError("more symbols than the precision can hold")
    rest = size - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    for i in order.tolist():  # the largest give or take what rounding left
        step = rest if rest > 0 else max(rest, 1 - int(freq[i]))
        freq[i] += step
        rest -= step
        if not rest:
            break
    return freq


def table_bytes(freq: np.ndarray, bits: int = BITS) -> bytes:
    body = struct.pack("<4sII", TABLE, bits, len(freq)) + freq.astype("<u4").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def table_of(raw: bytes) -> tuple[np.ndarray, int]:
    """The frequencies and precision bits of a table; its checksum is verified."""
    if zlib.crc32(memoryview(raw)[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("table checksum differs")
    magic, bits, n = struct.unpack_from("<4sII", raw)
    if magic != TABLE:
        raise ValueError("not a table of this format")
    return np.frombuffer(raw, "<u4", n, 12).astype(np.int64), bits


class Coder:
    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits, self.check = bits, zlib.crc32(table_bytes(freq, bits)[:-4])
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.limit = self.freq << np.uint64(31 - bits + 32)
        self.symbol = np.repeat(np.arange(len(freq)), freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """First states, stream and checkpoints."""
        n = len(ids)
        steps = -(-n // lanes)
        x = np.full(lanes, LOW, np.uint64)
        chunks, marks, words = [], [], 0
        for t in range(steps - 1, -1, -1):
            s = ids[t * lanes : (t + 1) * lanes]
            y = x[: len(s)]
            f = self.freq[s]
            out = y >= self.limit[s]
            if out.any():
                chunk = (y[out] & np.uint64(0xFFFFFFFF)).astype("<u4")
                chunks.append(chunk)
                words += len(chunk)
                y[out] >>= np.uint64(32)
            q = y // f
            y[:] = (q << np.uint64(self.bits)) + (y - q * f) + self.cum[s]
            if t and t % CHECK_STEPS == 0:
                marks.append((t, words, x.copy()))
        stream = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "<u4")
        return x, stream, [(t, words - w, states) for t, w, states in reversed(marks)]

    def decode(self, n: int, x: np.ndarray, stream: np.ndarray, lanes: int = LANES, step: int = 0, at: int = 0) -> np.ndarray:
        """Ids from ``step * lanes`` on, starting with the states ``x`` at stream position ``at``."""
        x = x.copy()
        words, out = stream.astype(np.uint64), np.empty(n - step * lanes, np.int64)
        mask, bits, low, half = np.uint64((1 << self.bits) - 1), np.uint64(self.bits), np.uint64(LOW), np.uint64(32)
        for k in range(0, len(out), lanes):
            y = x[: min(lanes, len(out) - k)]
            slot = y & mask
            s = self.symbol[slot.astype(np.int64)]
            out[k : k + len(y)] = s
            y[:] = self.freq[s] * (y >> bits) + slot - self.cum[s]
            need = np.flatnonzero(y < low)
            if len(need):
                y[need] = (y[need] << half) | words[at : at + len(need)]
                at += len(need)
        return out


def write_block(coder: Coder, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    states, stream, marks = coder.encode(ids)
    parts = [_HEAD.pack(MAGIC, len(doc_ids), len(ids), LANES, coder.bits, len(stream), len(marks), coder.check)]
    parts += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), lengths.astype("<u8").tobytes()]
    for t, at, x in marks:
        parts += [struct.pack("<II", t, at), x.astype("<u8").tobytes()]
    parts += [states.astype("<u8").tobytes(), stream.tobytes(), struct.pack("<I", zlib.crc32(ids.astype("<u4").tobytes()))]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(coder: Coder, block: bytes, from_mark: int = -1) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and the ids (from a checkpoint on, if one is named)."""
    if zlib.crc32(memoryview(block)[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("block checksum differs")
    magic, docs, n, lanes, bits, words, marks, check = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    if bits != coder.bits or check != coder.check:
        raise ValueError("the block was written with another table")
    at = _HEAD.size
    doc_ids = np.frombuffer(block, "<i8", docs, at)
    null = np.frombuffer(block, "u1", docs, at + 8 * docs)
    lengths = np.frombuffer(block, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    size = 8 + 8 * lanes
    step, position, states = 0, 0, np.frombuffer(block, "<u8", lanes, at + marks * size)
    if from_mark >= 0:
        step, position = struct.unpack_from("<II", block, at + from_mark * size)
        states = np.frombuffer(block, "<u8", lanes, at + from_mark * size + 8)
    at += marks * size + 8 * lanes
    ids = coder.decode(n, states.astype(np.uint64), np.frombuffer(block, "<u4", words, at), lanes, step, position)
    if from_mark < 0 and zlib.crc32(ids.astype("<u4").tobytes()) != struct.unpack_from("<I", block, at + 4 * words)[0]:
        raise ValueError("checksum of the ids differs")
    return [None if z else int(d) for d, z in zip(doc_ids, null, strict=True)], lengths, ids


def count_symbols(rows: DataFrame) -> np.ndarray:
    """Sums the tasks' histograms; what reaches the driver is bounded by the vocabulary."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                p = np.frombuffer(x.as_buffer(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["symbol", "n"])

    sums = rows.where("counts is not null").select("counts").mapInArrow(pairs, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    symbol, n = got.column("symbol").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(int(symbol.max()) + 1 if len(symbol) else 1, np.int64)
    out[symbol] = n
    return out


def write_archive(docs: DataFrame, tokenizer: str, parts: int | None = None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode all documents into an archive at ``path`` (a new one in the shared folder by default); returns the path.

    Blocks: (part, seq, first_start, n_tokens, block); parts ascend with the document ids.
    """
    spark = docs.sparkSession
    path = path or store.new_path(spark, "rans-archive")
    rows = store.keep(token_rows(docs, tokenizer, histogram=True, id_col=id_col, text_col=text_col), "rans-tokens")
    freq = frequencies(count_symbols(rows))
    table = spark.sparkContext.broadcast(freq)  # one number a symbol of the vocabulary
    spark.createDataFrame([(bytearray(table_bytes(freq)),)], "frequencies binary").coalesce(1).write.parquet(f"{path}/table")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.where("counts is null").select("doc_id", "n_tokens", "ids").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, done = TaskContext.get().partitionId(), 0, 0
        coder = Coder(table.value)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, done, held
            doc_ids = [d for h in held for d in h[0]]
            lengths, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            block = write_block(coder, doc_ids, lengths, ids)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq]), pa.array([done]), pa.array([len(ids)]), pa.array([block], pa.binary())], names=["part", "seq", "first_start", "n_tokens", "block"])
            seq, done, held = seq + 1, done + len(ids), []
            return out

        for batch in batches:
            n, doc_ids = batch.column(1).to_numpy(), batch.column(0).to_pylist()
            column, low = batch.column(2), 0
            room = BLOCK_IDS - sum(int(h[1].sum()) for h in held)
            while low < len(n):
                total = np.cumsum(n[low:])
                high = low + int(np.searchsorted(total, room, "left")) + 1
                full, high = high <= len(n), min(high, len(n))
                raw = [column[i].as_buffer() for i in range(low, high)]
                ids = np.concatenate([np.frombuffer(x, f"<u{len(x) // int(n[low + i])}").astype(np.int64) for i, x in enumerate(raw)])
                held.append((doc_ids[low:high], n[low:high], ids))
                low = high
                if full:
                    yield flush()
                    room = BLOCK_IDS
        if held:
            yield flush()

    blocks = ordered.mapInArrow(encode, BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    store.drop(rows)
    return path


def opened(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray, int]:
    """An archive's blocks, and its table's frequencies and precision bits."""
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), *table_of(bytes(spark.read.parquet(f"{path}/table").first()["frequencies"]))


def _bases(blocks: DataFrame) -> dict[int, int]:
    """Ids before each file's first."""
    base, done = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):  # one number a file
        base[r["part"]] = done
        done += r["n"]
    return base


def read_range(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """(start, ids binary): the ids from ``low`` up to ``high`` of the whole run, in pieces.

    Only blocks that hold some are read, each from the last checkpoint before them on.
    """
    blocks, freq, bits = opened(spark, path)
    base, table = _bases(blocks), spark.sparkContext.broadcast(freq)
    bases = spark.createDataFrame([(k, v) for k, v in base.items()], "part int, base long")  # one row a file

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table.value, bits)
        for batch in batches:
            for first, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a = max(0, low - first)
                mark = a // (LANES * CHECK_STEPS) - 1
                raw = block.as_buffer().to_pybytes()
                done = 0 if mark < 0 else (mark + 1) * LANES * CHECK_STEPS
                ids = read_block(coder, raw, mark)[2][a - done : high - first - done].astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([first + a]), pa.array([ids.tobytes()], pa.binary())], names=["start", "ids"])

    chosen = blocks.join(F.broadcast(bases), "part").select((F.col("base") + F.col("first_start")).alias("begin"), "n_tokens", "block").where((F.col("begin") < high) & (F.col("begin") + F.col("n_tokens") > low))
    return chosen.select("begin", "block").mapInArrow(decode, "start long, ids binary")


def read_archive(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]): every document of an archive."""
    archive, freq, bits = opened(spark, path)
    base = _bases(archive)
    table = archive.sparkSession.sparkContext.broadcast(freq)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table.value, bits)
        for batch in batches:
            for part, first, block in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4), strict=True):
                doc_ids, lengths, ids = read_block(coder, block.as_buffer().to_pybytes())
                ends = np.cumsum(lengths)
                flat = ids.astype("<u4")
                view = memoryview(flat.tobytes())
                bounds = np.concatenate([[0], ends])
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(base[part] + first + bounds[:-1]), pa.array(lengths), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.array([bytes(view[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=None, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return archive.mapInArrow(decode, schema)
