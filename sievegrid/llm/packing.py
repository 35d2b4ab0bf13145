"""Packing by concatenating and cutting.

All documents, each closed by an end id, form one long run of token ids that is cut every
``window`` ids.  Two passes: the first tokenizes once, stores the ids and counts them within
each task; the prefix sums of the task totals (one number a task) then give every document
its global place, and the second pass cuts without any shuffle.  A document that crosses a
cut leaves boundary records: one piece in each sequence.  Only the last sequence is short.

Null and empty texts are documents of one id, the end id; a null or repeated id is carried
through as it stands; an empty table gives no pieces.  A text of any length is cut into as
many pieces as it needs.  Other columns are never read, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.memory import lean
from . import store
from .tokens import token_rows

WINDOW = 4096


def part_offsets(rows: DataFrame) -> dict[int, int]:
    """Ids before each task's first: prefix sums over one total a task."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    out, done = {}, 0
    for r in sorted(totals):
        out[r["part"]] = done
        done += r["n"]
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    ``ids`` are little-endian unsigned 32-bit; ``offset`` is the piece's place in its sequence.
    """
    rows = store.keep(token_rows(docs, tokenizer, id_col=id_col, text_col=text_col).drop("counts"), "pack-tokens")
    base = part_offsets(rows)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(3).to_numpy()
            first = batch.column(2).to_numpy() + np.array([base[p] for p in batch.column(1).to_pylist()], np.int64)
            pieces = (first + n - 1) // window - first // window + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[doc] // window + k
            begin = np.maximum(sequence * window, first[doc])
            end = np.minimum((sequence + 1) * window, first[doc] + n[doc])
            a, b = begin - first[doc], end - first[doc]
            ids, crc, last, buf = [], [], -1, None
            width = 2
            for d, i, j in zip(doc.tolist(), a.tolist(), b.tolist(), strict=True):
                if d != last:
                    raw = batch.column(4)[d].as_buffer()
                    width, last = len(raw) // int(n[d]), d
                    buf = np.frombuffer(raw, f"<u{width}")
                x = buf[i:j].astype("<u4").tobytes()
                crc.append(zlib.crc32(x))
                if keep_ids:
                    ids.append(x)
            columns = [batch.column(0).take(pa.array(doc)), pa.array(a), pa.array(b - a), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(sequence), pa.array(begin - sequence * window)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * keep_ids, names=names)

    return rows.mapInArrow(lean(cut), schema)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids binary): each sequence's ids, padded to ``window``.

    A sequence that is not full is padded to the next power of two instead.
    """

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("offset")
        ids = b"".join(x.as_py() for x in group.column("ids"))
        n = len(ids) // 4
        size = window if n == window else 1 << (n - 1).bit_length()
        ids += np.full(size - n, pad_id, "<u4").tobytes()
        return pa.table({"sequence_id": group.column("sequence_id")[:1], "n_tokens": pa.array([n], pa.int64()), "ids": pa.array([ids], pa.binary())})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id long, n_tokens long, ids binary")
