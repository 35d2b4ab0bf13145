"""Packed exchange of entries that are keyed by 64-bit hashes.

Entries travel as binary arrays, one row for each task, batch and bucket of keys, which costs
a fraction of a row for each entry.  A bucket's entries are together in one task at the
receiving end, one bucket at a time, so a shuffle partition's share has to fit a worker; the
rows grow with tasks times buckets, which is why a partition has only one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from . import store

BUCKETS_A_PARTITION = 1
ENTRY, FOUND = 0, 1


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession) -> int:
    return partitions(spark) * BUCKETS_A_PARTITION


def schema(columns: int) -> str:
    return "kind int, bucket int, n int, " + ", ".join(f"c{i} binary" for i in range(columns))


def narrow(ids: np.ndarray) -> np.ndarray:
    """Ids in four bytes where they fit."""
    if len(ids) and 0 <= ids.min() and ids.max() < 1 << 32:
        return ids.astype("<u4")
    return ids.astype("<i8")


def pack(by: np.ndarray, columns: list[np.ndarray], n_buckets: int, kind: int = ENTRY, width: int = 0) -> pa.RecordBatch:
    """A row for each bucket of ``by`` (unsigned keys) with its entries of every column.

    ``width`` columns in all, those that aren't given are null.
    """
    bucket = ((K.mix(by.copy()) >> K.U64(33)) % K.U64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    some, first = np.unique(bucket[order], return_index=True)
    bounds = np.append(first, len(bucket))
    arrays = [pa.array(np.full(len(some), kind, np.int32)), pa.array(some.astype(np.int32)), pa.array(np.diff(bounds).astype(np.int32))]
    arrays += [K.split_binary(c[order], bounds) for c in columns]
    arrays += [pa.nulls(len(some), pa.binary())] * (width - len(columns))
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "bucket", "n", *(f"c{i}" for i in range(len(arrays) - 3))])


def parsed(raw: pa.Buffer, n: int, kind: str) -> np.ndarray:
    if kind == "id":
        return np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<i8").astype(np.int64)
    return np.frombuffer(raw, kind).reshape((n, -1) if len(raw) > n * np.dtype(kind).itemsize else n)


def by_bucket(batches: Iterator[pa.RecordBatch], kinds: list[str], passed: list[pa.RecordBatch] | None = None) -> Iterator[list[np.ndarray]]:
    """The entries of one bucket after another; ``kinds`` names each column's numbers.

    Rows of kind ``FOUND`` go to ``passed`` instead, if it is given.
    """
    at, held = None, []
    for batch in batches:
        if passed is not None:
            found = pc.equal(batch.column(0), FOUND)
            passed.append(batch.filter(found))
            batch = batch.filter(pc.invert(found))
        for i, (bucket, n) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if bucket != at and held:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            at = bucket
            # a copy, so that an entry doesn't keep its whole batch
            held.append([parsed(batch.column(3 + c)[i].as_buffer(), n, kind).copy() for c, kind in enumerate(kinds)])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def received(df: DataFrame) -> DataFrame:
    """Rows dealt by bucket and sorted by kind and bucket."""
    return df.repartition(partitions(df.sparkSession), "bucket").sortWithinPartitions("kind", "bucket")


def passing(rows: DataFrame, kinds: list[str], width: int, settle: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What ``settle`` makes of each bucket's entries, and the rows found before, which came along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        for columns in by_bucket(batches, kinds, passed):
            yield from settle(columns)
            yield from passed
            passed.clear()
        yield from passed

    return received(rows).mapInArrow(run, schema(width))


def groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by ``columns`` (the first decides first), and which entries differ from the one before in all but the last."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns[:-1]])
    return order, new


HOT_KEY = 2


def shared_keys(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], hot: int, name: str) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, keys binary): of every document the keys that others hold too; and the hot keys.

    ``keys_of`` gives the keys of a batch and the ids that hold them.  A batch sends a key with
    two of its documents at most, and finds for itself that these and all others share it; so a
    key that a third of all documents hold is no burden to the task where it meets.  Hot are
    keys with more than ``hot`` entries after that, at most one in ``hot`` entries.
    """
    n_buckets = buckets(rows.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = keys_of(batch)
            order, new = groups(keys, owners)
            keys, owners = keys[order], owners[order]
            once = new.copy()
            once[1:] |= owners[1:] != owners[:-1]
            keys, owners, new = keys[once], owners[once], new[once]
            if not len(keys):
                continue
            second = np.append(False, new[:-1]) & ~new
            sent = new | second
            yield pack(keys[sent], [keys[sent], narrow(owners[sent])], n_buckets)
            found = ~new | np.append(~new[1:], False)
            if found.any():
                yield pack(owners[found].view(K.U64), [keys[found], narrow(owners[found])], n_buckets, FOUND)

    def settle(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order, new = groups(*columns)
        keys, owners = (c[order] for c in columns)
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(keys)))
        found = np.repeat(np.maximum.reduceat(owners, starts) != owners[starts], size)
        if found.any():
            yield pack(owners[found].view(K.U64), [keys[found], narrow(owners[found])], n_buckets, FOUND)
        big = keys[starts][size > hot]
        if len(big):
            yield pack(big, [big, np.zeros(len(big), "<i8")], n_buckets, HOT_KEY)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, owners in by_bucket(batches, ["<u8", "id"]):
            order, new = groups(owners, keys)
            keys, owners = keys[order], owners[order]
            once = new.copy()
            once[1:] |= keys[1:] != keys[:-1]
            keys, owners = keys[once], owners[once]
            starts = np.flatnonzero(new[once])
            yield pa.RecordBatch.from_arrays([pa.array(owners[starts]), K.split_binary(keys, np.append(starts, len(keys)))], names=["doc_id", "keys"])

    found = store.keep(passing(rows.mapInArrow(send, schema(2)), ["<u8", "id"], 2, settle), name, "none")
    # a number of keys that the driver and the workers hold easily
    keys = [np.frombuffer(r["c0"], np.uint64) for r in found.where(F.col("kind") == HOT_KEY).select("c0").collect()]
    return received(found.where(F.col("kind") == FOUND)).mapInArrow(gather, "doc_id long, keys binary"), np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]))
