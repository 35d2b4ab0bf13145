"""Stages of a streaming job: fingerprints, release in order, batches, the two-pass sink, control."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import dedupe, ordering, validate


def with_fingerprint(stream: DataFrame, text_col: str, out: str = "fingerprint") -> DataFrame:
    """A stateless hash stage."""
    return stream.withColumn(out, dedupe.fingerprint(F.col(text_col)))


def in_order(stream: DataFrame, by: str, index_col: str, payload: str, flush_ms: int | None = None) -> DataFrame:
    """(by, index, payload, released): rows of every key in the order of their indices, from 0 on.

    A row waits in the state until all before it have come, so state holds what is out of
    order, as arrays of the payload's own type; ``released`` numbers a key's rows as they go.  A key without new
    rows is not touched.  An index that comes again after its release is dropped.  With ``flush_ms`` a key idle for that long releases what it holds, gaps
    and all.  Rows with a null index are never released.
    """
    kind = stream.schema[payload].dataType.simpleString()

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, done, waits, held = state.get if state.exists else (0, 0, [], [])
        if state.hasTimedOut:
            out = sorted(zip(waits, held, strict=True), key=lambda x: x[0])
            state.remove()
        else:
            new: dict[int, Any] = {}
            for b in batches:
                for i, v in zip(b[index_col].tolist(), b[payload].tolist(), strict=True):
                    if i is not None and i == i and i >= expected:
                        new.setdefault(int(i), v)
            out, start = [], expected
            waiting = None if not waits or min(waits) > expected + len(new) else dict(zip(waits, held, strict=True))
            while expected in new or waiting and expected in waiting:
                out.append((expected, waiting.pop(expected) if waiting and expected in waiting else new[expected]))
                expected += 1
            early = {i: v for i, v in new.items() if i >= expected}
            if waiting is not None:
                early |= {i: v for i, v in waiting.items() if i >= expected}
                waits, held = list(early), list(early.values())
            elif early:
                known = set(waits)
                waits = [*waits, *(i for i in early if i not in known)]
                held = [*held, *(v for i, v in early.items() if i not in known)]
            state.update((expected, done + expected - start, waits, held))
            if flush_ms:
                state.setTimeoutDuration(flush_ms)
        if out:
            yield pd.DataFrame({by: key[0], index_col: [i for i, _ in out], payload: pd.Series([v for _, v in out], dtype=object), "released": range(done, done + len(out))})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if flush_ms else GroupStateTimeout.NoTimeout
    rows = stream.select(F.col(by).cast("string").alias(by), F.col(index_col).cast("long").alias(index_col), payload)
    return rows.groupBy(by).applyInPandasWithState(step, f"{by} string, {index_col} long, {payload} {kind}, released long", f"expected long, done long, waits array<long>, held array<{kind}>", "append", timeout)


def in_batches(write: Callable[[DataFrame, int], None], order: str, size: int) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands over rows numbered in batches of ``size``; the last, short one is flushed too."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            write(ordering.micro_batches(batch, order, size), batch_id)
        finally:
            batch.unpersist()

    return each


def two_pass_sink(id_col: str, results: DataFrame, write: Callable[[DataFrame, str, int], None], reject: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over (id, unique_id, is_duplicate): originals first, copies after.

    Validates first: items whose representative has no row in ``results`` go to ``reject`` and
    to neither pass.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            known = results.withColumnRenamed(id_col, "unique_id")
            reject(validate.absent(batch, known, "unique_id"), batch_id)
            ready = batch.join(known, "unique_id")
            write(ready.where(~F.col("is_duplicate")), "originals", batch_id)
            write(ready.where("is_duplicate"), "copies", batch_id)
        finally:
            batch.unpersist()

    return each


def with_results(plan: DataFrame, results: DataFrame, time_col: str, late: str, within: str) -> DataFrame:
    """The sink stage of a stream: (id, unique_id, pass, the results' columns) for every row of the plan.

    ``plan`` has (id, unique_id, time), ``results`` (unique_id, time, ...); both are streams and may come in any
    order, up to ``late`` behind the latest.  A result belongs to a row if their times are no more than
    ``within`` apart.  ``pass`` is original, copy, or missing once no result can come any more; state holds only what
    is not older than that.
    """
    id_col = next(c for c in plan.columns if c not in ("unique_id", time_col))
    left = plan.withWatermark(time_col, late).withColumnsRenamed({time_col: "sg_planned"})
    right = results.withWatermark(time_col, late).withColumnsRenamed({time_col: "sg_done", "unique_id": "sg_result"})
    near = F.expr(f"unique_id = sg_result AND sg_done >= sg_planned - INTERVAL {within} AND sg_done <= sg_planned + INTERVAL {within}")
    joined = left.join(right, near, "left_outer")
    kind = F.when(F.col("sg_result").isNull(), "missing").when(F.col(id_col) == F.col("unique_id"), "original").otherwise("copy")
    return joined.select(id_col, "unique_id", kind.alias("pass"), *(c for c in results.columns if c not in ("unique_id", time_col)))


def split_sink(write: Callable[[DataFrame, str, int], None], reject: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over rows with ``pass``: originals, then copies, then what is missing."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            write(batch.where("pass = 'original'"), "originals", batch_id)
            write(batch.where("pass = 'copy'"), "copies", batch_id)
            reject(batch.where("pass = 'missing'"), batch_id)
        finally:
            batch.unpersist()

    return each


class Control:
    """Stop and pause flags that another thread may set."""

    def __init__(self) -> None:
        self.stop, self.pause = threading.Event(), threading.Event()


def supervise(start: Callable[[], StreamingQuery], control: Control, on_progress: Callable[[dict], None] | None = None, timeout_s: float = 600, poll_s: float = 0.1) -> tuple[bool, str]:
    """Run a stream under ``control``: (ok, message).

    A pause ends the query, whose checkpoint keeps its place, and the resumption starts it
    again; a stop or the timeout ends it; an error in it is a failed run.  ``on_progress`` gets each
    new progress report.
    """
    until, seen, query = time.monotonic() + timeout_s, None, start()
    while True:
        if query is None and not control.pause.is_set():
            query = start()
        if query is not None:
            report = query.lastProgress
            if on_progress and report is not None and report["batchId"] != seen:
                seen = report["batchId"]
                on_progress(report)
            if not query.isActive:
                error = query.exception()
                return error is None, "done" if error is None else str(error)
        if control.stop.is_set() or time.monotonic() > until:
            if query is not None:
                query.stop()
            return False, "stopped" if control.stop.is_set() else f"stopped after {timeout_s:g} s"
        if control.pause.is_set() and query is not None:
            query.stop()
            query = None
        time.sleep(poll_s)
