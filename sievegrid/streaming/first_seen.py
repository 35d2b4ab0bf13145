"""Streaming first-seen dedupe, ordered sinks and the run control around them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(stream: DataFrame, key_col: str, id_col: str, ttl_ms: int | None = None) -> DataFrame:
    """(key, id, unique_id, is_duplicate) for every row of the stream.

    The first id of a key, the least within its micro-batch, represents the key from then
    on.  A null id represents nothing: it is a duplicate once its key has an id.  State holds
    one id a key; with ``ttl_ms`` a key idle for that long is forgotten and its next row is first
    again, without it state grows with the distinct keys.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = state.get[0] if state.exists else None
        # a hot key's batches are not concatenated: its least id is found first, from ids alone
        held = [b[id_col] for b in batches]
        known = [x.min() for x in held if x.notna().any()]
        if first is None and known:
            first = int(min(known))
        if first is not None:
            state.update((first,))
        if ttl_ms and state.exists:
            state.setTimeoutDuration(ttl_ms)
        for ids in held:
            n = len(ids)
            yield pd.DataFrame({key_col: [key[0]] * n, id_col: ids.astype("Int64"), "unique_id": pd.array([first] * n, "Int64"), "is_duplicate": [first is not None and x != first for x in ids.tolist()]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return stream.select(key_col, id_col).groupBy(key_col).applyInPandasWithState(step, f"{key_col} string, {id_col} long, unique_id long, is_duplicate boolean", "first long", "append", timeout)


def ordered_sink(write: Callable[[DataFrame, int], None], *order: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands each micro-batch over sorted; the order ends at the sink."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write(batch.orderBy(*order), batch_id)

    return each


def run(query: StreamingQuery, timeout_s: float = 600, grace_s: float = 5) -> tuple[bool, str]:
    """Wait for the end; past the timeout stop, give it the grace, and report.

    (ok, message): an error in the stream is a failed run.
    """
    try:
        if query.awaitTermination(timeout_s):
            error = query.exception()
            return (error is None), ("done" if error is None else str(error))
        query.stop()
        query.awaitTermination(grace_s)
        return False, f"stopped after {timeout_s:g} s"
    except Exception as e:  # the stream's own failure, told to the caller
        return False, str(e)


def statistics(mapped: DataFrame) -> DataFrame:
    """Counters of a dedupe run, from its output."""
    return mapped.agg(F.count("*").alias("total"), F.sum((~F.col("is_duplicate")).cast("long")).alias("unique_items"), F.sum(F.col("is_duplicate").cast("long")).alias("duplicates"))
