"""Counters that come along with a job: no second pass, no collecting of rows.

``Counters`` listens to streams: what a stream observes is summed up over its batches by name, and each batch's progress
goes to a callback.  ``counted`` does the same for one batch job.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

_END_S = 30


class Counters(StreamingQueryListener):
    """Sums of observed counts of every query, by its id, and how its batches went."""

    def __init__(self, on_progress: Callable[[str, int, float], None] | None = None) -> None:
        self.on_progress = on_progress
        self.sums: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self.batches: dict[str, int] = defaultdict(int)
        self._ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802  Spark's name
        self._ended[str(event.runId)].clear()

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        run = str(event.progress.runId)
        if event.progress.numInputRows:
            self.batches[run] += 1
        for row in event.progress.observedMetrics.values():
            for name, value in row.asDict().items():
                self.sums[run][name] += value or 0
        if self.on_progress:
            self.on_progress(run, event.progress.numInputRows, event.progress.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        self._ended[str(event.runId)].set()

    def of(self, run: str) -> dict[str, int]:
        """All counts of a query that has ended; events come a little later than the end."""
        self._ended[run].wait(_END_S)
        return dict(self.sums[run])


def counted(rows: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """``rows``, and what holds the counts once an action on them is through."""
    seen = Observation()
    return rows.observe(seen, *(c.alias(name) for name, c in counts.items())), seen
