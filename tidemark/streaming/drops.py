"""What streams leave out, counted: rows behind the watermark, and joined rows without a partner."""

from __future__ import annotations

from collections import Counter

from pyspark.sql.streaming import StreamingQueryListener


class DropCounter(StreamingQueryListener):
    """Counts by query id while it is registered (``spark.streams.addListener``).

    ``late`` is what stateful operators got behind the watermark: rows, or partial sums of rows where Spark combines
    them first. ``unmatched_left``, ``unmatched_right`` and ``matched`` come from joins that are ``counted``.
    """

    def __init__(self):
        self.counts: dict[str, Counter] = {}

    def onQueryStarted(self, event) -> None:
        self.counts.setdefault(str(event.id), Counter())

    def onQueryProgress(self, event) -> None:
        own = self.counts.setdefault(str(event.progress.id), Counter())
        own["late"] += sum(state.numRowsDroppedByWatermark for state in event.progress.stateOperators)
        for row in event.progress.observedMetrics.values():
            own.update(row.asDict())

    def onQueryTerminated(self, event) -> None:
        pass
