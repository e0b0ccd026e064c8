"""A running log of streams: starts, batches, ends."""

from __future__ import annotations

from collections import deque

from pyspark.sql.streaming import StreamingQueryListener


class ProgressLog(StreamingQueryListener):
    """Keeps the latest lines; add it with `spark.streams.addListener`."""

    def __init__(self, most: int = 1000) -> None:
        self.lines: deque[str] = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        self.lines.append(f"started {event.name or event.id}")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.lines.append(f"batch {p.batchId}: {p.numInputRows} rows")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.lines.append("failed" if event.exception else "stopped")
