"""Progress of streaming queries, as lines for a log or a console."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Says when a query starts and ends, and every `every` batches how many rows it has read."""

    def __init__(self, say: Callable[[str], None] = print, every: int = 1):
        self.say, self.every = say, max(1, every)

    def onQueryStarted(self, event) -> None:
        self.say(f"[stream] {event.name or event.id} started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.batchId % self.every == 0:
            self.say(f"[stream] {p.name or p.id} batch {p.batchId}: {p.numInputRows} rows")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.say(f"[stream] {event.id} ended" + (f": {event.exception}" if event.exception else ""))
