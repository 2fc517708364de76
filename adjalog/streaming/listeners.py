"""Events of streaming queries."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener


class EventLog(StreamingQueryListener):
    """Keeps the newest ``most`` events as (event, query id, rows of the batch)."""

    def __init__(self, most: int = 1000):
        self.most, self.events = most, []

    def _note(self, *event) -> None:
        self.events.append(event)
        del self.events[: -self.most]

    def onQueryStarted(self, event) -> None:
        self._note("started", str(event.id), None)

    def onQueryProgress(self, event) -> None:
        self._note("progress", str(event.progress.id), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._note("idle", str(event.id), None)

    def onQueryTerminated(self, event) -> None:
        self._note("failed" if event.exception else "terminated", str(event.id), None)
