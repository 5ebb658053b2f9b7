"""Failed downloads that are offered again."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "id long, attempt int, action string"


class Retry(StatefulProcessor):
    """State of one id whose last result was ``retry``: how often it was tried."""

    def __init__(self, most: int, delay_ms: int):
        self.most, self.delay_ms = most, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tried = handle.getValueState("tried", "attempts int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.tried.get()  # one call to the state store, which costs more than all else here
        attempts = known[0] if known else 0
        for row in sorted(rows, key=lambda r: r["attempt"]):
            if row["attempt"] != attempts + 1:
                continue  # a result that was counted before
            attempts += 1
            if row["status"] != "retry" or attempts >= self.most:
                if known:
                    self.tried.clear()
                yield Row(id=key[0], attempt=attempts, action="given_up" if row["status"] == "retry" else row["status"])
                return
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.delay_ms * 2 ** (attempts - 1))
        if attempts:
            self.tried.update((attempts,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.tried.get()
        if known:
            yield Row(id=key[0], attempt=known[0] + 1, action="offer")


def retried(results: DataFrame, most: int = 3, delay_ms: int = 60_000) -> DataFrame:
    """What follows from a stream of download results (id, attempt from 1, status): ``OUTPUT``.

    A ``retry`` is offered again (``offer``, with the number of the attempt)
    when a processing-time timer runs out: ``delay_ms`` after the first
    attempt, and twice as long after every further one.  After ``most``
    attempts it is ``given_up``.  Other statuses end an id and pass with the
    attempt that had them.  Whoever takes an offer reports to the same stream;
    a result that comes twice counts once.

    Only ids under retry have state, which goes when they end.  Results without an
    id or attempt are left out.  Start the stream within ``tracking.state_store``.
    """
    rows = results.where("id is not null and attempt is not null").select("id", "attempt", "status")
    return rows.groupBy("id").transformWithState(Retry(most, delay_ms), OUTPUT, "Append", "ProcessingTime")
