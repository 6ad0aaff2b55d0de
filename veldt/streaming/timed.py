"""Streams whose state changes with time: leases that run out and retries that fall due, on state with event-time timers.

Time is that of the events: a timer fires once the watermark has passed it, so what a stream says doesn't depend on when it runs or how its
rows are cut into batches. Rows of a key are to come in order of their time, as from a log dealt by key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: fixed values: a lease in seconds, and the waits between attempts
LEASE, RETRIES = 120, (30, 300)
#: fixed values: the statuses from which each message leads to its status; others stay as they are
MOVES = {
    "failed": (("in_flight",), "pending"),
    "accepted": (("pending", "in_flight"), "accepted"),
    "rejected": (("pending", "in_flight", "accepted", "deferred", "complete", "superseded", "rejected"), "rejected"),
    "deferred": (("pending", "in_flight", "accepted"), "deferred"),
    "complete": (("pending", "in_flight", "accepted", "deferred", "complete", "superseded", "rejected"), "complete"),
    "superseded": (("pending", "in_flight", "accepted", "deferred", "superseded", "rejected"), "superseded"),
}


class Item:
    """An item of a queue: pending until leased, in flight until answered or its lease has run out."""

    def __init__(self, status: str = "pending", expires: int | None = None, attempts: int = 0, expired: int = 0):
        self.status, self.expires, self.attempts, self.expired = status, expires, attempts, expired

    def pass_time(self, now: int) -> bool:
        """Back to pending if a lease has run out by ``now`` (milliseconds); whether it has."""
        out = self.expires is not None and self.expires <= now
        if out:
            self.status, self.expires, self.expired = "pending", None, self.expired + 1
        return out

    def take(self, kind: str, now: int, lease: int) -> None:
        """A message of some kind at ``now``. A lease is given to a pending item only; unknown kinds only make the item known."""
        self.pass_time(now)
        if kind == "lease" and self.status == "pending":
            self.status, self.expires, self.attempts = "in_flight", now + lease * 1000, self.attempts + 1
        elif kind in MOVES and self.status in MOVES[kind][0]:
            self.status, self.expires = MOVES[kind][1], None


class Leases(StatefulProcessor):
    """One row whenever an item has changed: (key, at_ms, status, attempts, expired)."""

    def __init__(self, key: str, at: str, kind: str, lease: int):
        self.key, self.at, self.kind, self.lease = key, at, kind, lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "status string, expires long, attempts long, expired long")

    def _load(self) -> Item:
        return Item(*self.item.get()) if self.item.exists() else Item()

    def _save(self, key: tuple, item: Item, now: int) -> pd.DataFrame:
        self.item.update((item.status, item.expires, item.attempts, item.expired))
        return pd.DataFrame({self.key: [key[0]], "at_ms": [now], "status": [item.status], "attempts": [item.attempts], "expired": [item.expired]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        item, now = self._load(), 0
        old = item.expires
        parts = [p[[self.at, self.kind]] for p in rows]
        for at, kind in pd.concat(parts).sort_values(self.at, kind="stable").itertuples(index=False):
            now = int(at)
            item.take(kind, now, self.lease)
        if old is not None and old != item.expires:
            self.handle.deleteTimer(old)
        if item.expires is not None and old != item.expires:
            self.handle.registerTimer(item.expires)
        yield self._save(key, item, now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        item, now = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        if item.pass_time(now):
            yield self._save(key, item, now)

    def close(self) -> None:
        pass


def _marked(stream: DataFrame, at: str, delay: str) -> DataFrame:
    return stream.withColumn("__time", F.timestamp_millis(at)).withWatermark("__time", delay)


def leases(stream: DataFrame, key: str, at: str, kind: str, lease: int = LEASE, delay: str = "0 seconds") -> DataFrame:
    """Changes of items, one row for each batch or timer that touched one; ``at`` is in milliseconds, ``key`` a long.

    The kinds are ``lease`` and those of MOVES; messages of one time are taken in the order they lie in. A first message of any kind
    makes a pending item. A null kind does nothing else. An item's last row by (at_ms, batch) is its state.
    """
    out = f"{key} long, at_ms long, status string, attempts long, expired long"
    return _marked(stream, at, delay).groupBy(key).transformWithStateInPandas(Leases(key, at, kind, lease), out, "Update", "EventTime")


class Retries(StatefulProcessor):
    """One row for each message that is done or dead: (key, id, outcome, attempts, at_ms)."""

    def __init__(self, key: str, message: str, at: str, payload: str, handle: Callable[[object, int], bool], waits: tuple[int, ...]):
        self.key, self.message, self.at, self.payload, self.attempt, self.waits = key, message, at, payload, handle, waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: time due -> messages as (id, payload, attempts so far): what waits for one key. It has one timer, for the earliest time, so that a
        #: watermark that moves far calls a key once and not once for each time
        self.waiting = handle.getValueState("waiting", "messages string")

    def _try(self, at: int, messages: list[list], later: dict[int, list[list]]) -> Iterator[list]:
        """Attempt messages at a time; those that fail wait in ``later`` or are dead."""
        for name, payload, attempts in messages:
            if self.attempt(payload, attempts):
                yield [name, "done", attempts + 1, at]
            elif attempts < len(self.waits):
                later.setdefault(at + 1000 * self.waits[attempts], []).append([name, payload, attempts + 1])
            else:
                yield [name, "dead", attempts + 1, at]

    def _load(self) -> dict[int, list[list]]:
        return {int(due): messages for due, messages in json.loads(self.waiting.get()[0]).items()} if self.waiting.exists() else {}

    def _keep(self, later: dict[int, list[list]], watermark: int, timer: int | None) -> Iterator[list]:
        """What the watermark has passed already is tried at once, as a timer for it would wait for another batch; the rest waits for the ``timer`` of the earliest."""
        while later and min(later) <= watermark:
            due = min(later)
            yield from self._try(due, later.pop(due), later)
        first = min(later, default=None)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is None:
            self.waiting.clear()
            return
        if timer != first:
            self.handle.registerTimer(first)
        self.waiting.update((json.dumps(later),))

    def _rows(self, key: tuple, found: list[list]) -> pd.DataFrame:
        return pd.DataFrame([[key[0], *row] for row in found], columns=[self.key, self.message, "outcome", "attempts", "at_ms"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found, later = [], self._load()
        timer = min(later, default=None)
        for part in rows:
            for name, at, payload in part[[self.message, self.at, self.payload]].itertuples(index=False):
                found += self._try(int(at), [[int(name), None if pd.isna(payload) else payload.item() if hasattr(payload, "item") else payload, 0]], later)
        found += self._keep(later, timerValues.getCurrentWatermarkInMs(), timer)
        yield self._rows(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a timer that has fired is gone
        found = list(self._keep(self._load(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), None))
        yield self._rows(key, found)

    def close(self) -> None:
        pass


def retries(stream: DataFrame, key: str, message: str, at: str, payload: str, handle: Callable[[object, int], bool], waits: tuple[int, ...] = RETRIES, delay: str = "0 seconds") -> DataFrame:
    """Outcomes of messages that ``handle(payload, attempts so far)`` may refuse: tried again after each of ``waits`` seconds, then dead.

    ``key`` and ``message`` are longs, ``at`` is in milliseconds, ``payload`` a number or string. A message whose next attempt lies behind the
    watermark's reach still waits in the state and has no row. A key has one timer at a time.
    """
    out = f"{key} long, {message} long, outcome string, attempts long, at_ms long"
    return _marked(stream, at, delay).groupBy(key).transformWithStateInPandas(Retries(key, message, at, payload, handle, waits), out, "Append", "EventTime")
