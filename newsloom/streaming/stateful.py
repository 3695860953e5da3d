"""Keyed state: retry queue and document states, in the order of event time.

Records wait in their id's state, a chunk of many in one state row, until the
watermark has passed them; a timer then releases them in order. So files may arrive in any order
within the allowed lateness and give what one sorted batch gives. Rows are
read frame by frame, and results leave in frames of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsloom import rules
from newsloom.streaming.jobs import ROCKSDB

RETRY_SCHEMA = "id bigint, seq bigint, event string, attempt bigint, due timestamp"
STATE_SCHEMA = "id bigint, seq bigint, status string, previous string, valid boolean"
FRAME_ROWS = 10_000
NEVER = 0


def backoff_minutes(attempt: int) -> int:
    return min(1440, 5 * 2 ** min(max(0, attempt - 1), 20))


class InEventOrder(StatefulProcessor):
    """Holds an id's records back until the watermark is at their time, then hands them on by (time, seq).

    ``start`` gives an id's first state, a tuple of STATE; ``step(state, seq,
    status, at)`` the next state and output rows; ``wake(state)`` a time at
    which the id wants to act without a record, which ``woken(state, at)``
    does. All times are in microseconds.
    """

    STATE = ""
    COLUMNS: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at array<bigint>, seq array<bigint>, status array<string>")
        self.own = handle.getValueState("own", self.STATE)
        self.alarm = handle.getValueState("alarm", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = NEVER
        for frame in rows:
            at = frame["at"].astype("datetime64[us]").astype("int64")
            if len(at):
                self.waiting.appendValue((at.tolist(), frame["seq"].astype("int64").tolist(), frame["status"].tolist()))
                first = int(at.min()) if first == NEVER else min(first, int(at.min()))
        self._set_alarm(first)
        yield from ()  # results come with the timers; an empty frame an id would cost more than its records

    def _release(self, passed: int) -> tuple[dict, int]:
        """Records up to a time by (time, seq), and the earliest time of the rest, which stay."""
        ready: dict = {}
        coming = NEVER
        left: list[tuple] = []
        for at, seq, status in self.waiting.get():
            rest = [x for x in zip(at, seq, status) if x[0] > passed]
            ready.update(((x[0], x[1]), x[2]) for x in zip(at, seq, status) if x[0] <= passed)
            if rest:
                left.append(tuple(map(list, zip(*rest))))
                earliest = min(left[-1][0])
                coming = earliest if coming == NEVER else min(coming, earliest)
        if ready:
            self.waiting.clear()
            for chunk in left:
                self.waiting.appendValue(chunk)
        return ready, coming

    def _set_alarm(self, at: int) -> None:
        """One timer an id: the earliest time at which something is to be done."""
        now = self.alarm.get()[0] if self.alarm.exists() else NEVER
        if at == NEVER or (now != NEVER and now <= at):
            return
        if now != NEVER:
            self.handle.deleteTimer(-(-now // 1000))
        self.handle.registerTimer(-(-at // 1000))
        self.alarm.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.alarm.exists() or -(-self.alarm.get()[0] // 1000) != expiredTimerInfo.getExpiryTimeInMs():
            return  # replaced by an earlier one
        self.alarm.update((NEVER,))
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, coming = self._release(passed)  # what lateness holds back
        state = self.own.get() if self.own.exists() else self.start()
        out: list[tuple] = []
        for at, seq in sorted(ready):
            if (due := self.wake(state)) != NEVER and due <= at:
                state, rows = self.woken(state, due)
                out += [(key[0], *r) for r in rows]
            state, rows = self.step(state, seq, ready[at, seq], at)
            out += [(key[0], *r) for r in rows]
            if len(out) >= FRAME_ROWS:
                yield pd.DataFrame(out, columns=self.COLUMNS).pipe(self.typed)
                out = []
        if (due := self.wake(state)) != NEVER and due <= passed:
            state, rows = self.woken(state, due)
            out += [(key[0], *r) for r in rows]
        self.own.update(state)
        times = [t for t in (coming, self.wake(state)) if t != NEVER]
        if times:
            self._set_alarm(min(times))
        if out:
            yield pd.DataFrame(out, columns=self.COLUMNS).pipe(self.typed)

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, seq: int, status: str, at: int) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def wake(self, state: tuple) -> int:
        return NEVER

    def woken(self, state: tuple, at: int) -> tuple[tuple, list[tuple]]:
        return state, []

    def typed(self, frame: pd.DataFrame) -> pd.DataFrame:
        return frame

    def close(self) -> None:
        pass


class RetryQueue(InEventOrder):
    """Counts failures per id, schedules the next check and fires it when
    event time gets there; any other record clears the queue entry."""

    STATE = "attempts bigint, due bigint"
    COLUMNS = ["id", "seq", "event", "attempt", "due"]

    def start(self) -> tuple:
        return 0, NEVER

    def step(self, state, seq, status, at):
        count = state[0]
        if status == "revisit_pending":
            due = at + backoff_minutes(count + 1) * 60_000_000
            return (count + 1, due), [(seq, "scheduled", count + 1, due)]
        return (0, NEVER), [(seq, "resolved", count, None)] if count else []

    def wake(self, state):
        return state[1]

    def woken(self, state, at):
        return (state[0], NEVER), [(-1, "due", state[0], at)]

    def typed(self, frame: pd.DataFrame) -> pd.DataFrame:
        due = pd.to_datetime(frame["due"].astype("Int64"), unit="us")
        return frame.assign(due=due).astype({"id": "int64", "seq": "int64", "attempt": "int64", "event": "object", "due": "datetime64[us]"})


class StateProgress(InEventOrder):
    """Emits every record with the state before it and whether the step is
    one the pipeline makes."""

    STATE = "last string"
    COLUMNS = ["id", "seq", "status", "previous", "valid"]

    def start(self) -> tuple:
        return (None,)

    def step(self, state, seq, status, at):
        need = rules.STATE_PRECONDITIONS.get(status)
        return (status,), [(seq, status, state[0], need is None or state[0] == need)]

    def typed(self, frame: pd.DataFrame) -> pd.DataFrame:
        return frame.astype({"id": "int64", "seq": "int64", "status": "object", "previous": "object", "valid": "bool"})


def _in_order(stream: DataFrame, processor: StatefulProcessor, schema: str, lateness: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.select("id", "seq", "status", F.col("observed_at").cast("timestamp").alias("at")).withWatermark("at", lateness)
    return rows.groupBy("id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def retry_queue(stream: DataFrame, lateness: str) -> DataFrame:
    """Schedules, resolutions and due checks of ``id, seq, status,
    observed_at`` records, each once the watermark has passed it."""
    return _in_order(stream, RetryQueue(), RETRY_SCHEMA, lateness)


def state_progress(stream: DataFrame, lateness: str) -> DataFrame:
    return _in_order(stream, StateProgress(), STATE_SCHEMA, lateness)
