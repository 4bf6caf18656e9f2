"""The life of a send: claims, results, retries with growing delays, and hangs of unknown delivery.

One step function serves a stream, whose timers see hangs when the watermark passes
them, and the fold of a table of the same events.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scoring import MOST_ATTEMPTS, TERMINAL_CODES, TRANSIENT_CODES

#: Milliseconds after which a send that was claimed and told nothing has an unknown delivery, and those of a minute.
HANGS, MINUTE = 600_000, 60_000
CHANGES = "send_id long, at long, status string, attempts long, next_attempt_at long, code string"
COLUMNS = ["send_id", "at", "status", "attempts", "next_attempt_at", "code"]


class Send(NamedTuple):
    """A send's status and attempts; when it was claimed last and may be claimed again (milliseconds); the code of its last failure."""

    status: str
    attempts: int = 0
    claimed_at: int | None = None
    next_attempt_at: int | None = None
    code: str | None = None


def hung(send: Send | None, now: int) -> tuple[Send, int] | None:
    """What becomes of a send that hangs at ``now``, and since when; None if it doesn't."""
    if send and send.status == "SENDING" and send.claimed_at + HANGS <= now:
        return send._replace(status="DELIVERY_UNKNOWN", code="STUCK_SENDING_RECOVERY"), send.claimed_at + HANGS
    return None


def step(send: Send | None, kind: str, code: str | None, at: int) -> Send | None:
    """The send after an event; the same one if the event means nothing to it.

    ENQUEUE makes a send. CLAIM takes one that is queued and due, and counts the
    attempt. SENT and FAILED are results of a claimed one: a transient failure queues
    it again after two to the power of its attempts minutes, up to MOST_ATTEMPTS; a
    code that is neither terminal nor transient leaves it unknown, without a retry.
    """
    if kind == "ENQUEUE":
        return send or Send("QUEUED")
    if send is None:
        return None
    if kind == "CLAIM" and send.status == "QUEUED" and (send.next_attempt_at is None or send.next_attempt_at <= at):
        return send._replace(status="SENDING", attempts=send.attempts + 1, claimed_at=at, next_attempt_at=None)
    if send.status != "SENDING" or kind not in ("SENT", "FAILED"):
        return send
    if kind == "SENT":
        return send._replace(status="SENT", code=None)
    code = code or "UNKNOWN"
    if code in TRANSIENT_CODES and send.attempts < MOST_ATTEMPTS:
        return send._replace(status="QUEUED", next_attempt_at=at + (MINUTE << send.attempts), code=code)
    ends = code in TERMINAL_CODES or code in TRANSIENT_CODES or code == "PROVIDER_NOT_FOUND"
    return send._replace(status="FAILED" if ends else "DELIVERY_UNKNOWN", code=code)


def changes(send_id: int, send: Send | None, events: Iterator[tuple[str, str | None, int]]) -> Iterator[tuple[Send, tuple]]:
    """The send after each event, or hang, that changes it, and the row that says so."""
    row = lambda s, at: (send_id, at, s.status, s.attempts, s.next_attempt_at, s.code)
    for kind, code, at in events:
        if gone := hung(send, at):
            send = gone[0]
            yield send, row(send, gone[1])
        after = step(send, kind, code, at)
        if after != send:
            send = after
            yield send, row(send, at)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS).astype({"send_id": "int64", "at": "int64", "attempts": "int64", "next_attempt_at": "Int64"})


def _value(x) -> str | None:
    return None if x is None or x != x else x


class Sends(StatefulProcessor):
    """One state for each send that isn't done; a timer for each claim."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("send", "status string, attempts long, claimed_at long, next_attempt_at long, code string")

    def _get(self) -> Send | None:
        if not self.state.exists():
            return None
        return Send(*(_value(x) for x in self.state.get()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a trigger's events of one send, in order of time
        events = pd.concat(list(rows)).sort_values(["at", "seq"])
        before = send = self._get()
        out = []
        for send, row in changes(int(key[0]), before, ((k, _value(c), int(t)) for k, c, t in zip(events["kind"], events["code"], events["at"]))):
            out.append(row)
        if send != before:
            self.state.update(tuple(send))
            if before and before.status == "SENDING":
                self.handle.deleteTimer(before.claimed_at + HANGS)
            if send.status == "SENDING":
                self.handle.registerTimer(send.claimed_at + HANGS)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        send = self._get()
        gone = hung(send, int(expiredTimerInfo.getExpiryTimeInMs()))
        if gone:
            self.state.update(tuple(gone[0]))
            yield _frame([(int(key[0]), gone[1], gone[0].status, gone[0].attempts, gone[0].next_attempt_at, gone[0].code)])

    def close(self) -> None:
        pass


def send_changes(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The changes of sends in a stream of ``events``: ``send_id``, ``ts`` (an instant), ``at`` (its milliseconds), ``seq``, ``kind``, ``code``.

    Events of a trigger are put in order by ``at`` and ``seq``; those of later triggers
    must not be earlier. Needs the state store of RocksDB.
    """
    rows = events.withWatermark("ts", late)
    return rows.groupBy("send_id").transformWithStateInPandas(Sends(), CHANGES, "Append", "EventTime")


def fold_sends(events: DataFrame, until: int | None = None) -> DataFrame:
    """The same changes of a table of events, and the hangs up to ``until`` (milliseconds) behind the last ones.

    Events are sorted by send and time and folded as they pass, with one state at a
    time: a send with very many events needs no more memory than any other.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, send = None, None

        def last() -> list[tuple]:
            gone = hung(send, until) if until is not None else None
            return [(now, gone[1], gone[0].status, gone[0].attempts, gone[0].next_attempt_at, gone[0].code)] if gone else []

        for frame in frames:
            out: list[tuple] = []
            for send_id, at, kind, code in zip(frame["send_id"], frame["at"], frame["kind"], frame["code"]):
                if send_id != now:
                    out += last()
                    now, send = int(send_id), None
                for send, row in changes(now, send, iter([(kind, _value(code), int(at))])):
                    out.append(row)
            yield _frame(out)
        yield _frame(last())

    columns = ["send_id", "at", "seq", "kind", "code"]
    ordered = events.select(*columns).where("send_id IS NOT NULL AND at IS NOT NULL").repartition("send_id").sortWithinPartitions("send_id", "at", "seq")
    return ordered.mapInPandas(run, CHANGES)
