"""Timers over thread states: promises that fall due, and a digest of silent threads.

Nothing arrives when a promise is forgotten or a thread stays silent, so neither can be
found by looking at events alone.  Each desk keeps its waiting threads and promises as
state, with one timer for the moment at which the next thing is due.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000
#: A digest follows the last one that was sent after so long at least.
GAP = 22 * HOUR
#: Threads that a digest names; its total counts all.
NAMED = 15
OUTPUT = "desk string, kind string, at timestamp, thread string, total bigint, threads array<string>"


def due(waiting: dict[str, int], promises: dict[str, int], sent: int | None, now: int, silence: int, patience: int) -> tuple[list[str], list[tuple[int, str]], int | None]:
    """What is due at a moment (milliseconds): threads of a digest (longest waiting
    first; none if the last one is too recent), promises that were not kept in
    patience, and the moment to look again, if there is one."""
    broken = sorted((at + patience, t) for t, at in promises.items() if at + patience <= now)
    silent = [t for at, t in sorted((at, t) for t, at in waiting.items()) if at + silence <= now]
    open_ = sent is None or now - sent >= GAP
    digest = silent if open_ else []
    later = [at + patience for at in promises.values() if at + patience > now]
    if waiting:
        # A digest that is sent now opens the next gap; one that is empty does not.
        free = now + GAP if digest else sent + GAP if sent is not None else now
        later.append(max(free, min(at + silence for at in waiting.values())))
    return digest, broken, min(later) if later else None


class Desk(StatefulProcessor):
    """waiting: thread to the moment since which it waits; promises: thread to the moment
    of its promise; sent: when the last digest was; timer: the one that is set."""

    def __init__(self, silence: int, patience: int):
        self.silence, self.patience = silence, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "thread string", "at bigint")
        self.promises = handle.getMapState("promises", "thread string", "at bigint")
        self.sent = handle.getValueState("sent", "at bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    def _set(self, at: int | None) -> None:
        if self.timer.exists():
            old = self.timer.get()[0]
            if old == at:
                return
            self.handle.deleteTimer(old)
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def _held(self) -> tuple[dict[str, int], dict[str, int], int | None]:
        maps = [{k[0]: v[0] for k, v in m.iterator()} for m in (self.waiting, self.promises)]
        return maps[0], maps[1], self.sent.get()[0] if self.sent.exists() else None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values("at", kind="stable").drop_duplicates("thread", keep="last")
        rows = rows[rows["thread"].notna()]
        for thread, waiting, promised in zip(rows["thread"], rows["waiting_since"], rows["promised_at"]):
            for state, at in ((self.waiting, waiting), (self.promises, promised)):
                if not pd.isna(at):
                    state.updateValue((thread,), (_ms(at),))
                elif state.containsKey((thread,)):
                    state.removeKey((thread,))
        # A moment that has passed already is looked at in this batch.
        waiting, promises, sent = self._held()
        starts = [at + self.silence for at in waiting.values()]
        first = [max(min(starts), (sent or min(starts) - GAP) + GAP)] if starts else []
        first += [at + self.patience for at in promises.values()]
        self._set(min(first) if first else None)
        yield _rows(key[0], [])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        at, end = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        out = []
        # The clock may have passed several moments; each is looked at as it was.
        while at is not None and at <= end:
            waiting, promises, sent = self._held()
            digest, broken, after = due(waiting, promises, sent, at, self.silence, self.patience)
            for when, thread in broken:
                self.promises.removeKey((thread,))
                out.append(("promise", when, thread, None, None))
            if digest:
                self.sent.update((at,))
                out.append(("digest", at, None, len(digest), digest[:NAMED]))
            at = after
        self._set(at)
        yield _rows(key[0], out)

    def close(self) -> None:
        pass


def _ms(at) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


def _rows(desk: str, found: list[tuple]) -> pd.DataFrame:
    cols = list(zip(*found)) if found else [[]] * 5
    return pd.DataFrame({"desk": pd.Series([desk] * len(found), dtype=object), "kind": pd.Series(cols[0], dtype=object), "at": pd.to_datetime(pd.Series(cols[1], dtype="int64"), unit="ms"), "thread": pd.Series(cols[2], dtype=object), "total": pd.Series(cols[3], dtype="Int64"), "threads": pd.Series(cols[4], dtype=object)})


def reminders(states: DataFrame, silence_hours: int, patience_hours: int, late: str = "0 seconds") -> DataFrame:
    """desk, kind, at, thread, total and threads of what falls due, as a stream.

    states (a stream): desk, thread, at, waiting_since and promised_at, a row whenever a
    thread's state changes; a row without a thread only says what time it is.  kind
    ``promise``: a thread promised something patience_hours ago and has not been heard
    of since; it is said once.  kind ``digest``: the desk's threads that have waited for
    silence_hours, longest first, GAP after the last one that was sent or later; a desk
    with none sends nothing and opens no gap.

    Timers run by event time, so a replay gives the same, and they are part of the
    checkpoint: a restart sends nothing twice.  States live in the state store, which is
    RocksDB (``spark.sql.streaming.stateStore.providerClass``).  A desk's waiting threads
    are gone through when its timer fires; desks are dealt over the cluster.
    """
    rows = states.withWatermark("at", late).groupBy("desk")
    return rows.transformWithStateInPandas(statefulProcessor=Desk(silence_hours * HOUR, patience_hours * HOUR), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
