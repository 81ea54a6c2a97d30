"""Registrations as keyed state: revisions, withdrawals, returns, and a freeze by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Days without a reading after which a registration is final.
FREEZE_DAYS = 10
STATE = "hash string, revision long, first timestamp, last timestamp, withdrawn boolean, returns long, frozen boolean"
OUT = "key string, event string, at timestamp, revision long, first timestamp, withdrawn boolean, returns long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step(state: tuple | None, at: pd.Timestamp, content: str, present: bool) -> tuple[tuple, str | None]:
    """(state after a reading, what happened): new, changed, withdrawn, returned, late, or None where nothing did.

    A reading of other content is a revision; one that no longer shows the registration
    withdraws it, and the next that does is a return. A reading older than the last one
    changes nothing, and none that comes more than FREEZE_DAYS after the last one does:
    the registration is final by then.
    """
    if state is None:
        return (content, 1, at, at, not present, 0, False), "new"
    hash_, revision, first, last, withdrawn, returns, frozen = state
    if frozen or at - last > pd.Timedelta(days=FREEZE_DAYS):
        return (hash_, revision, first, last, withdrawn, returns, True), "late"
    if at < last:
        return state, "late"
    if not present:
        return (hash_, revision, first, at, True, returns, False), None if withdrawn else "withdrawn"
    changed = content != hash_
    after = (content, revision + changed, first, at, False, returns + withdrawn, False)
    return after, "returned" if withdrawn else "changed" if changed else None


class Registrations(StatefulProcessor):
    """step() for each reading of a key, in order; `final` is given out once, by a timer when the watermark has passed the freeze, or by a reading that comes after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("registration", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else None
        state = tuple(state) if state is not None else None
        out = []
        readings = pd.concat(list(rows)).sort_values(["ts", "content", "present"])
        for r in readings.itertuples():
            before = state
            state, what = step(state, r.ts, r.content, bool(r.present))
            if state[6] and not before[6]:
                out.append(_final(key[0], state))
            if what:
                out.append((key[0], what, r.ts, state[1], state[2], state[4], state[5]))
        self.state.update(tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in state))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not state[6]:
            self.handle.registerTimer(int((pd.Timestamp(state[3]) + pd.Timedelta(days=FREEZE_DAYS)).timestamp() * 1000) + 1)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get())
        self.state.update((*state[:6], True))
        yield _frame([_final(key[0], state)])

    def close(self) -> None:
        pass


def _final(key: str, state: tuple) -> tuple:
    """What is given out once when a registration becomes final, by a timer or by a reading that comes after."""
    _, revision, first, last, withdrawn, returns, _ = state
    return key, "final", pd.Timestamp(last) + pd.Timedelta(days=FREEZE_DAYS), revision, first, withdrawn, returns


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [f.split(" ")[0] for f in OUT.split(", ")]
    df = pd.DataFrame(rows, columns=names)
    return df.astype({"key": "object", "event": "object", "at": "datetime64[ns]", "revision": "int64", "first": "datetime64[ns]", "withdrawn": "bool", "returns": "int64"})


def followed(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """What happens to registrations, from a stream of readings (key, ts, content, present).

    State is kept in RocksDB, off the heap, a few values a key; set ROCKSDB as the
    session's spark.sql.streaming.stateStore.providerClass. A timer marks a key final, so
    readings after it are `late` also when the watermark came first.
    """
    return stream.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(Registrations(), OUT, "Append", "EventTime")
