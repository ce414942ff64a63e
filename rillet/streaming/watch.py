"""Keys watched by event-time timers: what they say while they speak, and what falling silent means."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RUN = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("since", T.TimestampType()), T.StructField("last", T.TimestampType())])
TOLD = T.StructType([T.StructField("key", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType()), T.StructField("state", T.StringType())])
#: The state store that timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ZONE = datetime.timezone.utc


def _ms(at: datetime.datetime) -> int:
    return int((at if at.tzinfo else at.replace(tzinfo=ZONE)).timestamp() * 1000)


def _time(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class Watch(StatefulProcessor):
    """State of a key: its last value, since when it says so, and when it spoke last. A timer stands at the end of its freshness, then at the end of its state."""

    def __init__(self, stuck: float, stale: float, forget: float):
        self.stuck, self.stale, self.forget = (int(h * 3_600_000) for h in (stuck, stale, forget))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.run = handle, handle.getValueState("run", RUN)

    def _known(self) -> tuple[float | None, int, int]:
        value, since, last = self.run.get() if self.run.exists() else (None, None, None)
        return (value, _ms(since), _ms(last)) if since is not None else (None, 0, -1)

    def _wait(self, until: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(until)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("ts", kind="stable")
        value, since, last = self._known()
        out = []
        for at, v in zip((t.value // 1_000_000 for t in pd.DatetimeIndex(new["ts"])), new["value"].astype(float)):
            if at < last:  # late: it says nothing of the present
                out.append((key[0], _time(at), v, "late"))
                continue
            value, since, last = (value if v == value else v), (since if v == value else at), at
            out.append((key[0], _time(at), v, "stuck" if at - since > self.stuck else "live"))
        self.run.update((value, _time(since).to_pydatetime(), _time(last).to_pydatetime()))
        self._wait(last + self.stale)
        yield pd.DataFrame(out, columns=TOLD.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value, _, last = self._known()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if last < 0 or at < last + self.stale:
            return
        if at >= last + self.forget:
            self.run.clear()
        else:
            self._wait(last + self.forget)
        yield pd.DataFrame([(key[0], _time(at), value, "gone" if at >= last + self.forget else "stale")], columns=TOLD.names)


def watched(stream: DataFrame, stuck: float = 24.0, stale: float = 24.0 * 45, forget: float = 24.0 * 60, delay: str = "1 day") -> DataFrame:
    """(key, ts, value, state) of (key, ts, value): each reading as live, stuck (the same value for longer than ``stuck`` hours) or late; and by itself, when event
    time has passed a key's last reading by so many hours, one row that it is stale and one that it is gone, with which its state ends. The session needs STORE."""
    if stale >= forget:
        raise ValueError("a key has to be stale before it is forgotten")
    keyed = stream.withWatermark("ts", delay).groupBy("key")
    return keyed.transformWithStateInPandas(Watch(stuck, stale, forget), TOLD, "append", "EventTime")
