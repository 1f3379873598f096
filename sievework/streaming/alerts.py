"""The alerts of operators/alerts.py as a stream: a key's state is kept by the engine, its days close by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerts import MINOR, Cooldown
from ..operators.timelines import epoch

#: kind is `alert` (seq, alert_type, sent) or `day` (seconds of its start, its minor alerts, the first and last of them).
OUT = "kind string, health_key string, seq long, alert_type string, sent boolean, day long, n long, first_at long, last_at long"
_DAY = 86_400


class AlertProcessor(StatefulProcessor):
    """Cooldown by kind of alert, and a count of minor alerts for each day that is still open."""

    def __init__(self, seconds: int, allowed: tuple[str, ...] | None = None):
        self.rule = Cooldown(seconds, allowed)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kinds = handle.getMapState("kinds", "alert_type string", "sent_at long, resolved_at long")
        self.days = handle.getMapState("days", "day long", "n long, first_at long, last_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = {k[0]: list(v) for k, v in self.kinds.iterator()}
        taken = sorted((int(t), int(s), str(k)) for part in rows for t, s, k in zip(part["t"], part["seq"], part["alert_type"], strict=True))
        out = []
        for t, seq, kind in taken:
            out.append(("alert", key[0], seq, kind, self.rule.step(state, t, kind), None, None, None, None))
            if kind in MINOR:
                day = (t - t % _DAY,)
                n, first, last = self.days.getValue(day) if self.days.containsKey(day) else (0, t, t)
                if n == 0:
                    self.handle.registerTimer((day[0] + _DAY) * 1000)
                self.days.updateValue(day, (n + 1, min(first, t), max(last, t)))
        for kind, (sent_at, resolved_at) in state.items():
            self.kinds.updateValue((kind,), (sent_at, resolved_at))
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = (expiredTimerInfo.getExpiryTimeInMs() // 1000 - _DAY,)
        if self.days.containsKey(day):
            n, first, last = self.days.getValue(day)
            self.days.removeKey(day)
            yield pd.DataFrame([("day", key[0], None, None, None, day[0], n, first, last)], columns=COLUMNS)

    def close(self) -> None:
        pass


COLUMNS = [part.split()[0] for part in OUT.split(", ")]


def keeps_state(spark: SparkSession) -> None:
    """Timers and states of several kinds need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def alert_stream(alerts: DataFrame, seconds: int, allowed: tuple[str, ...] | None = None, late: str = "1 hour", time: str = "detected_at") -> DataFrame:
    """A stream of OUT: each alert with whether it is sent, as operators.alerts.sent tells it, and each key's days of minor alerts once they are over.

    alerts: health_key, time, seq, alert_type. Alerts of one batch are taken in the order of time and seq; what comes later
    than `late` behind the latest is left out by the engine.
    """
    keeps_state(alerts.sparkSession)
    rows = alerts.where(F.col(time).isNotNull()).withWatermark(time, late).select("health_key", epoch(time).alias("t"), "seq", "alert_type", time)
    return rows.groupBy("health_key").transformWithStateInPandas(AlertProcessor(seconds, allowed), OUT, "append", "eventtime")
