"""Idle gaps: when a key has been quiet for a while, told by timers on a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

GAP = T.StructType().add("user_id", "long").add("since", "timestamp").add("due", "timestamp")


class _Quiet(StatefulProcessor):
    """Keeps the times of a key that a timer still waits for; a timer fires at a time plus the gap, once no earlier event can come."""

    def __init__(self, seconds: float):
        self.gap = round(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("times", T.StructType().add("times", "string"))

    def _times(self) -> list[int]:
        return json.loads(self.state.get()[0]) if self.state.exists() else []

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = {int(x) for b in rows for x in b["ms"]}
        held = set(self._times())
        for at in new - held:
            self.handle.registerTimer(at + self.gap)
        self.state.update((json.dumps(sorted(held | new)),))
        yield pd.DataFrame({"user_id": [], "since": [], "due": []}).astype({"user_id": "int64", "since": "datetime64[ns]", "due": "datetime64[ns]"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        times = self._times()
        quiet = not any(due - self.gap < x <= due for x in times)
        left = [x for x in times if x > due - self.gap]
        if left:
            self.state.update((json.dumps(left),))
        else:
            self.state.clear()
        found = [(key[0], pd.Timestamp(due - self.gap, unit="ms"), pd.Timestamp(due, unit="ms"))] if quiet else []
        yield pd.DataFrame(found, columns=["user_id", "since", "due"]).astype({"user_id": "int64", "since": "datetime64[ns]", "due": "datetime64[ns]"})

    def close(self) -> None:
        pass


def idle_gaps(events: DataFrame, seconds: float = 600.0, late: str = "10 minutes") -> DataFrame:
    """user_id, since, due of events (user_id, ts): the last event before each quiet of more than `seconds`, and when the quiet had lasted so long.

    On a stream a gap is told as soon as the watermark, `late` behind the
    newest event, has passed `due`, also for keys that get no event any more;
    on a batch every gap is, the one after the last event too. Times count in
    milliseconds.
    """
    own = events.where("user_id is not null and ts is not null").select(F.col("user_id").cast("long").alias("user_id"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"))
    if not events.isStreaming:
        after = F.lead("ts").over(W.partitionBy("user_id").orderBy("ts"))
        due = F.timestamp_millis(F.unix_millis("ts") + round(seconds * 1000))
        return own.distinct().withColumn("next", after).withColumn("due", due).where("next is null or next > due").select("user_id", F.col("ts").alias("since"), "due")
    timed = own.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("user_id").transformWithStateInPandas(_Quiet(seconds), GAP, "Append", "EventTime")
