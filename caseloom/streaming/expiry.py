"""The latest reference of each user, forgotten when the user stays away."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The state store that timers need; set on the session before the stream starts.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)
_STATE = "reference string, moment bigint, message string"


def latest_per_user_until(
    messages: DataFrame, user: str, reference: Column, moment: Column, message: Column, ttl_seconds: int, delay: str = "0 seconds"
) -> DataFrame:
    """Changes of the newest reference of each user on a stream: ``user, reference, moment, message, expired``.

    One row when a user's newest message changes (by ``moment``, a timestamp, then ``message``), and one with
    ``expired`` and a null reference when the clock of the stream, its newest moment less ``delay``, is ``ttl_seconds`` past
    that message. Then the user's state is gone: the state holds the users of the last ``ttl_seconds`` and no others.
    Messages later than ``delay`` count like any other as long as their user is known. Rows without a user or moment are left out.
    """
    read = messages.select(
        F.col(user).cast("string").alias("user"), reference.cast("string").alias("reference"), moment.alias("moment"),
        message.cast("string").alias("message"),
    ).where(F.col("user").isNotNull() & F.col("moment").isNotNull())
    return (
        read.withWatermark("moment", delay)
        .groupBy("user")
        .transformWithStateInPandas(
            _Latest(1000 * ttl_seconds), "user string, reference string, moment bigint, message string, expired boolean",
            "Update", "EventTime",
        )
        .select("user", "reference", F.timestamp_micros("moment").alias("moment"), "message", "expired")
    )


class _Latest(StatefulProcessor):
    """Keeps the newest message of a user and a timer for when it is too old. Moments are microseconds."""

    def __init__(self, ttl: int):
        self._ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._newest = handle.getValueState("newest", _STATE)

    def handleInputRows(
        self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues
    ) -> Iterator[pd.DataFrame]:
        before = tuple(self._newest.get()) if self._newest.exists() else None
        newest = before
        for frame in rows:
            moments = frame["moment"].astype("datetime64[us]").astype("int64")
            best = max(zip(moments.tolist(), frame["message"], frame["reference"]))
            if newest is None or (best[0], best[1]) > (newest[1], newest[2]):
                newest = best[2], best[0], best[1]
        if newest != before:
            self._newest.update(newest)
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(newest[1] // 1000 + self._ttl)
            yield _row(key, *newest, False)

    def handleExpiredTimer(
        self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[pd.DataFrame]:
        _, moment, message = self._newest.get()
        self._newest.clear()
        yield _row(key, None, moment, message, True)

    def close(self) -> None:
        pass


def _row(key: tuple, reference: str | None, moment: int, message: str, expired: bool) -> pd.DataFrame:
    return pd.DataFrame({
        "user": [key[0]], "reference": pd.Series([reference], dtype="object"), "moment": [moment], "message": [message],
        "expired": [expired],
    })
