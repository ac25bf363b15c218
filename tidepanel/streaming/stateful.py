"""Stateful stream operators with keyed value state: CUSUM / EWMA chart and drawdown tiers."""
from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sequential import TIERS, TierState

C = F.col


class ControlChart(StatefulProcessor):
    """Two-sided CUSUM with reset and an exponentially weighted mean of every key, against a fixed reference mean and deviation.

    Keys come in buckets: a call to the state store costs far more than a row, so one group holds the numbers and the rows of many keys. Rows
    wait in list state until the watermark has passed them and are then charted by key in order of (ts, seq), so batches that come out of
    order, or cut anywhere, give the same chart. One timer a bucket stands at the least waiting time. Rows behind the watermark on arrival are
    dropped by the stream. State: three numbers a key and the rows of one watermark delay.
    """

    def __init__(self, mu: float, sd: float, threshold: float = 4.0, drift: float = 0.0, lam: float = 0.2, width: float = 3.0):
        self.mu, self.sd, self.threshold, self.drift, self.lam, self.width = mu, sd, threshold, drift, lam, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at bigint")
        self.chart = handle.getListState("chart", "key string, hi double, lo double, ewma double")
        self.waiting = handle.getListState("waiting", "key string, us bigint, seq bigint, value double")

    def _wake(self, at: int, timer: int) -> None:
        """Moves the timer to ``at`` (milliseconds), if that is earlier or no timer stands."""
        if 0 <= timer <= at:
            return
        if timer >= 0:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        least = None
        for frame in rows:
            us = frame["us"].to_numpy()
            self.waiting.appendList(list(zip(frame["key"].tolist(), us.tolist(), frame["seq"].astype("int64").tolist(), frame["value"].tolist())))
            least = int(us.min()) if least is None else min(least, int(us.min()))
        timer = self.timer.get()
        self._wake(least // 1000, -1 if timer is None else timer[0])
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        ready, rest = [], []
        for r in self.waiting.get():
            (ready if r[1] // 1000 <= mark else rest).append(tuple(r))
        ready.sort()
        charts = {r[0]: tuple(r[1:]) for r in self.chart.get()}
        limit = self.width * (self.lam / (2 - self.lam)) ** 0.5
        alarm, chart = [], []
        for name, _, _, value in ready:
            hi, lo, ew = charts.get(name, (0.0, 0.0, 0.0))
            v = (value - self.mu) / max(self.sd, 1e-9)
            hi, lo = max(0.0, hi + v - self.drift), max(0.0, lo - v - self.drift)
            ew = (1 - self.lam) * ew + self.lam * v
            hit = hi > self.threshold or lo > self.threshold
            if hit:
                hi = lo = 0.0
            charts[name] = (float(hi), float(lo), float(ew))
            alarm.append(int(hit))
            chart.append(int(abs(ew) > limit))
        if rest:
            self.waiting.put(rest)
            self._wake(min(r[1] for r in rest) // 1000, -1)
        else:
            self.waiting.clear()
            self.timer.clear()
        if ready:
            self.chart.put([(name, *numbers) for name, numbers in charts.items()])
            yield pd.DataFrame({"key": [r[0] for r in ready], "us": [r[1] for r in ready], "seq": [r[2] for r in ready], "cusum_alarm": pd.array(alarm, "int32"), "ewma_alarm": pd.array(chart, "int32")})

    def close(self) -> None:
        pass


def control_chart(stream: DataFrame, key: str, mu: float, sd: float, late: str = "10 minutes", buckets: int = 4096, **kw) -> DataFrame:
    """stream: key, ts, seq (orders rows of one time), value -> key, ts, seq, alarms of every row that the watermark has passed.
    Rows without ts or value are left out. Keys are dealt over ``buckets`` by hash; a running stream must keep their number."""
    d = stream.where("ts IS NOT NULL AND value IS NOT NULL").withWatermark("ts", late)
    name = F.coalesce(C(key).cast("string"), F.lit("None"))
    d = d.select(F.pmod(F.xxhash64(name), F.lit(buckets)).alias("bucket"), name.alias("key"), "ts", F.unix_micros("ts").alias("us"), C("seq").cast("bigint").alias("seq"), C("value").cast("double").alias("value"))
    out = d.groupBy("bucket").transformWithStateInPandas(
        ControlChart(mu, sd, **kw), outputStructType="key string, us bigint, seq bigint, cusum_alarm int, ewma_alarm int", outputMode="Append", timeMode="EventTime")
    return out.select("key", F.timestamp_micros("us").alias("ts"), "seq", "cusum_alarm", "ewma_alarm")


class DrawdownTiers(StatefulProcessor):
    """The batch tier controller with its three numbers in keyed state."""

    def __init__(self, recovery: int = 3):
        self.recovery = recovery

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tier", "peak double, tier int, calm int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        st = TierState(*(self.state.get() if self.state.exists() else (None, 0, 0)), recovery=self.recovery)
        batch = pd.concat(list(rows)).sort_values("ts")
        out = [st.update(float(v)) for v in batch["nav"]]
        self.state.update((float(st.peak), int(st.tier), int(st.calm)))
        yield pd.DataFrame({"key": str(key[0]), "ts": batch["ts"].to_numpy(), "drawdown": [r[0] for r in out], "tier": [TIERS[r[1]][0] for r in out],
                            "scale": [TIERS[r[1]][2] for r in out]})

    def close(self) -> None:
        pass


def drawdown_tiers_stream(stream: DataFrame, key: str = "account", recovery: int = 3) -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(
        DrawdownTiers(recovery), outputStructType="key string, ts timestamp, drawdown double, tier string, scale double", outputMode="Append", timeMode="None")
