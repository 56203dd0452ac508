"""Per-source state over status events: the latest status, and a timer for silent workers.

State is one small record per key, so a key with very many events costs time but no memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opporta.operators.registry import NOTICE

STATUS_OUT = "source_id STRING, status STRING, last_error STRING, enabled BOOLEAN, at TIMESTAMP, last_success_at TIMESTAMP"
ALERT_OUT = "worker_id STRING, last_seen TIMESTAMP, state STRING"
STALE_MS = 20_000


def _utc(value) -> pd.Timestamp | None:
    return None if value is None or pd.isna(value) else pd.Timestamp(value)


class StatusFold(StatefulProcessor):
    """Newest event by event time wins, events without a time or status aside; an error on a generic source disables it for good."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "status STRING, failed BOOLEAN, ever_failed BOOLEAN, generic BOOLEAN, at TIMESTAMP, ok TIMESTAMP")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, failed, ever, generic, at, ok = self.state.get() if self.state.exists() else (None, False, False, False, None, None)
        at, ok = _utc(at), _utc(ok)
        for batch in rows:
            bad = batch["error"].fillna("") != ""
            ever, generic = bool(ever or bad.any()), bool(generic or (batch["adapter_mode"] == "generic").any())
            good = batch.loc[~bad & (batch["status"] == "SUCCESS"), "at"]
            if len(good):
                ok = good.max() if ok is None else max(ok, good.max())
            timed = batch[batch["at"].notna() & batch["status"].notna()]
            if not len(timed):
                continue
            last = timed.sort_values(["at", "status"]).iloc[-1]
            # A late event never replaces a newer one.
            if at is None or (last["at"], last["status"]) > (at, status or ""):
                status, failed, at = last["status"], bool(last["error"]), last["at"]
        self.state.update((status, failed, ever, generic, None if at is None else at.to_pydatetime(), None if ok is None else ok.to_pydatetime()))
        yield pd.DataFrame({
            "source_id": [key[0]], "status": pd.Series(["NEEDS_ADAPTER" if failed and generic else status], dtype=object), "last_error": [NOTICE if failed else ""],
            "enabled": [not (generic and ever)], "at": pd.Series([at], dtype="datetime64[ns]"), "last_success_at": pd.Series([ok], dtype="datetime64[ns]")})

    def close(self) -> None:
        pass


def fold_status_stream(events: DataFrame, mode: str = "update") -> DataFrame:
    """events: source_id, adapter_mode, status, error, at. One output row per source and batch."""
    return events.groupBy("source_id").transformWithStateInPandas(StatusFold(), outputStructType=STATUS_OUT, outputMode=mode, timeMode="none")


def _stale_at(beat: pd.Timestamp) -> int:
    return int(beat.timestamp() * 1000) + STALE_MS


class Heartbeat(StatefulProcessor):
    """Emits a row when no beat came for 20 seconds of event time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "seen TIMESTAMP")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = _utc(self.state.get()[0]) if self.state.exists() else None
        newest = max([batch["at"].max() for batch in rows] + ([before] if before is not None else []))
        if before is None or newest > before:
            if before is not None:  # a key's only timer is that of its newest beat
                self.handle.deleteTimer(_stale_at(before))
            self.state.update((newest.to_pydatetime(),))
            self.handle.registerTimer(_stale_at(newest))
        yield pd.DataFrame({"worker_id": pd.Series([], dtype=str), "last_seen": pd.Series([], dtype="datetime64[ns]"), "state": pd.Series([], dtype=str)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = _utc(self.state.get()[0])
        yield pd.DataFrame({"worker_id": [key[0]], "last_seen": [seen], "state": ["STALE"]})

    def close(self) -> None:
        pass


def stale_workers(beats: DataFrame, late: str = "5 seconds") -> DataFrame:
    """beats: worker_id, at. One row per silence."""
    return beats.withWatermark("at", late).groupBy("worker_id").transformWithStateInPandas(
        Heartbeat(), outputStructType=ALERT_OUT, outputMode="append", timeMode="eventTime")
