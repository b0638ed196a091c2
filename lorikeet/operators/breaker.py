"""Circuit breaker over event time, as a fold per key and as a stateful stream.

closed -> open at ``failures`` failures since the last success; open -> half_open once ``recovery_s`` have
passed since the last failure; half_open -> closed on success, open on failure. An open breaker bypasses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from lorikeet.config import DEFAULTS


@dataclass
class Breaker:
    failures: int = DEFAULTS.breaker_failures
    recovery_s: float = DEFAULTS.breaker_recovery_s
    state: str = "closed"
    count: int = 0
    last: float | None = None

    def step(self, at: float, ok: bool) -> tuple[str, bool]:
        """(state after the event, whether the call was bypassed); a bypassed call has no outcome."""
        if self.state == "open":
            if self.last is not None and at - self.last < self.recovery_s:
                return self.state, True
            self.state = "half_open"
        if ok:
            self.state, self.count, self.last = "closed", 0, None
        else:
            self.count, self.last = self.count + 1, at
            if self.state == "half_open" or self.count >= self.failures:
                self.state = "open"
        return self.state, False


def breaker_states(events: DataFrame, failures: int = DEFAULTS.breaker_failures, recovery_s: float = DEFAULTS.breaker_recovery_s) -> DataFrame:
    """events (key, event_id, at seconds, ok) with ``state`` and ``bypassed``, folded in order of (at, event_id) per key.

    Keys are sorted streams, so a key of any length passes a task in batches.
    """
    rows = events.select("key", "event_id", "at", "ok").repartition("key").sortWithinPartitions("key", "at", "event_id")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, breaker = object(), Breaker(failures, recovery_s)
        for b in batches:
            out = []
            for key, at, ok in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if key != now:
                    now, breaker = key, Breaker(failures, recovery_s)
                out.append(breaker.step(at, ok))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.bool_())], names=["key", "event_id", "at", "ok", "state", "bypassed"])

    return rows.mapInArrow(run, f"key {kind}, event_id long, at double, ok boolean, state string, bypassed boolean")


def stream_breaker(events: DataFrame, failures: int = DEFAULTS.breaker_failures, recovery_s: float = DEFAULTS.breaker_recovery_s) -> DataFrame:
    """The same over a stream of (key long, event_id, at, ok); the breaker of each key is kept as state."""

    def step(key, frames, state):
        b = Breaker(failures, recovery_s, *state.get) if state.exists else Breaker(failures, recovery_s)
        b.last = None if b.last is not None and b.last < 0 else b.last
        for f in frames:
            f = f.sort_values(["at", "event_id"])
            out = [b.step(a, o) for a, o in zip(f["at"], f["ok"], strict=True)]
            yield pd.DataFrame({"key": key[0], "event_id": f["event_id"], "state": [o[0] for o in out], "bypassed": [o[1] for o in out]})
        state.update((b.state, b.count, -1.0 if b.last is None else b.last))

    return events.groupBy("key").applyInPandasWithState(step, "key long, event_id long, state string, bypassed boolean", "state string, count int, last double", "append", "NoTimeout")
