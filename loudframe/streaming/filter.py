"""ST2: the equal-loudness filter on live packets, its state carried between batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loudframe import constants as C
from loudframe.functions import levels as L
from loudframe.operators.filtering import STATE, rate_error, run_filter

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "last bigint, late bigint, filled bigint, window_no bigint, energy double, peak double, left array<double>, right array<double>"


class PacketFilter(StatefulProcessor):
    """Per track: filter state of both channels and the window that is still open.

    A recursive filter cannot go back: a packet whose number is not above the last one is
    dropped and counted. Rows come out when their window is complete. A track ends with a packet
    marked as its last one, or when nothing has come for ``idle_ms``: then its open window comes out
    and its state is removed. Packets after the end begin a new recording of the same name.
    """

    def __init__(self, keys: int, idle_ms: int | None = None):
        self._keys, self._idle = keys, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("filter", _STATE)

    @staticmethod
    def _fresh() -> tuple:
        return -1, 0, 0, 0, 0.0, 0.0, [0.0] * STATE, [0.0] * STATE

    def _rows(self, key, done: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(done, columns=["window_no", "sum_squares", "samples", "peak", "late_packets"])
        for i in range(self._keys):
            frame.insert(i, f"k{i}", [key[i]] * len(frame))
        return frame

    def _end(self, last, late, filled, number, energy, peak, *_) -> list[tuple]:
        """The open window of a track that has ended; its state and timers go."""
        self._state.clear()
        self._stop_waiting()
        return [(number, energy, filled, peak, late)] if filled else []

    def _stop_waiting(self) -> None:
        if self._idle is not None:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._state.get() if self._state.exists() else self._fresh()
        last, late, filled, number, energy, peak, left, right = state
        packets = pd.concat(list(rows)).sort_values("packet_no", kind="stable")
        done, running = [], True
        for packet in packets.itertuples(index=False):
            if not running:
                last, late, filled, number, energy, peak, left, right = self._fresh()
                running = True
            if packet.packet_no <= last:
                late += 1
            else:
                last = int(packet.packet_no)
                kernel = run_filter(int(packet.sample_rate))
                size = int(packet.sample_rate) * C.WINDOW_MS // 1000
                raw_left = np.asarray(packet.left, dtype=float) * packet.scale
                raw_right = raw_left if packet.right is None else np.asarray(packet.right, dtype=float) * packet.scale
                out_left, left = kernel.apply(raw_left, left)
                out_right, right = (out_left, left) if packet.right is None else kernel.apply(raw_right, right)
                squares = out_left * out_left + out_right * out_right
                loud = np.maximum(np.abs(raw_left), np.abs(raw_right)) / C.PCM_SCALE
                at = 0
                while at < len(squares):
                    take = min(size - filled, len(squares) - at)
                    energy += float(squares[at:at + take].sum())
                    peak = max(peak, float(loud[at:at + take].max()))
                    filled, at = filled + take, at + take
                    if filled == size:
                        done.append((number, energy, filled, peak, late))
                        number, filled, energy, peak = number + 1, 0, 0.0, 0.0
            if packet.ends:
                done += self._end(last, late, filled, number, energy, peak)
                running = False
        if running:
            self._state.update((last, late, filled, number, energy, peak, [float(v) for v in left], [float(v) for v in right]))
            if self._idle is not None:
                self._stop_waiting()
                self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._idle)
        yield self._rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._rows(key, self._end(*self._state.get()) if self._state.exists() else [])

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """RocksDB as the state store of the queries started inside; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stream_filter(packets: DataFrame, keys: Sequence[str] = ("album", "track"), ends: str | None = None,
                  idle_seconds: float | None = None) -> DataFrame:
    """Window sums of filtered packets. Needs the RocksDB state store (``state_store``) when the query starts.

    ``ends`` names a boolean column that marks a track's last packet; ``idle_seconds`` ends a track
    for which no packet has come for so long by the clock of the workers. Either brings out the open window and
    removes the state; with neither, the last window stays in the state for ever.
    """
    types = {f.name: f.dataType.simpleString() for f in packets.schema.fields}
    schema = ", ".join(f"k{i} {types[k]}" for i, k in enumerate(keys))
    schema += ", window_no bigint, sum_squares double, samples bigint, peak double, late_packets bigint"
    usable = packets.where(rate_error(F.col("sample_rate")).isNull() & F.col("left").isNotNull()).withColumns({
        "scale": L.sample_scale(F.col("format")), "ends": F.coalesce(F.col(ends), F.lit(False)) if ends else F.lit(False)})
    out = usable.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=PacketFilter(len(keys), None if idle_seconds is None else int(idle_seconds * 1000)),
        outputStructType=schema, outputMode="append", timeMode="none" if idle_seconds is None else "processingTime"
    )
    return out.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})
