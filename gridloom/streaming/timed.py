"""Windows of frames by event time: late frames are waited for, what comes after that is dropped, and streams that fall silent are forgotten."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


STATE = "n long, latest long, us array<long>, ids array<long>, vs array<double>, last array<double>"


def _step(n: int, idle_ms: int) -> Callable:
    """What a stream's new frames, or its timeout, make of its state: the frames that the watermark hasn't passed, the last n values that it has, their number and the stream's last time.

    A frame waits until the watermark is at or beyond its time, so that windows are in order of (ts, frame_id) however frames arrive. Times are in
    microseconds. The timeout comes for the first that waits, or `idle` after the last time, where the state ends. A state goes to Python and back with its rows.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, latest, us, ids, vs, last = state.get if state.exists else (0, None, [], [], [], [])
        frames = list(zip(us, ids, vs, strict=True))
        if not state.hasTimedOut:
            for batch in batches:
                frames += zip(batch["us"].tolist(), map(int, batch["frame_id"].tolist()), (None if v != v else v for v in batch["v"].tolist()), strict=True)
            latest = max(f[0] for f in frames) if latest is None else max([latest, *(f[0] for f in frames)])
        mark = state.getCurrentWatermarkMs()
        frames.sort(key=lambda f: f[:2])
        ready = bisect_right(frames, mark, key=lambda f: f[0] // 1000)
        values, rest = [*reversed(last), *(f[2] for f in frames[:ready])], frames[ready:]  # the latest at the end
        ends = range(max(n - seen, 0), ready)  # places in frames at which windows end
        base, out = len(last), None
        if len(ends):
            columns = {"stream": [key[0]] * len(ends), "us": [frames[i][0] for i in ends], "frame_id": [frames[i][1] for i in ends]}
            out = pd.DataFrame(columns | {f"v{k}": [values[base + i - k] for i in ends] for k in range(n)})
        end = latest // 1000 + idle_ms
        if state.hasTimedOut and mark >= end:
            state.remove()
        else:
            us, ids, vs = ([f[k] for f in rest] for k in range(3))
            state.update((seen + ready, latest, us, ids, vs, values[::-1][:n]))
            state.setTimeoutTimestamp(max(min([end, *(x // 1000 for x in us[:1])]) - 1, mark, 1))  # it comes when the watermark is beyond that
        if out is not None:
            yield out

    return step


def use_rocks(spark: SparkSession) -> None:
    """Keep the state of this session's streams in RocksDB, so that those that wait need no room in the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def windows(frames: DataFrame, n: int = 4, late: str = "10 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """(stream, ts, frame_id, v0, ..., vn-1) of a streaming DataFrame (stream, ts timestamp, frame_id, v): each frame with the n - 1 before it, v0 the latest.

    The first window of a stream comes with its frame n + 1. Frames may come `late`: they are put in order by time before windows are made; frames behind the
    watermark are dropped by Spark, as are those without a time. A stream without frames for `idle_ms` of event time begins anew, so states don't pile up. A null value stays
    null in its windows; a null stream is a stream.
    """
    use_rocks(frames.sparkSession)
    schema = ", ".join(["stream long", "us long", "frame_id long", *(f"v{i} double" for i in range(n))])
    rows = frames.where("ts is not null").select(F.col("stream").cast("long").alias("stream"), "ts", F.unix_micros("ts").alias("us"), F.col("frame_id").cast("long").alias("frame_id"), F.col("v").cast("double").alias("v"))
    out = rows.withWatermark("ts", late).groupBy("stream").applyInPandasWithState(_step(n, idle_ms), schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("stream", F.timestamp_micros("us").alias("ts"), "frame_id", *(f"v{i}" for i in range(n)))
