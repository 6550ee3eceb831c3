"""Block streams: greedy clusters with state kept between micro-batches, windowed counts, progress.

Blocks of a container are expected in stream order over the batches; inside a
batch they are put in the order of block_seq.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuewright.operators.blocks import BACKWARD_TOLERANCE_MS, CLUSTER_MS, CUE_INTERVAL_MS

_OUT = "path string, block_seq bigint, track_number bigint, timecode_ms bigint, keyframe boolean, cluster_ms bigint, opens_cluster boolean, went_backwards boolean"
_STATE = "cluster_ms bigint, last_ms bigint"


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _ended(state: GroupState, idle_ms: int | None) -> bool:
    """Drops the state of a path that was idle for too long; else the time runs anew."""
    if state.hasTimedOut:
        state.remove()
        return True
    if idle_ms is not None:
        state.setTimeoutDuration(idle_ms)
    return False


def cluster_stream(blocks: DataFrame, width_ms: int = CLUSTER_MS, tolerance_ms: int = BACKWARD_TOLERANCE_MS, idle_ms: int | None = None) -> DataFrame:
    """blocks + (cluster_ms, opens_cluster, went_backwards), the state of each path kept between batches.

    As in batch, a cluster begins at the first block and at each one that lies
    width_ms or more past its start, and a block more than tolerance_ms before
    the one before it went backwards. Nothing is ever dropped as late. The state
    of a path (two numbers) is kept for good, or until no block of it came for
    idle_ms; blocks after that begin anew. A path's part of a batch is folded in
    one task: batches bound it (maxFilesPerTrigger).
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _ended(state, idle_ms):
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values("block_seq", ignore_index=True)
        start, last = state.get if state.exists else (None, None)
        starts, opens, back = [], [], []
        for t in rows["timecode_ms"].tolist():
            opened = start is None or t - start >= width_ms
            start = t if opened else start
            back.append(t < (last or 0) - tolerance_ms)
            last = t
            starts.append(start)
            opens.append(opened)
        if start is not None:
            state.update((start, last))
        yield rows.assign(cluster_ms=starts, opens_cluster=opens, went_backwards=back)[["path", "block_seq", "track_number", "timecode_ms", "keyframe", "cluster_ms", "opens_cluster", "went_backwards"]]

    slim = blocks.select("path", F.col("block_seq").cast("bigint"), F.col("track_number").cast("bigint"), F.col("timecode_ms").cast("bigint"), "keyframe")
    return slim.groupBy("path").applyInPandasWithState(fold, _OUT, _STATE, "append", _timeout(idle_ms))


def cue_stream(clustered: DataFrame, interval_ms: int = CUE_INTERVAL_MS, idle_ms: int | None = None) -> DataFrame:
    """(path, cluster_ms, time_ms, track_number): index entries as soon as they are known.

    A cluster's entry is its first keyframe; one without any gets its first
    block when the next cluster opens, unless the last entry is nearer than
    interval_ms. The last cluster of a path stays open; idle_ms as in
    cluster_stream().
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if _ended(state, idle_ms):
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values("block_seq", ignore_index=True)
        last, start, done, first_ms, first_track = state.get if state.exists else (-interval_ms - 1, None, True, None, None)
        out = []
        for t, track, key_frame, cluster in zip(rows["timecode_ms"].tolist(), rows["track_number"].tolist(), rows["keyframe"].tolist(), rows["cluster_ms"].tolist()):
            if start is None or cluster != start:
                if not done and first_ms - last >= interval_ms:
                    out.append((key[0], start, first_ms, first_track))
                    last = first_ms
                start, done, first_ms, first_track = cluster, False, t, track
            if key_frame is True and not done:
                out.append((key[0], start, t, track))
                last, done = t, True
        state.update((last, start, done, first_ms, first_track))
        yield pd.DataFrame(out, columns=["path", "cluster_ms", "time_ms", "track_number"])

    slim = clustered.select("path", "block_seq", "track_number", "timecode_ms", "keyframe", "cluster_ms")
    return slim.groupBy("path").applyInPandasWithState(fold, "path string, cluster_ms bigint, time_ms bigint, track_number bigint", "last bigint, start bigint, done boolean, first_ms bigint, first_track bigint", "append", _timeout(idle_ms))


def windowed_counts(blocks: DataFrame, event_time: str, lateness: str = "1 second", window: str = "1 minute") -> DataFrame:
    """Blocks of each track in event-time windows, closed by a watermark; later blocks are left out."""
    w = F.window(event_time, window)
    counted = blocks.withWatermark(event_time, lateness).groupBy(w, "path", "track_number").agg(F.count(F.lit(1)).alias("n_blocks"))
    return counted.select(F.col("window.start").alias("start"), "path", "track_number", "n_blocks")


def on_progress(spark: SparkSession, callback: Callable[[int, int], None]) -> Any:
    """Calls callback(rows so far, -1) after each micro-batch; returns the listener, to be removed by the caller."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def __init__(self) -> None:
            self.rows = 0

        def onQueryStarted(self, event: Any) -> None: ...

        def onQueryIdle(self, event: Any) -> None: ...

        def onQueryTerminated(self, event: Any) -> None: ...

        def onQueryProgress(self, event: Any) -> None:
            self.rows += event.progress.numInputRows
            callback(self.rows, -1)

    listener = Listener()
    spark.streams.addListener(listener)
    return listener


def cancellable(spark: SparkSession, tag: str) -> Callable[[], None]:
    """Tags the jobs that this thread starts from now on; the returned call cancels them."""
    spark.sparkContext.addJobTag(tag)
    return lambda: spark.sparkContext.cancelJobsWithTag(tag)
