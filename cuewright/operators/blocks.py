"""Operators on the block stream: (path, block_seq, track_number, timecode_ms, keyframe[, data])."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions.scalars import trim_nulls
from cuewright.operators.ordered import CHUNK, carried
from cuewright.runtime import settle, settle_table

CLUSTER_MS = 1000
CUE_INTERVAL_MS = 500
BACKWARD_TOLERANCE_MS = 1000
#: Ranges that each block is held against; the time bucket in which more of them meet the blocks.
MOST_RANGES, RANGE_BUCKET_MS = 64, 60_000


# --- filters and projections -------------------------------------------------------------------------------------


def wanted_tracks(tracks: DataFrame, ids: Sequence[int] | None) -> DataFrame:
    """Tracks of the listed ids; an empty list means all, unknown ids are passed over."""
    return tracks.where(F.col("track_id").isin(list(ids))) if ids else tracks


def blocks_of(blocks: DataFrame, tracks: DataFrame) -> DataFrame:
    """Blocks of the given tracks."""
    keys = tracks.select("path", F.col("track_id").alias("track_number")).distinct()
    return blocks.join(keys, ["path", "track_number"], "left_semi").select(*blocks.columns)


def time_range(blocks: DataFrame, start_ms: int = 0, end_ms: int = 0) -> DataFrame:
    """Blocks of [start, end); 0 lifts a bound."""
    if start_ms > 0:
        blocks = blocks.where(F.col("timecode_ms") >= start_ms)
    if end_ms > 0:
        blocks = blocks.where(F.col("timecode_ms") < end_ms)
    return blocks


def shifted(blocks: DataFrame, by: Column | int) -> DataFrame:
    return blocks.withColumn("timecode_ms", F.col("timecode_ms") + by)


def remapped(blocks: DataFrame, remap: DataFrame) -> DataFrame:
    """Blocks with the new track numbers of remap (path, old_id, new_id); blocks of other tracks are dropped."""
    pairs = remap.select("path", F.col("old_id").alias("track_number"), F.col("new_id").alias("_new"))
    return blocks.join(pairs, ["path", "track_number"]).withColumn("track_number", F.col("_new")).select(*blocks.columns)


def with_headers(blocks: DataFrame, tracks: DataFrame) -> DataFrame:
    """Blocks whose stripped header bytes are put back before the data."""
    heads = tracks.select("path", F.col("track_id").alias("track_number"), F.col("header_stripping").alias("_head")).where("_head is not null").dropDuplicates(["path", "track_number"])
    out = blocks.join(heads, ["path", "track_number"], "left")
    return out.withColumn("data", F.when(F.col("_head").isNotNull(), F.concat("_head", "data")).otherwise(F.col("data"))).select(*blocks.columns)


def subtitle_texts(blocks: DataFrame) -> DataFrame:
    """Blocks with their text (trailing zero bytes off), empty ones dropped."""
    return blocks.withColumn("text", trim_nulls(F.col("data"))).where("length(text) > 0")


def ass_payloads(blocks: DataFrame) -> DataFrame:
    """struct fields of ASS payloads 'order,layer,rest'; those with fewer parts are dropped."""
    parts = F.split(trim_nulls(F.col("data")), ",", 3)
    return blocks.withColumn("_p", parts).where(F.size("_p") == 3).select(*blocks.columns, F.col("_p")[1].alias("layer"), F.col("_p")[2].alias("fields"))


# --- aggregates ---------------------------------------------------------------------------------------------------


def counts_by_track(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("path", "track_number").agg(F.count(F.lit(1)).alias("n_blocks"))


def stream_totals(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("path").agg(F.count(F.lit(1)).alias("n_blocks"), F.coalesce(F.bool_or("keyframe"), F.lit(False)).alias("any_keyframe"), F.max_by("timecode_ms", "block_seq").alias("last_timecode_ms"))


def track_sizes(blocks: DataFrame) -> DataFrame:
    """Frames and bytes of each track's raw stream."""
    return blocks.groupBy("path", "track_number").agg(F.count(F.lit(1)).alias("n_frames"), F.coalesce(F.sum(F.length("data")), F.lit(0)).cast("bigint").alias("n_bytes"))


# --- order-dependent ----------------------------------------------------------------------------------------------


def backward_timecodes(blocks: DataFrame, tolerance_ms: int = BACKWARD_TOLERANCE_MS, chunk: int = CHUNK) -> DataFrame:
    """Blocks whose timecode lies more than the tolerance before the previous block's, over all tracks.

    Adds previous_ms (0 before the first block) and block_no, the 1-based place in the stream.
    """
    out = carried(blocks, ["path"], "block_seq", {"previous_ms": ("last", F.col("timecode_ms")), "block_no": ("count", F.lit(1))}, chunk)
    out = out.withColumn("previous_ms", F.coalesce("previous_ms", F.lit(0))).withColumn("block_no", F.col("block_no") + 1)
    return out.where(F.col("timecode_ms") < F.col("previous_ms") - tolerance_ms)


def _matched(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks of each range, with range_id, _s and _e; ranges without a path hold for every one.

    Up to MOST_RANGES are held against each block; more are met in time buckets.
    """
    spans = ranges.withColumnRenamed("start_ms", "_s").withColumnRenamed("end_ms", "_e")
    inside = (F.col("timecode_ms") >= F.col("_s")) & ((F.col("_e") == 0) | (F.col("timecode_ms") < F.col("_e")))
    if "path" in ranges.columns:
        return blocks.join(spans, "path").where(inside)
    few = spans.select("range_id", "_s", "_e").limit(MOST_RANGES + 1).collect()
    if len(few) <= MOST_RANGES:
        kind = spans.schema["range_id"].dataType
        each = [F.struct(F.lit(r["range_id"]).cast(kind).alias("range_id"), F.lit(r["_s"]).cast("long").alias("_s"), F.lit(r["_e"]).cast("long").alias("_e")) for r in few]
        if not each:
            return blocks.select("*", F.lit(None).cast(kind).alias("range_id"), F.lit(None).cast("long").alias("_s"), F.lit(None).cast("long").alias("_e")).where(F.lit(False))
        # What no range holds is left out before anything is exploded; this bound reaches the scan.
        bounded = blocks.where(F.col("timecode_ms") >= min(r["_s"] for r in few))
        if all(r["_e"] for r in few):
            bounded = bounded.where(F.col("timecode_ms") < max(r["_e"] for r in few))
        hit = F.filter(F.array(*each), lambda r: (F.col("timecode_ms") >= r._s) & ((r._e == 0) | (F.col("timecode_ms") < r._e)))
        return bounded.withColumn("_r", F.explode(hit)).select(*blocks.columns, "_r.range_id", "_r._s", "_r._e")
    last = blocks.agg(F.max("timecode_ms")).first()[0]
    end = F.when(F.col("_e") == 0, F.lit(last)).otherwise(F.least(F.col("_e") - 1, F.lit(last)))
    bucket = lambda c: F.floor(c / F.lit(RANGE_BUCKET_MS)).cast("long")
    # A range that ends before it starts holds nothing; sequence() would count down.
    live = spans.where(F.col("_s") <= end).withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_s")), bucket(end))))
    return blocks.withColumn("_bucket", bucket(F.col("timecode_ms"))).join(live, "_bucket").where(inside).drop("_bucket")


def split_by_ranges(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks of each range (range_id, start_ms, end_ms; end 0 is open), times from the range's start.

    ranges without a path column hold for every path; with one they are matched
    by it. Ranges may overlap, and there may be any number of them.
    """
    return _matched(blocks, ranges).withColumn("timecode_ms", F.col("timecode_ms") - F.col("_s")).select("range_id", *blocks.columns)


def split_at_keyframes(blocks: DataFrame, ranges: DataFrame, tracks: DataFrame | None = None, offset_ms: int = 0) -> DataFrame:
    """Like split_by_ranges, each part from its first keyframe on and up to the first keyframe past its end.

    ranges: (range_id, start_ms, end_ms), for every path, any number of them;
    bounds of 0 are off. A keyframe of any track ends a part; only one of the
    given tracks begins it. Blocks at or past the end that are no keyframes are
    dropped.
    """
    chosen = blocks if tracks is None else blocks_of(blocks, tracks)
    cut = _matched(chosen, ranges)
    # The first keyframe of a part is among its own blocks; the parts that there are ask for the keyframe that ends them.
    parts = cut.groupBy("path", "range_id", "_s", "_e").agg(F.min(F.when(F.col("keyframe"), F.col("block_seq"))).alias("_start"))
    # The least place of a keyframe at or past a time: a minimum carried down from the latest times; at equal times keyframes come first.
    asks = parts.where("_e > 0").select("path", F.greatest("_s", "_e").alias("_t")).distinct()
    keys = blocks.where("keyframe").groupBy("path", F.col("timecode_ms").alias("_t")).agg(F.min("block_seq").alias("_at"))
    both = keys.select("path", (-F.col("_t") * 2).alias("_o"), "_at", F.lit(None).cast("long").alias("_t")).unionByName(asks.select("path", (-F.col("_t") * 2 + 1).alias("_o"), F.lit(None).cast("long").alias("_at"), "_t"))
    told = carried(both, ["path"], "_o", {"_stop": ("min", F.col("_at"))}, chunk=20_000_000).where("_t is not null and _stop is not null").select("path", "_t", "_stop")
    bounds = parts.withColumn("_t", F.when(F.col("_e") > 0, F.greatest("_s", "_e"))).join(told, ["path", "_t"], "left").select("path", "range_id", "_start", "_stop")
    begun = (F.col("_s") == 0) | (F.col("block_seq") >= F.col("_start"))
    # A start at or past the stop is none: the stream is left there.
    open_ = F.col("_stop").isNull() | (F.col("block_seq") < F.col("_stop"))
    out = cut.join(bounds, ["path", "range_id"]).where(begun & open_)
    return out.withColumn("timecode_ms", F.col("timecode_ms") - F.col("_s") + offset_ms).select("range_id", *blocks.columns)


def _exits(times: list[int], width: int) -> list[tuple[int, int]]:
    """Steps (t, exit): a fold that enters with c leaves with the exit of the first step t >= c + width, or c.

    The fold opens a cluster at the first time that is width past its own
    start. Where the chain that begins at a block ends is found from the right.
    """
    n = len(times)
    follow = [-1] * n
    waiting: list[tuple[int, int]] = []
    for k, t in enumerate(times):
        while waiting and waiting[0][0] <= t:
            follow[heappop(waiting)[1]] = k
        heappush(waiting, (t + width, k))
    leave = list(times)
    for j in range(n - 1, -1, -1):
        if follow[j] >= 0:
            leave[j] = leave[follow[j]]
    steps: list[tuple[int, int]] = []
    top = None
    for j, t in enumerate(times):
        if top is None or t > top:
            top = t
            if steps and steps[-1][1] == leave[j]:
                steps[-1] = (t, leave[j])
            else:
                steps.append((t, leave[j]))
    return steps


def greedy_clusters(blocks: DataFrame, width_ms: int = CLUSTER_MS, chunk: int = CHUNK) -> DataFrame:
    """blocks + cluster_ms: a cluster begins at the first block, and at each one width or more past its start.

    Every block hangs on all before it. Streams are folded in chunks: each
    chunk first tells, for any state it might be entered with, the state it is
    left with; the states are chained over the chunks, and the chunks folded.
    """
    rows = blocks.withColumn("_chunk", F.floor(F.col("block_seq") / F.lit(chunk)).cast("long"))

    def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
        at, held = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:keys] != at:
                    if held:
                        yield at, held  # type: ignore[misc]
                    at, held = row[:keys], []
                held.append(row[keys:])
        if held:
            yield at, held  # type: ignore[misc]

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (path, piece), held in groups(batches, 2):
            times = [h[1] for h in held]
            steps = _exits(times, width_ms)
            # Where the fold begins here: its state after the chunk.
            first = times[0]
            out.append((path, piece, first, [s[0] for s in steps], [s[1] for s in steps]))
        cols = list(zip(*out)) or [()] * 5
        types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["path", "_chunk", "first", "steps", "exits"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (path,), held in groups(batches, 1):
            state = None
            for piece, first, steps, exits in held:
                out.append((path, piece, state))
                if state is None:
                    # The first block opens a cluster; later ones follow from there.
                    state = first
                for t, e in zip(steps, exits):
                    if t >= state + width_ms:
                        state = e
                        break
        cols = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))], ["path", "_chunk", "_enter"])

    slim = rows.select("path", "_chunk", "block_seq", "timecode_ms").repartition("path", "_chunk").sortWithinPartitions("path", "_chunk", "block_seq")
    told = slim.mapInArrow(summaries, "path string, _chunk bigint, first bigint, steps array<bigint>, exits array<bigint>")
    entered = told.repartition("path").sortWithinPartitions("path", "_chunk").mapInArrow(chain, "path string, _chunk bigint, _enter bigint")

    names, schema = rows.columns, rows.schema
    at_path, at_chunk, at_time = (names.index(c) for c in ("path", "_chunk", "timecode_ms"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            found = []
            for path, piece, t, enter in zip(batch.column(at_path).to_pylist(), batch.column(at_chunk).to_pylist(), batch.column(at_time).to_pylist(), batch.column(len(names)).to_pylist()):
                if (path, piece) != now:
                    now, state = (path, piece), enter
                if state is None or t - state >= width_ms:
                    state = t
                found.append(state)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, pa.int64())], [*names, "cluster_ms"])

    joined = rows.join(entered, ["path", "_chunk"]).select(*names, "_enter").repartition("path", "_chunk").sortWithinPartitions("path", "_chunk", "block_seq")
    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return joined.mapInArrow(fold, f"{made}, cluster_ms bigint").drop("_chunk")


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """One row a cluster; needs the data column for its size."""
    return clustered.groupBy("path", "cluster_ms").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.coalesce(F.sum(F.length("data")), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.min("timecode_ms").alias("min_ms"),
        F.max("timecode_ms").alias("max_ms"),
    )


def cues(clustered: DataFrame, interval_ms: int = CUE_INTERVAL_MS, width_ms: int = CLUSTER_MS) -> DataFrame:
    """(path, cluster_ms, time_ms, track_number): the index entries of clusters.

    A cluster is indexed by its first keyframe; one without any by its first
    block, unless the last entry lies less than interval_ms before. Clusters
    are at least width_ms apart, so with interval_ms <= width_ms that entry
    can only be the keyframe of the cluster just before.
    """
    if interval_ms > width_ms:
        raise ValueError("interval_ms must not exceed width_ms")
    entry = F.struct("timecode_ms", "track_number")
    per = clustered.groupBy("path", "cluster_ms").agg(F.min_by(entry, "block_seq").alias("first"), F.min_by(F.when(F.col("keyframe"), entry), F.when(F.col("keyframe"), F.col("block_seq"))).alias("key"))
    before = carried(per, ["path"], "cluster_ms", {"_n": ("count", F.lit(1)), "_before": ("last", F.struct("cluster_ms", F.col("key.timecode_ms").alias("t")))}, chunk=width_ms * 100_000)
    late = F.col("_before.t").isNotNull() & (F.col("first.timecode_ms") - F.col("_before.t") < interval_ms)
    chosen = before.withColumn("e", F.when(F.col("key").isNotNull(), F.col("key")).when(~F.coalesce(late, F.lit(False)), F.col("first")))
    return chosen.where("e is not null").select("path", "cluster_ms", F.col("e.timecode_ms").alias("time_ms"), F.col("e.track_number").alias("track_number"))


def inject_subtitles(blocks: DataFrame, subtitles: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """subtitles (path, seq, start_ms, ...) + before_seq: the block each goes directly before, null at the end.

    Subtitles are taken in the order of seq; each waits for the first block
    whose timecode has reached it, so a running maximum stands for both sides.
    Only rows of the two maxima that rise can decide, and those are joined in
    time buckets of their own path. chunk is that of the blocks' order.
    """
    subs = carried(subtitles.where("start_ms is not null"), ["path"], "seq", {"_m": ("max", F.col("start_ms"))})
    # Three steps read these maxima, two those of the blocks.
    subs = settle_table(subs.withColumn("_m", F.greatest("_m", "start_ms")), "subtitles")
    tops = carried(blocks.select("path", "block_seq", "timecode_ms"), ["path"], "block_seq", {"_b": ("max", F.col("timecode_ms"))}, chunk)
    tops = tops.where(F.col("_b").isNull() | (F.col("timecode_ms") > F.col("_b"))).select("path", "block_seq", F.col("timecode_ms").alias("_top"))
    tops = settle_table(tops, "tops")
    # The first rise at or above _m: an as-of join, as a union carried backwards in the order of time.
    events = tops.select("path", (-F.col("_top") * 2 - 0).alias("_o"), F.col("block_seq").alias("_at"), F.lit(None).cast("long").alias("_m"))
    asks = subs.select("path", "_m").distinct().select("path", (-F.col("_m") * 2 + 1).alias("_o"), F.lit(None).cast("long").alias("_at"), "_m")
    answered = carried(events.unionByName(asks), ["path"], "_o", {"before_seq": ("last", F.col("_at"))}, chunk=20_000_000).where("_m is not null").select("path", "_m", "before_seq")
    return subs.join(answered, ["path", "_m"]).select(*subtitles.columns, "before_seq")


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str, start: int = 1, chunk: int = CHUNK) -> DataFrame:
    """df + consecutive numbers by order within keys."""
    out = carried(df, keys, order, {name: ("count", F.lit(1))}, chunk)
    return out.withColumn(name, F.col(name) + start)


def stable_clusters(blocks: DataFrame, width_ms: int = CLUSTER_MS) -> DataFrame:
    """greedy_clusters, written out for use by several consumers."""
    return settle(greedy_clusters(blocks, width_ms))
