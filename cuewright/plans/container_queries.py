"""Queries of the container operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.functions import scalars as S
from cuewright.functions.codecs import CODEC_NAMES, codec_id_from_short, codec_short_name
from cuewright.operators import blocks as B
from cuewright.operators import containers as C
from cuewright.operators import subtitles as U
from cuewright.operators.ordered import ranked
from cuewright.operators.tables import distinct_blocks, latest_rows, one_of_each
from cuewright.runtime import table

#: The relations of the SQL: one row of each key.
CTE = {
    "b": "b as (select distinct path, block_seq, track_number, timecode_ms, keyframe, data from blocks)",
    "t": "t as (select * from tracks qualify row_number() over (partition by path, track_index order by scanned_at desc) = 1)",
    "s": "s as (select * from segments qualify row_number() over (partition by path order by scanned_at desc) = 1)",
    "c": "c as (select distinct * from chapters)",
    "p": "p as (select distinct * from track_patches)",
    "e": "e as (select * from subtitle_events qualify row_number() over (partition by path, seq order by loaded_at) = 1)",
    "a": "a as (select * from ass_events qualify row_number() over (partition by path, seq order by loaded_at) = 1)",
}
RANGES = [(1, 0, 1500), (2, 1500, 3000), (3, 2500, 4000), (4, 4000, 0)]
RANGES_SQL = "r(range_id, s, e) as (values (1, 0, 1500), (2, 1500, 3000), (3, 2500, 4000), (4, 4000, 0))"


def _with(names: str, *more: str) -> str:
    return "with " + ", ".join([*[CTE[n] for n in names], *more]) + " "


def _blocks(spark: SparkSession, d: str, payload: bool = False) -> DataFrame:
    return distinct_blocks(table(spark, d, "blocks"), payload)


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    return latest_rows(table(spark, d, "tracks"), ["path", "track_index"], "scanned_at")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return latest_rows(table(spark, d, "segments"), ["path"], "scanned_at")


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    return one_of_each(table(spark, d, "chapters"), ["path", "node"])


def _patches(spark: SparkSession, d: str) -> DataFrame:
    return one_of_each(table(spark, d, "track_patches"), ["patch_id"])


def _events(spark: SparkSession, d: str, name: str) -> DataFrame:
    return one_of_each(table(spark, d, name).drop("loaded_at"), ["path", "seq"])


def _folder(c: str = "path") -> Column:
    return F.regexp_extract(c, r"^(/[^/]*)/", 1)


def _ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RANGES, "range_id int, start_ms long, end_ms long")


QUERIES = {}
SQL = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- validation ---------------------------------------------------------------------------------------------------

_LAG = "w as (select *, lag(timecode_ms, 1, 0) over (partition by path order by block_seq) as previous_ms, row_number() over (partition by path order by block_seq) as block_no from b)"


@query(
    _with("stb", _LAG, "k as (select path, track_number from b group by all)", "m as (select t.* from t semi join s using (path))")
    + """
    select path, 'V01' as check_id, 'error' as severity, 'missing TimecodeScale' as message from s where coalesce(timecode_scale, 0) = 0
    union all select path, 'V02', 'warning', 'no duration set' from s where coalesce(duration, 0) = 0 and coalesce(duration_ms, 0) = 0
    union all select path, 'V03', 'warning', 'missing MuxingApp' from s where coalesce(muxing_app, '') = ''
    union all select path, 'V04', 'warning', 'missing WritingApp' from s where coalesce(writing_app, '') = ''
    union all select path, 'V05', 'error', 'no tracks' from s anti join m using (path)
    union all select path, 'V06', 'error', 'duplicate track ID ' || track_id from (select *, row_number() over (partition by path, track_id order by track_index) as nth from m) where nth > 1
    union all select path, 'V07', 'error', 'track ' || track_id || ': no codec' from m where coalesce(codec, '') = ''
    union all select path, 'V08', 'warning', 'track ' || track_id || ': video without dimensions' from m where type = 'video' and (width is null or height is null)
    union all select path, 'V09', 'warning', 'track ' || track_id || ': video without CodecPrivate' from m where type = 'video' and coalesce(octet_length(codec_private), 0) = 0
    union all select path, 'V10', 'warning', 'track ' || track_id || ': audio without sample rate' from m where type = 'audio' and sample_rate is null
    union all select path, 'V11', 'warning', 'track ' || track_id || ': no language set' from m where coalesce(language, '') = ''
    union all select path, 'V12', 'warning', 'no video track' from s where path not in (select path from m where type = 'video')
    union all select path, 'V15', 'warning', 'timecode went backwards: ' || previous_ms || 'ms → ' || timecode_ms || 'ms at block ' || block_no from w semi join s using (path) where timecode_ms < previous_ms - 1000
    union all select path, 'V16', 'warning', 'no blocks found (metadata-only file?)' from s where path not in (select path from b)
    union all select path, 'V17', 'warning', 'no keyframes found' from (select path, bool_or(coalesce(keyframe, false)) as k from b semi join s using (path) group by path) where not k
    union all select path, 'V18', 'warning', 'track ' || track_id || ' (' || coalesce(type, '') || '): no blocks' from m where path in (select path from b) and (path, track_id) not in (select (path, track_number) from k)"""
)
def validate_issues(spark, d):
    return C.validate(_segments(spark, d), _tracks(spark, d), _blocks(spark, d))


@query(_with("b", _LAG) + "select path, block_seq, track_number, timecode_ms, previous_ms, block_no from w where timecode_ms < previous_ms")
def backward_timecodes(spark, d):
    return B.backward_timecodes(_blocks(spark, d), 0).select("path", "block_seq", "track_number", "timecode_ms", "previous_ms", "block_no")


@query(_with("tb") + "select path, track_index, track_id, type from t where path in (select path from b) and (path, track_id) not in (select (path, track_number) from b)")
def tracks_without_blocks(spark, d):
    return C.tracks_without_blocks(_tracks(spark, d), _blocks(spark, d)).select("path", "track_index", "track_id", "type")


@query(_with("t") + "select path, track_index, track_id from (select *, row_number() over (partition by path, track_id order by track_index) as nth from t) where nth > 1")
def duplicate_track_ids(spark, d):
    nth = F.row_number().over(Window.partitionBy("path", "track_id").orderBy("track_index"))
    return _tracks(spark, d).withColumn("nth", nth).where("nth > 1").select("path", "track_index", "track_id")


# --- aggregates ---------------------------------------------------------------------------------------------------


@query(_with("b") + "select path, track_number, count(*) as n_blocks from b group by all")
def block_counts(spark, d):
    return B.counts_by_track(_blocks(spark, d))


@query(_with("b") + "select path, count(*) as n_blocks, coalesce(bool_or(keyframe), false) as any_keyframe, max_by(timecode_ms, block_seq) as last_timecode_ms from b group by path")
def stream_totals(spark, d):
    return B.stream_totals(_blocks(spark, d))


@query(_with("b") + "select path, track_number, count(*) as n_frames, cast(sum(octet_length(data)) as bigint) as n_bytes from b group by all")
def track_sizes(spark, d):
    return B.track_sizes(_blocks(spark, d, True))


@query(_with("stc") + "select path, title, duration_ms, (select count(*) from t where t.path = s.path) as n_tracks, (select count(*) from c where c.path = s.path and depth = 0) as n_chapters from s")
def info_summary(spark, d):
    n_t = _tracks(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("n_tracks"))
    n_c = _chapters(spark, d).where("depth = 0").groupBy("path").agg(F.count(F.lit(1)).alias("n_chapters"))
    out = _segments(spark, d).join(n_t, "path", "left").join(n_c, "path", "left")
    return out.select("path", "title", "duration_ms", F.coalesce("n_tracks", F.lit(0)).alias("n_tracks"), F.coalesce("n_chapters", F.lit(0)).alias("n_chapters"))


@query("select distinct path from blocks")
def distinct_sources(spark, d):
    return table(spark, d, "blocks").select("path").distinct()


@query(_with("t") + "select path, track_id, min_by(codec, track_index) as codec, min(track_index) as track_index from t group by path, track_id")
def first_match(spark, d):
    return _tracks(spark, d).groupBy("path", "track_id").agg(F.min_by("codec", "track_index").alias("codec"), F.min("track_index").alias("track_index"))


# --- filters, projections, listings -------------------------------------------------------------------------------

_ROW = "path, block_seq, track_number, timecode_ms, keyframe"


@query(_with("tb") + f"select {_ROW} from b where (path, track_number) in (select (path, track_id) from t where track_id in (1, 3))")
def track_filter(spark, d):
    return B.blocks_of(_blocks(spark, d), B.wanted_tracks(_tracks(spark, d), [1, 3]))


@query(_with("b") + f"select {_ROW} from b where timecode_ms >= 2000 and timecode_ms < 5000")
def time_range(spark, d):
    return B.time_range(_blocks(spark, d), 2000, 5000)  # the filter passes below the deduplication


@query(_with("b") + "select path, block_seq, timecode_ms - 2000 + 150 as timecode_ms from b where timecode_ms >= 2000")
def time_shift(spark, d):
    return B.shifted(B.time_range(_blocks(spark, d), 2000), 150 - 2000).select("path", "block_seq", "timecode_ms")


@query(_with("tb", "m as (select path, track_id, min(track_index) + 1 as new_id from t where type <> 'subtitle' group by path, track_id)") + "select b.path, block_seq, cast(new_id as bigint) as track_number, timecode_ms, keyframe from b join m on b.path = m.path and b.track_number = m.track_id")
def remap_join(spark, d):
    remap = _tracks(spark, d).where("type <> 'subtitle'").groupBy("path", F.col("track_id").alias("old_id")).agg((F.min("track_index") + 1).cast("long").alias("new_id"))
    return B.remapped(_blocks(spark, d), remap)


_KEPT = "k as (select *, row_number() over (partition by path order by track_index) as new_id from t where type <> 'subtitle')"


@query(_with("t", _KEPT) + "select path, track_index, track_id as old_id, new_id as track_id from k")
def remove_track_list(spark, d):
    tracks = _tracks(spark, d)
    kept, _ = C.remove_track(tracks, _blocks(spark, d), tracks.where("type = 'subtitle'").select("path", "track_id").distinct().join(tracks.where("type <> 'subtitle'").select("path", "track_id").distinct(), ["path", "track_id"], "left_anti"))
    return kept.where("type <> 'subtitle'").select("path", "track_index", "old_id", "track_id")


SQL["remove_track_list"] = _with("t", "dr as (select distinct path, track_id from t where type = 'subtitle' except select distinct path, track_id from t where type <> 'subtitle')", "k as (select *, row_number() over (partition by path order by track_index) as new_id from t where (path, track_id) not in (select (path, track_id) from dr))") + "select path, track_index, track_id as old_id, new_id as track_id from k where type <> 'subtitle'"


@query(_with("tb", "k as (select *, row_number() over (partition by path order by track_index) as new_id from t where track_id <> 1)", "m as (select path, track_id, min(new_id) as new_id from k group by path, track_id)") + "select b.path, block_seq, new_id as track_number, timecode_ms, keyframe from b join m on b.path = m.path and b.track_number = m.track_id")
def remove_track_blocks(spark, d):
    tracks = _tracks(spark, d)
    return C.remove_track(tracks, _blocks(spark, d), tracks.where("track_id = 1").select("path", "track_id").distinct())[1]


@query(_with("tb", "h as (select path, track_id, max(header_stripping) as head from t where header_stripping is not null group by all)") + "select b.path, block_seq, lower(hex(case when head is null then data else head || data end)) as data_hex from b left join h on b.path = h.path and b.track_number = h.track_id")
def header_restore(spark, d):
    tracks = _tracks(spark, d)
    heads = tracks.groupBy("path", "track_id").agg(F.max("header_stripping").alias("header_stripping"))
    return B.with_headers(_blocks(spark, d, True), heads).select("path", "block_seq", F.lower(F.hex("data")).alias("data_hex"))


@query(
    _with("t")
    + """select path, track_index, track_id || ': ' || type || ' ' || coalesce(codec, '') || ' [' || coalesce(language, '') || ']' || case when coalesce(name, '') <> '' then ' ' || name else '' end
    || case when width is not null and height is not null then ' ' || width || 'x' || height else '' end || case when channels is not null then ' ' || channels || 'ch' else '' end
    || case when is_default then ' default' else '' end || case when is_forced then ' forced' else '' end as line from t"""
)
def track_listing(spark, d):
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = F.concat(
        F.col("track_id").cast("string"), F.lit(": "), F.col("type"), F.lit(" "), some("codec"), F.lit(" ["), some("language"), F.lit("]"),
        F.when(some("name") != "", F.concat(F.lit(" "), F.col("name"))).otherwise(""),
        F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.concat(F.lit(" "), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))).otherwise(""),
        F.when(F.col("channels").isNotNull(), F.concat(F.lit(" "), F.col("channels").cast("string"), F.lit("ch"))).otherwise(""),
        F.when(F.col("is_default"), " default").otherwise(""), F.when(F.col("is_forced"), " forced").otherwise(""),
    )
    return _tracks(spark, d).select("path", "track_index", line.alias("line"))


@query(_with("c") + "select path, node, printf('%02d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) || ' ' || coalesce(title, '') as line from c where depth = 0 and start_ms is not null")
def chapter_listing(spark, d):
    return _chapters(spark, d).where("depth = 0 and start_ms is not null").select("path", "node", F.concat(S.clock_time(F.col("start_ms")), F.lit(" "), F.coalesce("title", F.lit(""))).alias("line"))


@query(
    _with("stc")
    + """select path, 'info' as part, cast(0 as bigint) as at, title, cast(null as varchar) as kind, cast(duration_ms as bigint) as start_ms from s
    union all select path, 'tracks', track_index, name, type || '/' || coalesce(codec, '') || '/' || coalesce(cast(width as varchar), ''), cast(track_id as bigint) from t semi join s using (path)
    union all select path, 'chapters', node, title, cast(parent_node as varchar), start_ms from c semi join s using (path)"""
)
def probe_json(spark, d):
    """Everything of a container's metadata as one JSON text, read back for comparison."""
    made = C.probe_json(_segments(spark, d), _tracks(spark, d), _chapters(spark, d))
    schema = "title string, duration_ms bigint, tracks array<struct<track_index:bigint,track_id:bigint,type:string,codec:string,name:string,width:bigint>>, chapters array<struct<node:bigint,parent_node:bigint,title:string,start_ms:bigint>>"
    j = made.select("path", F.from_json("json", schema).alias("j")).select("path", "j.*")
    one = j.select("path", F.lit("info").alias("part"), F.lit(0).cast("bigint").alias("at"), "title", F.lit(None).cast("string").alias("kind"), F.col("duration_ms").alias("start_ms"))
    tracks = j.select("path", F.explode("tracks").alias("x")).select("path", F.lit("tracks").alias("part"), F.col("x.track_index").alias("at"), F.col("x.name").alias("title"), F.concat("x.type", F.lit("/"), F.coalesce("x.codec", F.lit("")), F.lit("/"), F.coalesce(F.col("x.width").cast("string"), F.lit(""))).alias("kind"), F.col("x.track_id").alias("start_ms"))
    chapters = j.select("path", F.explode("chapters").alias("x")).select("path", F.lit("chapters").alias("part"), F.col("x.node").alias("at"), F.col("x.title").alias("title"), F.col("x.parent_node").cast("string").alias("kind"), "x.start_ms")
    return one.unionByName(tracks).unionByName(chapters)


# --- splits, clusters, cues ---------------------------------------------------------------------------------------


@query(_with("b", RANGES_SQL) + f"select range_id, path, block_seq, track_number, timecode_ms - s as timecode_ms, keyframe from b, r where timecode_ms >= s and (e = 0 or timecode_ms < e)")
def split_ranges(spark, d):
    return B.split_by_ranges(_blocks(spark, d), _ranges(spark))


@query(
    _with(
        "tb",
        RANGES_SQL,
        "m as (select distinct path, track_id from t where track_id in (1, 2))",
        "x as (select path, range_id, min(block_seq) as stop from b, r where keyframe and e > 0 and timecode_ms >= e and (s = 0 or timecode_ms >= s) group by all)",
        "y as (select path, range_id, min(block_seq) as start from b join m using (path), r where track_number = track_id and keyframe and s > 0 and timecode_ms >= s and (e = 0 or timecode_ms < e) group by all)",
    )
    + """select r.range_id, b.path, block_seq, track_number, timecode_ms - s as timecode_ms, keyframe from b join m on b.path = m.path and b.track_number = m.track_id cross join r
    left join x on x.path = b.path and x.range_id = r.range_id left join y on y.path = b.path and y.range_id = r.range_id
    where timecode_ms >= s and (e = 0 or timecode_ms < e) and (s = 0 or block_seq >= start) and (stop is null or block_seq < stop)"""
)
def split_keyframes(spark, d):
    return B.split_at_keyframes(_blocks(spark, d), _ranges(spark), B.wanted_tracks(_tracks(spark, d), [1, 2]))


_CHAPTER_RANGES = """cr as (select path, row_number() over (partition by path order by ordinal) as range_id, coalesce(start_ms, 0) as start_ms,
    coalesce(nullif(coalesce(end_ms, 0), 0), lead(start_ms) over (partition by path order by ordinal), 0) as end_ms from c where depth = 0)"""


@query(_with("c", _CHAPTER_RANGES) + "select path, cast(range_id as integer) as range_id, start_ms, end_ms from cr")
def chapter_ranges(spark, d):
    return C.chapter_ranges(_chapters(spark, d))


@query(_with("cb", _CHAPTER_RANGES) + "select cast(range_id as integer) as range_id, b.path, block_seq, track_number, timecode_ms - start_ms as timecode_ms, keyframe from b join cr using (path) where timecode_ms >= start_ms and (end_ms = 0 or timecode_ms < end_ms)")
def split_chapters(spark, d):
    return B.split_by_ranges(_blocks(spark, d), C.chapter_ranges(_chapters(spark, d)))


@query(_with("c", _CHAPTER_RANGES) + "select path, printf('part_%03d.mkv', range_id) as name from cr")
def part_names(spark, d):
    return C.chapter_ranges(_chapters(spark, d)).select("path", C.part_name("part_%03d.mkv", F.col("range_id")).alias("name"))


_CLUSTERS = """n as (select *, row_number() over (partition by path order by block_seq) as rn from b),
    f(path, rn, block_seq, timecode_ms, cluster_ms) as (
      select path, rn, block_seq, timecode_ms, timecode_ms from n where rn = 1
      union all
      select n.path, n.rn, n.block_seq, n.timecode_ms, case when n.timecode_ms - f.cluster_ms >= 1000 then n.timecode_ms else f.cluster_ms end from f join n on n.path = f.path and n.rn = f.rn + 1)"""
_RECURSIVE = "with recursive " + CTE["b"] + ", " + _CLUSTERS


@query(_RECURSIVE + " select path, block_seq, timecode_ms, cluster_ms from f")
def greedy_clusters(spark, d):
    return B.greedy_clusters(_blocks(spark, d)).select("path", "block_seq", "timecode_ms", "cluster_ms")


@query(_RECURSIVE + " select f.path, cluster_ms, count(*) as n_blocks, cast(sum(octet_length(data)) as bigint) as n_bytes, min(f.timecode_ms) as min_ms, max(f.timecode_ms) as max_ms from f join b on f.path = b.path and f.block_seq = b.block_seq group by f.path, cluster_ms")
def cluster_summary(spark, d):
    return B.cluster_summary(B.greedy_clusters(_blocks(spark, d, True)))


@query(
    _RECURSIVE
    + """, g as (select f.path, cluster_ms, min_by(struct_pack(t := b.timecode_ms, n := track_number), b.block_seq) as first, min_by(struct_pack(t := b.timecode_ms, n := track_number), b.block_seq) filter (where keyframe) as key
      from f join b on f.path = b.path and f.block_seq = b.block_seq group by f.path, cluster_ms),
    h as (select *, row_number() over (partition by path order by cluster_ms) as rn from g),
    q(path, rn, cluster_ms, cue, last) as (
      select path, rn, cluster_ms, case when key is not null then key when first.t >= -1 then first end, case when key is not null then key.t when first.t >= -1 then first.t else -501 end from h where rn = 1
      union all
      select h.path, h.rn, h.cluster_ms, case when key is not null then key when first.t - q.last >= 500 then first end, case when key is not null then key.t when first.t - q.last >= 500 then first.t else q.last end
      from q join h on h.path = q.path and h.rn = q.rn + 1)
    select path, cluster_ms, cue.t as time_ms, cue.n as track_number from q where cue is not null"""
)
def cue_index(spark, d):
    return B.cues(B.greedy_clusters(_blocks(spark, d)))


_MKV = "regexp_replace(path, '(\\.[A-Za-z]+)?\\.srt$', '.mkv')"


def _subtitles_of_containers(spark, d):
    return _events(spark, d, "subtitle_events").where("start_ms is not null").withColumn("path", F.regexp_replace("path", r"(\.[A-Za-z]+)?\.srt$", ".mkv")).groupBy("path", "seq").agg(F.min("start_ms").alias("start_ms"))


@query(
    _with("eb", f"u as (select {_MKV} as path, seq, min(start_ms) as start_ms from e where start_ms is not null group by all)", "v as (select *, max(start_ms) over (partition by path order by seq) as m from u)", "x as (select *, max(timecode_ms) over (partition by path order by block_seq) as top from b)")
    + "select v.path, v.seq, v.start_ms, min(x.block_seq) as before_seq from v left join x on x.path = v.path and x.top >= v.m group by v.path, v.seq, v.start_ms"
)
def subtitle_inject(spark, d):
    return B.inject_subtitles(_blocks(spark, d), _subtitles_of_containers(spark, d))


@query(_with("b") + "select path, block_seq from (select path, block_seq, row_number() over (partition by path order by block_seq) as n from b) where n % 50 = 0")
def progress_ticks(spark, d):
    return B.numbered(_blocks(spark, d).select("path", "block_seq"), ["path"], "block_seq", "n").where("n % 50 = 0").select("path", "block_seq")


# --- mux, merge, join, add ----------------------------------------------------------------------------------------

_DIR = "regexp_extract(path, '^(/[^/]*)/', 1)"
_INPUTS = f"i as (select {_DIR} as dst, row_number() over (partition by {_DIR} order by path, track_index) as ord, path, track_id from t where type in ('video', 'audio'))"


def _mux_inputs(spark, d, types: list[str] | None) -> DataFrame:
    tracks = _tracks(spark, d)
    chosen = tracks.where(F.col("type").isin(types)) if types else tracks
    listed = ranked(chosen.select(_folder().alias("dst"), "path", "track_index", "track_id"), ["dst"], ["path", "track_index"], "ord")
    return listed.select("dst", "ord", "path", "track_id").select("*", F.lit(None).cast("string").alias("language"), F.when(F.col("ord") == 1, "Main").alias("name"), (F.col("ord") == 1).alias("is_default"))


@query(
    _with("t", _INPUTS, "f as (select path, track_id, min_by(struct_pack(a := type, b := codec, c := language, d := name), track_index) as t from t group by path, track_id)")
    + "select dst, ord as new_id, ord, i.path, i.track_id as old_id, f.t.a as type, f.t.b as codec, f.t.c as language, case when ord = 1 then 'Main' else f.t.d end as name, ord = 1 as is_default from i join f on f.path = i.path and f.track_id = i.track_id"
)
def mux_track_list(spark, d):
    return C.mux_tracks(_mux_inputs(spark, d, ["video", "audio"]), _tracks(spark, d))


def _mux_sql(inputs: str) -> str:
    return (
        _with("tb", inputs, "m as (select dst, path, track_id, max(ord) as new_id from i group by all)", "o as (select dst, path, min(ord) as source_ord from i group by all)")
        + "select m.dst, new_id as track_number, timecode_ms, source_ord, block_seq, b.path, keyframe from b join m on b.path = m.path and b.track_number = m.track_id join o on o.dst = m.dst and o.path = m.path"
    )


@query(_mux_sql(_INPUTS))
def mux_blocks(spark, d):
    return C.mux_blocks(C.mux_tracks(_mux_inputs(spark, d, ["video", "audio"]), _tracks(spark, d)), _blocks(spark, d))


@query(_mux_sql(_INPUTS.replace(" where type in ('video', 'audio')", "")))
def merge_blocks(spark, d):
    return C.mux_blocks(C.mux_tracks(_mux_inputs(spark, d, None), _tracks(spark, d)), _blocks(spark, d))


_SOURCES = f"o as (select {_DIR} as dst, row_number() over (partition by {_DIR} order by path) as ord, path from s)"


def _sources(spark, d) -> DataFrame:
    return ranked(_segments(spark, d).select(_folder().alias("dst"), "path"), ["dst"], ["path"], "ord").select("dst", "ord", "path")


_OFFSETS = "z as (select o.dst, o.ord, o.path, cast(coalesce(sum(coalesce(duration_ms, 0)) over (partition by dst order by ord rows between unbounded preceding and 1 preceding), 0) as bigint) as offset_ms from o join s using (path))"


@query(_with("s", _SOURCES, _OFFSETS) + "select * from z")
def join_offsets(spark, d):
    return C.join_offsets(_sources(spark, d), _segments(spark, d)).select("dst", "ord", "path", "offset_ms")


_LISTED = "l as (select *, row_number() over (partition by path order by track_index) as pos from t)"


@query(
    _with("stb", _SOURCES, _OFFSETS, _LISTED, "first as (select dst, min_by(path, ord) as path from o group by dst)", "g as (select dst, pos, track_id as new_id from first join l using (path))",
          "m as (select o.dst, o.path, l.track_id, max_by(g.new_id, l.pos) as new_id from o join l using (path) join g on g.dst = o.dst and g.pos = l.pos group by all)")
    + "select z.dst, new_id as track_number, timecode_ms + offset_ms as timecode_ms, ord as source_ord, block_seq, b.path, keyframe from b join m on b.path = m.path and b.track_number = m.track_id join z on z.dst = m.dst and z.path = m.path"
)
def join_blocks(spark, d):
    return C.join_blocks(_sources(spark, d), _segments(spark, d), _tracks(spark, d), _blocks(spark, d))


@query(
    _with("st", _SOURCES, _LISTED, "first as (select dst, min_by(path, ord) as path from o group by dst)", "g as (select dst, pos, type as want from first join l using (path))", "e1 as (select o.dst, o.path, pos, want from o join g using (dst))", "e2 as (select o.dst, o.path, pos, type from o join l using (path))")
    + "select dst, path, cast(pos as integer) as pos, want, type from e1 full join e2 using (dst, path, pos) where want is distinct from type"
)
def join_layouts(spark, d):
    return C.join_layouts(_sources(spark, d), _tracks(spark, d)).select("dst", "path", "pos", "want", "type")


@query(
    _with("tb", f"x as (select {_DIR} as dst, min(path) as a, max(path) as z from b group by 1)", "n as (select path, max(track_id) + 1 as new_id from t group by path)")
    + """select b.path, 0 as side, block_seq, track_number, timecode_ms, keyframe from b where path in (select a from x)
    union all select x.a, 1, block_seq, new_id, timecode_ms, keyframe from b join x on b.path = x.z join n on n.path = x.a where track_number = 1"""
)
def add_track(spark, d):
    blocks, tracks = _blocks(spark, d), _tracks(spark, d)
    pairs = blocks.groupBy(_folder().alias("dst")).agg(F.min("path").alias("a"), F.max("path").alias("z"))
    added = blocks.where("track_number = 1").join(pairs, F.col("path") == F.col("z")).select(F.col("a").alias("path"), "block_seq", "timecode_ms", "keyframe")
    new_id = tracks.groupBy("path").agg((F.max("track_id") + 1).alias("new_id"))
    return C.add_track(pairs.select(F.col("a").alias("path")), blocks, added, new_id)


# --- comparison and edits -----------------------------------------------------------------------------------------

_PAIRS = f"x as (select * from (select path as pair, path as a, lead(path) over (partition by {_DIR} order by path) as z from s) where z is not null)"


def _sides(spark, d, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    listed = ranked(_segments(spark, d).select(_folder().alias("dst"), "path"), ["dst"], ["path"], "n")
    after = listed.select("dst", (F.col("n") - 1).alias("n"), F.col("path").alias("z"))
    pairs = listed.join(after, ["dst", "n"]).select(F.col("path").alias("pair"), F.col("path").alias("a"), "z")
    side = lambda c: df.join(pairs.select("pair", F.col(c).alias("path")), "path")
    return side("a"), side("z")


_Q = "('\"' || replace(replace(replace(coalesce({0}, ''), '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n') || '\"')"


def _q(c: str) -> str:
    return _Q.replace("{0}", c)


_SUMMARY = "coalesce({0}.type, '') || ' ' || coalesce({0}.codec, '') || ' lang=' || coalesce({0}.language, '') || ' name=' || "


@query(
    _with("st", _PAIRS, _LISTED, "u as (select pair, l.* from l join x on l.path = x.a)", "v as (select pair, l.* from l join x on l.path = x.z)", "f as (select coalesce(u.pair, v.pair) as pair, 'track[' || coalesce(u.pos, v.pos) || ']' as k, u, v from u full join v on u.pair = v.pair and u.pos = v.pos)")
    + "select pair, 'added' as type, k as section, " + _SUMMARY.replace("{0}", "v") + _q("v.name") + " as detail from f where u.path is null"
    + " union all select pair, 'removed', k, " + _SUMMARY.replace("{0}", "u") + _q("u.name") + " from f where v.path is null"
    + "".join(f" union all select pair, 'changed', k || '.{c}', coalesce(u.{c}, '') || ' → ' || coalesce(v.{c}, '') from f where u.path is not null and v.path is not null and coalesce(u.{c}, '') <> coalesce(v.{c}, '')" for c in ("type", "codec", "language"))
    + " union all select pair, 'changed', k || '.name', " + _q("u.name") + " || ' → ' || " + _q("v.name") + " from f where u.path is not null and v.path is not null and coalesce(u.name, '') <> coalesce(v.name, '')"
    + "".join(f" union all select pair, 'changed', k || '.{n}', coalesce(u.{c}, false) || ' → ' || coalesce(v.{c}, false) from f where u.path is not null and v.path is not null and coalesce(u.{c}, false) <> coalesce(v.{c}, false)" for c, n in (("is_default", "default"), ("is_forced", "forced")))
)
def compare_tracks(spark, d):
    a, b = _sides(spark, d, C._listed(_tracks(spark, d)))
    return C.compare_tracks(a, b)


_TOP = "l as (select *, row_number() over (partition by path order by ordinal) as pos from c where depth = 0)"


@query(
    _with("sc", _PAIRS, _TOP, "u as (select pair, l.* from l join x on l.path = x.a)", "v as (select pair, l.* from l join x on l.path = x.z)", "n as (select coalesce(a.pair, b.pair) as pair, coalesce(na, 0) as na, coalesce(nb, 0) as nb from (select pair, count(*) as na from u group by pair) a full join (select pair, count(*) as nb from v group by pair) b on a.pair = b.pair)")
    + "select pair, 'changed' as type, 'chapters.count' as section, na || ' → ' || nb as detail from n where na <> nb"
    + " union all select u.pair, 'changed', 'chapter[' || u.pos || '].title', " + _q("u.title") + " || ' → ' || " + _q("v.title") + " from u join v on u.pair = v.pair and u.pos = v.pos where coalesce(u.title, '') <> coalesce(v.title, '')"
    + " union all select u.pair, 'changed', 'chapter[' || u.pos || '].time', coalesce(u.start_ms, 0) || '-' || coalesce(u.end_ms, 0) || 'ms → ' || coalesce(v.start_ms, 0) || '-' || coalesce(v.end_ms, 0) || 'ms' from u join v on u.pair = v.pair and u.pos = v.pos where coalesce(u.start_ms, 0) <> coalesce(v.start_ms, 0) or coalesce(u.end_ms, 0) <> coalesce(v.end_ms, 0)"
)
def compare_chapters(spark, d):
    top = _chapters(spark, d).where("depth = 0").withColumn("pos", F.row_number().over(Window.partitionBy("path").orderBy("ordinal")))
    a, b = _sides(spark, d, top)
    return C.compare_chapters(a, b)


@query(
    _with("s", _PAIRS, "f as (select pair, u, v from x join s u on u.path = x.a join s v on v.path = x.z)")
    + " union all ".join(f"select pair, 'changed' as type, 'info.{c}' as section, " + _q(f"u.{c}") + " || ' → ' || " + _q(f"v.{c}") + f" as detail from f where coalesce(u.{c}, '') <> coalesce(v.{c}, '')" for c in ("title", "muxing_app", "writing_app"))
    + " union all select pair, 'changed', 'duration', coalesce(u.duration_ms, 0) || 'ms → ' || coalesce(v.duration_ms, 0) || 'ms' from f where coalesce(u.duration_ms, 0) <> coalesce(v.duration_ms, 0)"
)
def compare_info(spark, d):
    a, b = _sides(spark, d, _segments(spark, d))
    return C.compare_info(a, b)


@query(_with("sc", _PAIRS, "n as (select pair, (select count(*) from c where c.path = x.a) as na, (select count(*) from c where c.path = x.z) as nb from x)") + "select pair, 'changed' as type, 'nodes.count' as section, na || ' → ' || nb as detail from n where na <> nb")
def compare_counts(spark, d):
    a, b = _sides(spark, d, _chapters(spark, d))
    return C.compare_counts(a, b, "nodes")


@query(
    _with("tp", "q as (select path, track_id, " + ", ".join(f"max_by({c}, (patched_at, patch_id)) filter (where {c} is not null) as {c}" for c in ("language", "name", "is_default", "is_forced")) + " from p group by path, track_id)")
    + "select t.path, track_index, t.track_id, " + ", ".join(f"coalesce(q.{c}, t.{c}) as {c}" for c in ("language", "name", "is_default", "is_forced")) + " from t left join q on t.path = q.path and t.track_id = q.track_id"
)
def patched_tracks(spark, d):
    return C.apply_patches(_tracks(spark, d), _patches(spark, d)).select("path", "track_index", "track_id", "language", "name", "is_default", "is_forced")


@query(_with("s") + "select path, case when path = (select min(path) from s) then 'New title' else title end as title from s")
def edit_title(spark, d):
    segments = _segments(spark, d)
    first = segments.agg(F.min("path")).first()[0]
    return C.edit({"segments": segments}, segments=lambda df: C.set_title(df, first, "New title"))["segments"].select("path", "title")


# --- subtitles ----------------------------------------------------------------------------------------------------

_SRT = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
_ASS = "printf('%d:%02d:%02d.%02d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} // 10 % 100)"


@query(
    _with("e", "k as (select *, row_number() over (partition by path order by seq) as number from e where length(text) > 0 and start_ms is not null and end_ms is not null)")
    + "select path, number, number || chr(10) || " + _SRT.replace("{0}", "start_ms") + " || ' --> ' || " + _SRT.replace("{0}", "end_ms") + " || chr(10) || text || chr(10) || chr(10) as cue from k"
)
def srt_render(spark, d):
    return U.render_srt(_events(spark, d, "subtitle_events"))


@query(_with("a") + "select path, seq, 'Dialogue: 0,' || " + _ASS.replace("{0}", "start_ms") + " || ',' || " + _ASS.replace("{0}", "end_ms") + " || ',' || fields as line from a where start_ms is not null and end_ms is not null and fields is not null")
def ass_render(spark, d):
    ev = _events(spark, d, "ass_events").where("start_ms is not null and end_ms is not null and fields is not null")
    return ev.select("path", "seq", U.ass_dialogue(F.lit("0"), F.col("start_ms"), F.col("end_ms"), F.col("fields")).alias("line"))


@query(_with("a") + "select path, seq, start_ms // 10 * 10 as start_ms, end_ms // 10 * 10 as end_ms, fields from a where start_ms is not null and end_ms is not null and len(string_split(fields, ',')) >= 7")
def ass_parse(spark, d):
    parsed = F.filter(F.array(S.parse_dialogue(F.col("line"))), lambda x: x.isNotNull())
    return ass_render(spark, d).select("path", "seq", F.explode(parsed).alias("p")).select("path", "seq", "p.start_ms", "p.end_ms", "p.fields")


@query(_with("a") + "select path, seq, (row_number() over (partition by path order by seq) - 1) || ',0,' || fields as payload from a where fields is not null")
def ass_payloads(spark, d):
    ev = B.numbered(_events(spark, d, "ass_events").where("fields is not null"), ["path"], "seq", "ord", 0)
    return ev.select("path", "seq", U.ass_block_payload(F.col("ord"), F.col("fields")).alias("payload"))


# --- scalars ------------------------------------------------------------------------------------------------------

_BIG = "block_seq * (timecode_ms + 1) * (track_number + 7)"


def _of_big(f) -> Column:
    """f of the product of _BIG: a bigint, and a decimal where it goes beyond 64 bits, since decimals are slow."""
    parts = [F.col("block_seq"), F.col("timecode_ms") + 1, F.col("track_number") + 7]
    v, wide = reduce(F.try_multiply, parts), reduce(F.try_multiply, [p.cast("decimal(20,0)") for p in parts]).cast("decimal(38,0)")
    return F.when(v.isNotNull(), f(v)).otherwise(f(wide))


def _least(value: str, limits: list[int], last: int) -> str:
    return "case " + " ".join(f"when {value} <= {x} then {i}" for i, x in enumerate(limits, 1)) + f" else {last} end"


@query(
    _with("b", f"n as (select path, block_seq, {_BIG} as v, timecode_ms - 3000 as g from b)")
    + f"""select path, block_seq, {_least("v", [(1 << (7 * w)) - 2 for w in range(1, 8)], 8)} as data_size_len, {_least("v", [(1 << (8 * w)) - 1 for w in range(1, 8)], 8)} as uint_len,
    case when v >= 268435456 then 4 when v >= 2097152 then 3 when v >= 16384 then 2 else 1 end as element_id_len, {_least("v", [(1 << (7 * w)) - 2 for w in range(1, 8)], 8)} as vint_len,
    case when g >= -64 and g < 64 then 1 when g >= -8192 and g < 8192 then 2 when g >= -1048576 and g < 1048576 then 3 else 4 end as signed_vint_len, case when v < 16 then '0' else '' end || lower(printf('%x', v)) as hexed from n"""
)
def size_lengths(spark, d):
    g = F.expr("timecode_ms - 3000")
    return _blocks(spark, d).select("path", "block_seq", *[_of_big(f).alias(f.__name__) for f in (S.data_size_len, S.uint_len, S.element_id_len, S.vint_len)], S.signed_vint_len(g).alias("signed_vint_len"), _of_big(S.hex_uint).alias("hexed"))


@query(_with("b", f"n as (select path, block_seq, {_BIG} as v from b)") + "select path, block_seq, " + _SRT.replace("{0}", "v") + " as srt, " + _ASS.replace("{0}", "v") + " as ass, printf('%02d:%02d:%02d', v // 3600000, v // 60000 % 60, v // 1000 % 60) as clock, v as srt_back, v // 10 * 10 as ass_back from n")
def time_formats(spark, d):
    """Times beyond 64 bits are written, but read back as null."""
    srt, ass = _of_big(S.srt_time), _of_big(S.ass_time)
    return _blocks(spark, d).select("path", "block_seq", srt.alias("srt"), ass.alias("ass"), _of_big(S.clock_time).alias("clock"), S.parse_srt_time(srt).alias("srt_back"), S.parse_ass_time(ass).alias("ass_back"))


@query(_with("b", f"n as (select path, block_seq, {_BIG} as v from b)") + "select path, block_seq, case when v >= 1073741824 then printf('%.1f GB', v / 1073741824.0) when v >= 1048576 then printf('%.1f MB', v / 1048576.0) when v >= 1024 then printf('%.1f KB', v / 1024.0) else v || ' B' end as size from n")
def byte_formats(spark, d):
    return _blocks(spark, d).select("path", "block_seq", _of_big(S.format_bytes).alias("size"))


@query(
    _with("t", "n(id, short) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in CODEC_NAMES.items()) + ")")
    + "select path, track_index, coalesce(x.short, codec) as short_name, coalesce(y.id, codec) as codec_id, case when codec = '' then 'raw' else replace(replace(replace(codec, '/', '_'), '\\', '_'), '..', '_') end as file_part from t left join n x on x.id = codec left join n y on y.short = codec"
)
def codec_names(spark, d):
    c = F.col("codec")
    return _tracks(spark, d).select("path", "track_index", codec_short_name(c).alias("short_name"), codec_id_from_short(c).alias("codec_id"), S.sanitize_codec(c).alias("file_part"))


@query(_with("s") + "select path, case when duration > 0 and timecode_scale > 0 then cast(trunc(duration * timecode_scale / 1e6) as bigint) else 0 end as computed_ms, (epoch_us(date_utc) // 1000000 - 978307200) * 1000000000 as date_ns from s")
def durations_and_dates(spark, d):
    return _segments(spark, d).select("path", S.duration_ms(F.col("duration"), F.col("timecode_scale")).alias("computed_ms"), S.ns_from_date(F.col("date_utc")).alias("date_ns"))


@query(_with("sb") + "select b.path, block_seq, timecode_ms * timecode_scale // 1000000 as ticks_ms from b join s using (path)")
def rescaled_timecodes(spark, d):
    return _blocks(spark, d).join(_segments(spark, d).select("path", "timecode_scale"), "path").select("path", "block_seq", S.timecode_ms(F.col("timecode_ms"), F.col("timecode_scale")).alias("ticks_ms"))


@query(
    _with("b", "n as (select path, block_seq, octet_length(data) as a, octet_length(data) * 60 as m, octet_length(data) * 7 as z from b)")
    + f"""select path, block_seq, a // 255 + 1 + m // 255 + 1 as xiph, cast(0 as bigint) as fixed, cast({_least("a", [126, 16382], 3)} + case when m - a >= -64 and m - a < 64 then 1 when m - a >= -8192 and m - a < 8192 then 2 else 3 end as bigint) as ebml from n"""
)
def lacing_headers(spark, d):
    n = F.length("data").cast("long")
    sizes = F.array(n, n * 60, n * 7)
    return _blocks(spark, d, True).select("path", "block_seq", *[S.lacing_header_len(F.lit(k), sizes).alias(k) for k in ("xiph", "fixed", "ebml")])


@query(_with("t", "f as (select path, track_id, min_by(codec, track_index) as codec from t group by path, track_id)") + "select path, track_id, track_id || '.' || case when coalesce(codec, '') = '' then 'raw' else replace(replace(replace(codec, '/', '_'), '\\', '_'), '..', '_') end as file_name from f")
def demux_file_names(spark, d):
    first = _tracks(spark, d).groupBy("path", "track_id").agg(F.min_by("codec", "track_index").alias("codec"))
    return first.select("path", "track_id", F.concat(F.col("track_id").cast("string"), F.lit("."), S.sanitize_codec(F.coalesce("codec", F.lit("")))).alias("file_name"))
