"""Queries that go through container files and encoded bytes and back, each with SQL over the tables themselves.

Files are written once for a session and folder of tables, below the
checkpoint folder, one for each path of segments, by as many tasks as there
are files; every relation is then scanned from them.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.functions import scalars as S
from cuewright.functions.codecs import CODEC_NAMES
from cuewright.operators import blocks as B
from cuewright.operators import containers as C
from cuewright.operators import subtitles as U
from cuewright.operators.ordered import FILE_CHUNK
from cuewright.operators.tables import latest_rows, one_of_each
from cuewright.plans.container_queries import SQL as _CONTAINER_SQL
from cuewright.plans.container_queries import _SRT, _blocks, _chapters, _events, _folder, _segments, _tracks, _with
from cuewright.runtime import table, work_folder
from cuewright.sources import ebml as X
from cuewright.sources.container_sink import edit_in_place, metadata_parts, write_containers, write_streams
from cuewright.sources.container_source import Container, decode_containers, read_container
from cuewright.streaming.clusters import cluster_stream, cue_stream

QUERIES = {}
SQL = {}
_CUES = _CONTAINER_SQL["cue_index"]

#: Text files of the round trip hold this many cues each.
CUES_A_FILE = 1000


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# --- files --------------------------------------------------------------------------------------------------------


def _tag_frames(tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A tag for each track, with its language and below it its name."""
    at = (F.row_number().over(Window.partitionBy("path").orderBy("track_index")) - 1).alias("tag_index")
    rows = tracks.select("path", at, "track_uid", "language", "name")
    tags = rows.select("path", "tag_index", F.lit("TRACK").alias("target_type"), F.col("track_uid").cast("decimal(20,0)").alias("target_id"))
    simple = lambda *values: F.struct(*[F.lit(v).alias(c) if not isinstance(v, Column) else v.alias(c) for c, v in zip(("node", "parent_node", "name", "value", "language"), values)])
    outer, inner = simple(0, -1, "LANGUAGE", F.col("language"), "und"), simple(1, 0, "NAME", F.col("name"), F.col("language"))
    return tags, rows.select("path", "tag_index", F.inline(F.array(outer, inner)))


def _attachment_frame(spark: SparkSession, d: str) -> DataFrame:
    """The JSON texts of a container's scans as attachments of it."""
    scans = latest_rows(table(spark, d, "containers"), ["scan_id"], "scanned_at")
    at = F.row_number().over(Window.partitionBy("path").orderBy("scan_id")) - 1
    return scans.select("path", at.alias("att_index"), F.col("scan_id").cast("decimal(20,0)").alias("id"), F.col("scan_id").cast("string").alias("name"), F.lit("application/json").alias("mime_type"), F.col("probe_json").cast("binary").alias("data"))


def _written(spark: SparkSession, d: str) -> str:
    """The folder of the files written from the tables of d."""
    sc = spark.sparkContext
    made = sc._cuewright_files = getattr(sc, "_cuewright_files", {})
    if d not in made:
        folder = work_folder(spark, "files")
        # Spread by path first: what follows goes by path and needs no other exchange.
        own = lambda name: table(spark, d, name).repartition("path")
        segments = latest_rows(own("segments"), ["path"], "scanned_at").withColumn("date_utc_ns", S.ns_from_date(F.col("date_utc")))
        tracks = latest_rows(own("tracks"), ["path", "track_index"], "scanned_at")
        tags, simple = _tag_frames(tracks)
        write_containers(folder, segments, tracks, table(spark, d, "blocks"), one_of_each(own("chapters"), ["path", "node"]), None, tags, simple, repeated=True)
        made[d] = folder
    return made[d]


def _attached(spark: SparkSession, d: str) -> str:
    """The folder of the files of attachments, which only the queries of attachments need."""
    sc = spark.sparkContext
    made = sc._cuewright_attached = getattr(sc, "_cuewright_attached", {})
    if d not in made:
        folder = work_folder(spark, "attached")
        attachments = _attachment_frame(spark, d)
        write_containers(folder, attachments.select("path").distinct(), spark.createDataFrame([], _tracks(spark, d).schema), attachments=attachments)
        made[d] = folder
    return made[d]


def _scan(spark: SparkSession, d: str, name: str, written=_written, **options) -> DataFrame:
    folder = written(spark, d)
    return read_container(spark, folder, name, **options).withColumn("path", F.substring("path", len(folder) + 1, 1 << 20))


def _numbered_in_files(scan: Callable[..., DataFrame], chunk: int = FILE_CHUNK) -> DataFrame:
    """Blocks with their number in the file as n: counts of chunks are carried over, for which only files of more than one chunk are scanned again."""
    chunks = lambda df: df.withColumn("_chunk", F.call_function("div", F.col("block_seq"), F.lit(chunk).cast("bigint")))
    rows = chunks(scan()).withColumn("_place", F.row_number().over(Window.partitionBy("path", "_chunk").orderBy("block_seq")))
    totals = chunks(scan(payload=False, minBytes=chunk)).groupBy("path", "_chunk").agg(F.count(F.lit(1)).alias("_total"))
    before = F.sum("_total").over(Window.partitionBy("path").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    joined = rows.join(totals.select("path", "_chunk", before.alias("_before")), ["path", "_chunk"], "left")
    return joined.withColumn("n", F.col("_place") + F.coalesce("_before", F.lit(0).cast("bigint"))).drop("_chunk", "_place", "_before")


_SCALE = "case when coalesce(timecode_scale, 0) = 0 then 1000000 else timecode_scale end"


@query(
    _with("s")
    + f"""select path, coalesce(title, '') as title, coalesce(nullif(muxing_app, ''), 'cuewright') as muxing_app, coalesce(nullif(writing_app, ''), 'cuewright') as writing_app, {_SCALE} as timecode_scale, coalesce(duration, 0.0) as duration,
    case when duration > 0 then cast(trunc(duration * ({_SCALE}) / 1e6) as bigint) else 0 end as duration_ms, lower(hex(segment_uid)) as uid, lower(hex(prev_uid)) as prev, lower(hex(next_uid)) as next, (epoch_us(date_utc) // 1000000 - 978307200) * 1000000000 as date_utc_ns from s"""
)
def file_segments(spark, d):
    hexed = lambda c: F.lower(F.hex(c))
    return _scan(spark, d, "segments").select("path", "title", "muxing_app", "writing_app", "timecode_scale", "duration", "duration_ms", hexed("segment_uid").alias("uid"), hexed("prev_uid").alias("prev"), hexed("next_uid").alias("next"), "date_utc_ns")


_CODECS = "n(id, short) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in CODEC_NAMES.items()) + ")"


@query(
    _with("st", _CODECS)
    + """select t.path, cast(row_number() over (partition by t.path order by track_index) - 1 as integer) as track_index, track_id, case when type in ('video', 'audio', 'subtitle') then type else '' end as type, coalesce(n.short, codec, '') as codec, coalesce(nullif(language, ''), 'eng') as language, coalesce(name, '') as name,
    coalesce(is_default, true) as is_default, coalesce(is_forced, false) as is_forced, lower(hex(case when octet_length(codec_private) > 0 then codec_private end)) as private, lower(hex(case when octet_length(header_stripping) > 0 then header_stripping end)) as stripped,
    case when type = 'video' then width end as width, case when type = 'video' then height end as height, case when type = 'audio' then channels end as channels, case when type = 'audio' then sample_rate end as sample_rate, case when type = 'audio' then bit_depth end as bit_depth,
    case when coalesce(track_uid, 0) = 0 then track_id else track_uid end as track_uid from t semi join s using (path) left join n on n.id = t.codec"""
)
def file_tracks(spark, d):
    return _scan(spark, d, "tracks").select("path", "track_index", "track_id", "type", "codec", "language", "name", "is_default", "is_forced", F.lower(F.hex("codec_private")).alias("private"), F.lower(F.hex("header_stripping")).alias("stripped"), "width", "height", "channels", "sample_rate", "bit_depth", F.col("track_uid").cast("bigint").alias("track_uid"))


@query(
    _with("sc")
    + """select path, node, parent_node, depth, cast(row_number() over (partition by path, parent_node order by ordinal) - 1 as integer) as ordinal, cast(case when coalesce(id, 0) = 0 then node + 1 else id end as varchar) as id, coalesce(title, '') as title, coalesce(start_ms, 0) as start_ms,
    greatest(coalesce(end_ms, 0), 0) as end_ms, lower(hex(segment_uid)) as uid from c semi join s using (path)"""
)
def file_chapters(spark, d):
    return _scan(spark, d, "chapters").select("path", "node", "parent_node", "depth", "ordinal", F.col("id").cast("string").alias("id"), "title", "start_ms", "end_ms", F.lower(F.hex("segment_uid")).alias("uid"))


@query(_with("sb") + "select path, row_number() over (partition by path order by block_seq) as n, track_number, timecode_ms, coalesce(keyframe, false) as keyframe, lower(hex(data)) as data_hex, octet_length(data) as data_len from b semi join s using (path)")
def file_blocks(spark, d):
    found = _numbered_in_files(lambda **options: _scan(spark, d, "blocks", **options))
    return found.select("path", "n", "track_number", "timecode_ms", "keyframe", F.lower(F.hex("data")).alias("data_hex"), "data_len")


@query(_with("sb") + "select path, track_number, timecode_ms, count(*) as n from b semi join s using (path) where timecode_ms >= 2000 and timecode_ms < 5000 group by all")
def file_time_range(spark, d):
    """Blocks of a time range, in splits of a few clusters, clusters beyond it unread."""
    return _scan(spark, d, "blocks", startMs=2000, endMs=5000, splitBytes=2000, payload=False).groupBy("path", "track_number", "timecode_ms").agg(F.count(F.lit(1)).alias("n"))


_WRITER = f"""z as (select path, {_SCALE} as scale from s),
    n as (select b.*, scale, row_number() over (partition by path order by block_seq) as rn from b join z using (path)),
    f(path, rn, c, k) as (
      select path, rn, timecode_ms, 1 from n where rn = 1
      union all
      select n.path, n.rn, case when n.timecode_ms - c >= 1000 or (n.timecode_ms - c) * 1000000 // scale < -32768 then n.timecode_ms else c end, k + case when n.timecode_ms - c >= 1000 or (n.timecode_ms - c) * 1000000 // scale < -32768 then 1 else 0 end
      from f join n on n.path = f.path and n.rn = f.rn + 1)"""
_RECURSIVE = _with("sb", _WRITER).replace("with ", "with recursive ", 1)


@query(
    _RECURSIVE
    + """, g as (select n.path, k, min_by(struct_pack(t := timecode_ms, n := track_number), n.rn) as first, min_by(struct_pack(t := timecode_ms, n := track_number), n.rn) filter (where keyframe) as key from f join n on n.path = f.path and n.rn = f.rn group by n.path, k),
    q(path, k, cue, last) as (
      select path, k, coalesce(key, first), coalesce(key, first).t from g where k = 1
      union all
      select g.path, g.k, case when key is not null then key when first.t - q.last >= 500 then first end, case when key is not null then key.t when first.t - q.last >= 500 then first.t else q.last end from q join g on g.path = q.path and g.k = q.k + 1)
    select path, cast(row_number() over (partition by path order by k) - 1 as integer) as cue_index, cue.t as time_ms, cue.n as track from q where cue is not null"""
)
def file_cues(spark, d):
    return _scan(spark, d, "cues").select("path", "cue_index", "time_ms", "track")


@query(
    _RECURSIVE
    + """select path, 'cluster' as name, max(k) as n from f group by path union all select distinct path, 'cues', 1 from f
    union all select path, 'info', 1 from s union all select path, 'seek_head', 1 from s
    union all select distinct path, 'tracks', 1 from tracks where path in (select path from s) union all select distinct path, 'tags', 1 from tracks where path in (select path from s)
    union all select distinct path, 'chapters', 1 from chapters where path in (select path from s)"""
)
def file_elements(spark, d):
    return _scan(spark, d, "elements").where("depth = 1").groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"))


@query(
    _with("s")
    + """select path, 'info' as name, true as is_there from s union all select distinct path, 'tracks', true from tracks where path in (select path from s)
    union all select distinct path, 'tags', true from tracks where path in (select path from s) union all select distinct path, 'chapters', true from chapters where path in (select path from s)"""
)
def file_seek_head(spark, d):
    return _scan(spark, d, "seeks").select("path", "name", "is_there")


_SCANS = "k as (select * from containers qualify row_number() over (partition by scan_id order by scanned_at desc) = 1)"


@query("with " + _SCANS + " select path, cast(row_number() over (partition by path order by scan_id) - 1 as integer) as att_index, scan_id as id, cast(scan_id as varchar) as name, 'application/json' as mime_type, coalesce(octet_length(encode(probe_json)), 0) as size, md5(coalesce(probe_json, '')) as digest from k")
def file_attachments(spark, d):
    return _scan(spark, d, "attachments", _attached).select("path", "att_index", F.col("id").cast("bigint").alias("id"), "name", "mime_type", "size", F.md5("data").alias("digest"))


@query(
    "with " + _SCANS + " select path, scan_id || ': ' || scan_id || ' (application/json, ' || case when n >= 1048576 then printf('%.1f MB', n / 1048576.0) when n >= 1024 then printf('%.1f KB', n / 1024.0) else n || ' B' end || ')' as line from (select path, scan_id, coalesce(octet_length(encode(probe_json)), 0) as n from k)"
)
def attachment_listing(spark, d):
    """Sizes come from the headers alone."""
    rows = _scan(spark, d, "attachments", _attached, payload=False)
    return rows.select("path", F.concat(F.col("id").cast("string"), F.lit(": "), F.col("name"), F.lit(" ("), F.col("mime_type"), F.lit(", "), S.format_bytes(F.col("size")), F.lit(")")).alias("line"))


_TAGS = "g as (select t.*, cast(row_number() over (partition by path order by track_index) - 1 as integer) as tag_index from t semi join s using (path))"


@query(_with("st", _TAGS) + "select path, tag_index, 'TRACK' as target_type, case when coalesce(track_uid, 0) <> 0 then track_uid end as target_id from g")
def file_tags(spark, d):
    return _scan(spark, d, "tags").select("path", "tag_index", "target_type", F.col("target_id").cast("bigint").alias("target_id"))


@query(
    _with("st", _TAGS)
    + "select path, tag_index, 0 as node, -1 as parent_node, 0 as depth, 'LANGUAGE' as name, coalesce(language, '') as value, 'und' as language from g union all select path, tag_index, 1, 0, 1, 'NAME', coalesce(name, ''), coalesce(language, '') from g"
)
def file_simple_tags(spark, d):
    return _scan(spark, d, "simple_tags").select("path", "tag_index", "node", "parent_node", "depth", "name", "value", "language")


@query(_with("st", _TAGS) + "select path, tag_index, '[TRACK] LANGUAGE = ' || coalesce(language, '') || ' (und)' as line from g")
def tag_listing(spark, d):
    rows = _scan(spark, d, "tags").join(_scan(spark, d, "simple_tags").where("depth = 0"), ["path", "tag_index"])
    some = lambda c, other: F.when(F.col(c) == "", other).otherwise(F.col(c))
    return rows.select("path", "tag_index", F.concat(F.lit("["), some("target_type", "global"), F.lit("] "), F.col("name"), F.lit(" = "), F.col("value"), F.lit(" ("), some("language", "und"), F.lit(")")).alias("line"))


@query(_with("sb") + "select path, count(*) as n_frames, cast(sum(octet_length(data)) as bigint) as n_bytes from b semi join s using (path) group by path")
def file_contents(spark, d):
    """Containers read from bytes in a column, as binaryFile gives them."""
    folder = _written(spark, d)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.expr("substring(path, locate('" + folder + f"', path) + {len(folder)})").alias("path"), "content")
    return decode_containers(raw, "blocks", payload=False).groupBy("path").agg(F.count(F.lit(1)).alias("n_frames"), F.sum("data_len").alias("n_bytes"))


@query(
    _with("tb", "f as (select path, track_id, min_by(codec, track_index) as codec, max(header_stripping) as head from t group by path, track_id)")
    + "select b.path || '/' || track_number || '.' || case when coalesce(codec, '') = '' then 'raw' else replace(replace(replace(codec, '/', '_'), '\\', '_'), '..', '_') end as file, cast(sum(octet_length(data) + case when head is null then 0 else octet_length(head) end) as bigint) as n_bytes from b join f on f.path = b.path and f.track_id = b.track_number group by all having n_bytes > 0"
)
def demux_files(spark, d):
    """Raw streams written to files, as the writer tells of them."""
    folder = work_folder(spark, "streams")
    tracks = _tracks(spark, d)
    first = tracks.groupBy("path", F.col("track_id").alias("track_number")).agg(F.min_by("codec", "track_index").alias("codec"))
    heads = tracks.groupBy("path", "track_id").agg(F.max("header_stripping").alias("header_stripping"))
    rows = B.with_headers(_blocks(spark, d, True), heads).join(first, ["path", "track_number"])
    file = F.concat(F.expr("substring(path, 2)"), F.lit("/"), F.col("track_number").cast("string"), F.lit("."), S.sanitize_codec(F.coalesce("codec", F.lit(""))))
    write_streams(folder, rows.select(file.alias("file"), F.col("block_seq").alias("seq"), "data"))
    kept = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return kept.select(F.expr("substring(path, locate('" + folder + f"', path) + {len(folder)})").alias("file"), F.col("length").alias("n_bytes"))


@query(_with("sb") + "select (select min(path) from s) as path, 'Edited in place' as title, (select count(*) from b where path = (select min(path) from s)) as n_blocks")
def file_edit_in_place(spark, d):
    """The first file's title overwritten where it stands, its blocks untouched."""
    folder = work_folder(spark, "edited")
    first = _segments(spark, d).agg(F.min("path")).first()[0]
    one = lambda df: df.where(F.col("path") == first)
    segments = one(_segments(spark, d)).withColumn("title", F.lit("x" * 60))
    write_containers(folder, segments, one(_tracks(spark, d)), one(_blocks(spark, d, True)))
    file = f"{folder}{first}"
    c = Container(file)
    info = {**segments.drop("path").first().asDict(), "title": "Edited in place"}
    edit_in_place(file, metadata_parts(info, [r.asDict() for r in one(_tracks(spark, d)).collect()]))
    del c
    n = read_container(spark, file, "blocks", payload=False).agg(F.count(F.lit(1)).alias("n_blocks"))
    return read_container(spark, file, "segments").select(F.lit(first).alias("path"), "title").crossJoin(n)


# --- encoded bytes ------------------------------------------------------------------------------------------------

_VALUE = "block_seq * (timecode_ms + 1) * (track_number + 7)"


@query(
    _with("b", f"n as (select path, block_seq, {_VALUE} as v from b)")
    + """select path, block_seq, v as vint, v as lax, v as uint, -v as sint, v / 7.0 as float, 'n' || v as text, v as size, case when v <= 126 then 5 when v <= 16382 then 6 when v <= 2097150 then 7 when v <= 268435454 then 8 when v <= 34359738366 then 9 when v <= 4398046511102 then 10 when v <= 562949953421310 then 11 else 12 end as header_len,
    case when v >= 268435456 then 4 when v >= 2097152 then 3 when v >= 16384 then 2 else 1 end as id_len from n"""
)
def element_bytes(spark, d):
    """Numbers, texts and element headers encoded to bytes and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def back(name: str, v: object) -> object:
            raw = X.encode(name, v)
            head = X.read_head(io.BytesIO(raw), 0)
            return X.decode_value(X.ELEMENTS[head.element][1], raw[head.header :])

        for b in batches:
            values = b.column(2).to_pylist()
            out: list[list] = [[] for _ in range(8)]
            for v in values:
                head = X.read_head(io.BytesIO(X.id_bytes(X.SEGMENT_ID) + X.size_bytes(v)), 0)
                row = (X.read_vint(X.size_bytes(v))[0], X.lax_vint(X.size_bytes(v))[0], back("chapter_uid", v), back("date_utc", -v), back("duration", v / 7.0), back("title", f"n{v}"), head.size, head.header)
                for c, x in zip(out, row):
                    c.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], b.column(2), *[pa.array(c, t) for c, t in zip(out, types)]], ["path", "block_seq", "v", "vint", "lax", "uint", "sint", "float", "text", "size", "header_len"])

    rows = _blocks(spark, d).select("path", "block_seq", F.expr(_VALUE).alias("v"))
    made = rows.mapInArrow(run, "path string, block_seq bigint, v bigint, vint bigint, lax bigint, uint bigint, sint bigint, float double, text string, size bigint, header_len int")
    # The lengths that expressions tell stand beside those of the bytes: both must be right for the row to be.
    told = S.element_header_len(F.lit(X.SEGMENT_ID), F.col("v"))
    same = F.when(told == F.col("header_len"), F.col("header_len"))
    return made.select("path", "block_seq", "vint", "lax", "uint", "sint", "float", "text", "size", same.alias("header_len"), F.length(S.encode_element_id(F.col("v"))).alias("id_len"))


_LACES = """l as (select path, block_seq, track_number, coalesce(keyframe, false) as keyframe, kind, unnest(case when kind = 'fixed' then [hex(data), hex(data), hex(data)] else [hex(data), hex(data) || hex(data), '', hex(data)] end) as frame, unnest(case when kind = 'fixed' then [0, 1, 2] else [0, 1, 2, 3] end) as lace_index
    from b, (values ('xiph'), ('fixed'), ('ebml'), ('standard')) as k(kind))"""


@query(_with("b", _LACES) + "select path, block_seq, kind, lace_index, track_number, keyframe and lace_index = 0 as keyframe, lower(frame) as frame_hex from l")
def laced_frames(spark, d):
    """Frames laced into one block in each way, and taken apart again."""
    kinds = {"xiph": (1, False), "fixed": (2, False), "ebml": (3, False), "standard": (3, True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for path, seq, track, key, data in zip(*[c.to_pylist() for c in b.columns]):
                data = data or b""
                for kind, (code, standard) in kinds.items():
                    frames = [data] * 3 if kind == "fixed" else [data, data + data, b"", data]
                    raw = X.encode_block(track, -5, bool(key), X.encode_lace(code, frames, standard), lacing=code)
                    head = X.read_head(io.BytesIO(raw), 0)
                    number, _, first, read = X.block_frames(raw[head.header :], True, standard)
                    out += [(path, seq, kind, i, number, first and i == 0, x.hex()) for i, x in enumerate(read)]
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string()))], ["path", "block_seq", "kind", "lace_index", "track_number", "keyframe", "frame_hex"])

    rows = _blocks(spark, d, True).select("path", "block_seq", "track_number", "keyframe", "data")
    return rows.mapInArrow(run, "path string, block_seq bigint, kind string, lace_index int, track_number bigint, keyframe boolean, frame_hex string")


@query(_with("b") + "select path, block_seq, track_number, timecode_ms, false as keyframe, lower(hex(data)) as data_hex from b")
def block_groups(spark, d):
    """Blocks wrapped in groups, in a cluster of their own, and read back; groups tell of no keyframes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for path, seq, track, ms, data in zip(*[c.to_pylist() for c in b.columns]):
                raw = X.encode("cluster", X.encode("timestamp", ms) + X.void(9) + X.encode_block(track, 0, True, data or b"", group=True))
                f = io.BytesIO(raw)
                out += [(path, seq, t, at, key, x.hex()) for _, _, t, at, key, x, _ in X.cluster_blocks(f, X.read_head(f, 0), 1_000_000)]
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))], ["path", "block_seq", "track_number", "timecode_ms", "keyframe", "data_hex"])

    return _blocks(spark, d, True).select("path", "block_seq", "track_number", "timecode_ms", "data").mapInArrow(run, "path string, block_seq bigint, track_number bigint, timecode_ms bigint, keyframe boolean, data_hex string")


# --- texts --------------------------------------------------------------------------------------------------------

_QUOTED_TEXT = "'> ' || replace(replace(text, chr(13), ''), chr(10), chr(10) || '> ')"


def _quoted() -> Column:
    return F.concat(F.lit("> "), F.regexp_replace(F.regexp_replace("text", "\r", ""), "\n", "\n> "))


@query(_with("e", "k as (select *, row_number() over (partition by path order by seq) - 1 as n from e where start_ms is not null and end_ms is not null and text is not null and length(text) > 0)") + f"select path, n // {CUES_A_FILE} as part, n % {CUES_A_FILE} + 1 as seq, start_ms, end_ms, {_QUOTED_TEXT} as text from k")
def srt_files(spark, d):
    """Cues written to the texts of files and parsed again."""
    rows = _events(spark, d, "subtitle_events").where("start_ms is not null and end_ms is not null and length(text) > 0").withColumn("text", _quoted())
    cues = U.render_srt(rows).withColumn("part", F.floor((F.col("number") - 1) / CUES_A_FILE).cast("bigint"))
    files = cues.groupBy(F.struct("path", "part").alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "cue"))), lambda x: x.cue), "").alias("value"))
    return U.parse_srt(files).select("path.path", "path.part", F.col("seq").cast("bigint").alias("seq"), "start_ms", "end_ms", "text")


_ONE_LINE = "replace(replace(fields, chr(13), ''), chr(10), '\\N')"


@query(_with("a", "k as (select *, row_number() over (partition by path order by seq) - 1 as n from a where start_ms is not null and end_ms is not null and len(string_split(fields, ',')) >= 7)") + f"select path, n // {CUES_A_FILE} as part, n % {CUES_A_FILE} + 1 as seq, start_ms // 10 * 10 as start_ms, end_ms // 10 * 10 as end_ms, regexp_replace({_ONE_LINE}, ' +$', '') as fields from k")
def ass_files(spark, d):
    """Dialogue lines written below a header and parsed again; short ones are passed over."""
    rows = _events(spark, d, "ass_events").where("start_ms is not null and end_ms is not null and size(split(fields, ',')) >= 7")
    rows = B.numbered(rows, ["path"], "seq", "n", 0).withColumn("part", F.floor(F.col("n") / CUES_A_FILE).cast("bigint"))
    line = U.ass_dialogue(F.lit("0"), F.col("start_ms"), F.col("end_ms"), F.regexp_replace(F.regexp_replace("fields", "\r", ""), "\n", r"\\\\N"))
    head = "[Script Info]\nTitle: t\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\nComment: none\n"
    files = rows.groupBy(F.struct("path", "part").alias("path")).agg(F.concat(F.lit(head), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x.line), "\n")).alias("value"))
    return U.parse_ass(files).select("path.path", "path.part", F.col("seq").cast("bigint").alias("seq"), "start_ms", "end_ms", "fields")


@query(_with("e") + "select path, seq, start_ms as timecode_ms, text, start_ms + 3000 as end_ms from e where length(text) > 0")
def subtitle_block_texts(spark, d):
    """Subtitle blocks with padding bytes: their texts, empty ones dropped, and the end they get."""
    blocks = _events(spark, d, "subtitle_events").select("path", "seq", F.col("start_ms").alias("timecode_ms"), F.concat(F.col("text").cast("binary"), F.lit(b"\0\0")).alias("data"))
    return B.subtitle_texts(blocks).select("path", "seq", "timecode_ms", "text", S.default_subtitle_end(F.col("timecode_ms")).alias("end_ms"))


@query(_with("a") + "select path, seq, cast(seq % 4 as varchar) as layer, fields from a where fields is not null and seq % 5 <> 0")
def ass_block_fields(spark, d):
    """ASS payloads taken apart; those with fewer than three parts are dropped, here every fifth."""
    ev = _events(spark, d, "ass_events").where("fields is not null")
    whole = F.concat(F.col("seq").cast("string"), F.lit(","), (F.col("seq") % 4).cast("string"), F.lit(","), F.col("fields"))
    data = F.when(F.col("seq") % 5 == 0, F.concat(F.col("seq").cast("string"), F.lit(",short"))).otherwise(whole)
    return B.ass_payloads(ev.select("path", "seq", F.concat(data.cast("binary"), F.lit(b"\0")).alias("data"))).select("path", "seq", "layer", "fields")


_T = _SRT.replace("{0}", "start_ms") + " || ' --> ' || " + _SRT.replace("{0}", "end_ms")


@query(
    _with("e")
    + """select path, seq, start_ms as line_start, end_ms as line_end, coalesce(regexp_full_match(text, '[0-9]+'), false) as digits, substr(path, 2) as safe, cast(null as varchar) as unsafe, path as spec_path, cast(seq as bigint) as spec_track, case when ends_with(lower(path), '.ass') or ends_with(lower(path), '.ssa') then 'ass' else 'srt' end as format,
    seq || '|' || (seq + 1) as ids, start_ms || '-' || (start_ms + 5) as ranges, least(cast(floor(seq * 100 / 250) as integer), 100) as percent from e where start_ms >= 0 and end_ms >= 0"""
)
def text_scalars(spark, d):
    """Time lines, paths, lists, ranges and suffixes, parsed from the texts that they are written to."""
    ev = _events(spark, d, "subtitle_events").where("start_ms >= 0 and end_ms >= 0")
    line = S.parse_srt_time_line(F.concat(S.srt_time(F.col("start_ms")), F.lit(" --> "), S.srt_time(F.col("end_ms"))))
    spec = S.source_spec(F.concat("path", F.lit(":"), F.col("seq").cast("string")))
    ids = S.parse_track_ids(F.concat(F.col("seq").cast("string"), F.lit(" , "), (F.col("seq") + 1).cast("string")))
    ranges = S.parse_time_ranges(F.concat(F.col("start_ms").cast("string"), F.lit("-"), (F.col("start_ms") + 5).cast("string")))
    inner = F.expr("substring(path, 2)")
    return ev.select(
        "path", "seq", line.start_ms.alias("line_start"), line.end_ms.alias("line_end"), F.coalesce(S.is_digits_only(F.col("text")), F.lit(False)).alias("digits"), S.safe_path(F.concat(F.lit("x/.././"), inner)).alias("safe"), S.safe_path(F.concat(F.lit("../"), inner)).alias("unsafe"),
        spec.path.alias("spec_path"), spec.track_id.alias("spec_track"), S.subtitle_format(F.col("path")).alias("format"), F.array_join(ids.cast("array<string>"), "|").alias("ids"), F.concat(ranges[0].start_ms.cast("string"), F.lit("-"), ranges[0].end_ms.cast("string")).alias("ranges"), S.progress_percent(F.col("seq"), F.lit(250)).alias("percent"),
    )


# --- totals, existence, streams -----------------------------------------------------------------------------------


@query(_with("s") + "select regexp_extract(path, '^(/[^/]*)/', 1) as dst, cast(sum(coalesce(duration_ms, 0)) as bigint) as total_ms, count(*) as n_sources from s group by 1")
def join_totals(spark, d):
    return C.join_totals(_segments(spark, d).select(_folder().alias("dst"), "path"), _segments(spark, d))


@query(_with("t") + "select path, track_id, cast(bool_or(type = 'subtitle') as boolean) as is_subtitle, cast(bool_or(type = 'subtitle' and codec in ('ass', 'ssa')) as boolean) as is_ass from t group by path, track_id")
def subtitle_track_exists(spark, d):
    return C.subtitle_tracks(_tracks(spark, d))


@query(
    "with recursive b as (select distinct path, block_seq, track_number, timecode_ms, keyframe from blocks), n as (select *, row_number() over (partition by path order by block_seq) as rn, coalesce(lag(timecode_ms) over (partition by path order by block_seq), 0) as before from b),"
    " f(path, rn, c, o) as (select path, rn, timecode_ms, true from n where rn = 1 union all select n.path, n.rn, case when n.timecode_ms - c >= 1000 then n.timecode_ms else c end, n.timecode_ms - c >= 1000 from f join n on n.path = f.path and n.rn = f.rn + 1)"
    " select n.path, block_seq, c as cluster_ms, o as opens_cluster, timecode_ms < before - 1000 as went_backwards from f join n on n.path = f.path and n.rn = f.rn"
)
def stream_clusters(spark, d):
    """Clusters and backward timecodes of the block stream, read as a stream with state kept between batches."""
    return _streamed(spark, d).select("path", "block_seq", "cluster_ms", "opens_cluster", "went_backwards")


def _run(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives of all there is, written to a folder."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    source = f"{d}/blocks.parquet"
    schema = spark.read.parquet(source).drop("data").schema
    # As a pattern the path may be a file or a folder.
    stream = spark.readStream.schema(schema).parquet(source[:-1] + "[t]").dropDuplicates(["path", "block_seq"])
    return _run(cluster_stream(stream), work_folder(spark, "stream"))


@query(
    _CUES.replace("select path, cluster_ms, cue.t as time_ms, cue.n as track_number from q where cue is not null", "select q.path, q.cluster_ms, cue.t as time_ms, cue.n as track_number from q join h on h.path = q.path and h.rn = q.rn where cue is not null and not (key is null and q.rn = (select max(rn) from h as z where z.path = q.path))")
)
def stream_cues(spark, d):
    """Index entries of the clustered stream as soon as they are known; a last cluster without a keyframe stays open."""
    clustered = _streamed(spark, d)
    folder = work_folder(spark, "clustered")
    clustered.write.parquet(folder)
    return _run(cue_stream(spark.readStream.schema(clustered.schema).parquet(folder)), work_folder(spark, "cues"))
