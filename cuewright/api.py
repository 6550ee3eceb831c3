"""Operations on container files by path: each reads frames, composes operators and writes files.

The operators themselves take and return DataFrames (cuewright.operators);
these are the calls for whoever has files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions.scalars import sanitize_codec, trim_nulls
from cuewright.operators import blocks as B
from cuewright.operators import containers as C
from cuewright.operators import subtitles as U
from cuewright.operators.ordered import FILE_CHUNK
from cuewright.sources import ebml as X
from cuewright.sources.container_sink import edit_in_place as _edit_in_place
from cuewright.sources.container_sink import metadata_parts, write_containers, write_streams
from cuewright.sources.container_source import read_container, resolve

_MUX_ORDER = ("timecode_ms", "source_ord", "block_seq")


@dataclass(frozen=True)
class Media:
    """The relations of one or more container files; blocks are read when used."""

    spark: SparkSession
    segments: DataFrame
    tracks: DataFrame
    chapters: DataFrame
    attachments: DataFrame
    tags: DataFrame
    simple_tags: DataFrame
    blocks: DataFrame

    def write(self, folder: str, order: Sequence[str] = ("block_seq",)) -> list[tuple[str, str, int, int]]:
        return write_containers(folder, self.segments, self.tracks, self.blocks, self.chapters, self.attachments, self.tags, self.simple_tags, order=order)


@dataclass(frozen=True)
class TrackInput:
    path: str
    track_id: int
    language: str = ""
    name: str = ""
    is_default: bool = False


def open_media(spark: SparkSession, path: str, **options: object) -> Media:
    read = lambda t: read_container(spark, path, t, **options)
    return Media(spark, *[read(t) for t in ("segments", "tracks", "chapters", "attachments", "tags", "simple_tags", "blocks")])


def _open_all(spark: SparkSession, paths: Sequence[str]) -> Media:
    medias = [open_media(spark, p) for p in dict.fromkeys(paths)]
    if not medias:
        raise ValueError("no sources")
    out = medias[0]
    for m in medias[1:]:
        out = replace(out, **{n: getattr(out, n).unionByName(getattr(m, n)) for n in ("segments", "tracks", "chapters", "attachments", "tags", "simple_tags", "blocks")})
    return out


def _at(df: DataFrame, path: str) -> DataFrame:
    return df.withColumn("path", F.lit(path))


def _split_target(out: str) -> tuple[str, str]:
    head, _, name = out.rpartition("/")
    return head or ".", name


def _only(df: DataFrame, path: str) -> DataFrame:
    return df.where(F.col("path") == path)


def validate(spark: SparkSession, path: str) -> DataFrame:
    """Issues of the files at a path, those of decoding among them."""
    m = open_media(spark, path, payload=False)
    sized = m.segments.join(read_container(spark, path, "files").withColumnRenamed("length", "file_bytes"), "path", "left")
    found = C.validate(sized, m.tracks, m.blocks, FILE_CHUNK)
    broken = read_container(spark, path, "errors")
    at_start = F.col("table") == "clusters"
    text = F.when(at_start, F.concat(F.lit("cannot read clusters: "), F.col("message"))).when(F.col("table") == "blocks", F.concat(F.lit("cluster read error at block "), F.col("n_blocks").cast("string"), F.lit(": "), F.col("message"))).otherwise(F.concat(F.lit("cannot read: "), F.col("message")))
    return found.unionByName(broken.select("path", F.when(at_start, "V13").otherwise("V14").alias("check_id"), F.lit("error").alias("severity"), text.alias("message")))


def probe(spark: SparkSession, path: str) -> DataFrame:
    """(path, json): all metadata of each file as one JSON text."""
    m = open_media(spark, path, payload=False)
    cues = read_container(spark, path, "cues")
    return C.probe_json(m.segments, m.tracks, m.chapters, m.attachments, m.tags, m.simple_tags, cues)


def compare(spark: SparkSession, a: str, b: str) -> DataFrame:
    """(type, section, detail) of the differences between two files."""
    x, y = open_media(spark, a, payload=False), open_media(spark, b, payload=False)
    pair = lambda df: df.withColumn("pair", F.lit(1))
    listed = lambda df: pair(C._listed(df))
    top = lambda df: pair(df.where("depth = 0").withColumn("pos", F.col("ordinal") + 1))
    out = C.compare_info(pair(x.segments), pair(y.segments)).unionByName(C.compare_tracks(listed(x.tracks), listed(y.tracks)))
    out = out.unionByName(C.compare_chapters(top(x.chapters), top(y.chapters))).unionByName(C.compare_counts(pair(x.attachments), pair(y.attachments), "attachments"))
    return out.drop("pair")


def demux(spark: SparkSession, path: str, folder: str, track_ids: Sequence[int] = ()) -> list[tuple[str, int]]:
    """Raw streams '<id>.<codec>' of the wanted tracks, stripped headers put back."""
    m = open_media(spark, path)
    chosen = B.wanted_tracks(m.tracks, track_ids)
    if not chosen.take(1):
        raise ValueError("no such tracks")
    blocks = B.with_headers(B.blocks_of(m.blocks, chosen), chosen)
    names = chosen.groupBy("path", F.col("track_id").alias("track_number")).agg(F.min_by("codec", "track_index").alias("codec"))
    file = F.concat(F.col("track_number").cast("string"), F.lit("."), sanitize_codec(F.col("codec")))
    return write_streams(folder, blocks.join(names, ["path", "track_number"]).select(file.alias("file"), F.col("block_seq").alias("seq"), "data"))


def mux(spark: SparkSession, inputs: Sequence[TrackInput], out: str, info_from: str | None = None, with_metadata: bool = False) -> list[tuple]:
    """One file of the given tracks, ordered by time, renumbered 1..n."""
    m = _open_all(spark, [i.path for i in inputs])
    folder, name = _split_target(out)
    rows = [(name, n, i.path, i.track_id, i.language, i.name, i.is_default) for n, i in enumerate(inputs, 1)]
    df = spark.createDataFrame(rows, "dst string, ord long, path string, track_id long, language string, name string, is_default boolean")
    muxed = C.mux_tracks(df, m.tracks)
    full = m.tracks.drop("track_index", "type", "codec", "language", "name", "is_default", "track_uid").withColumnRenamed("track_id", "old_id").dropDuplicates(["path", "old_id"])
    tracks = muxed.join(full, ["path", "old_id"]).select(F.col("dst").alias("path"), F.col("new_id").cast("int").alias("track_index"), F.col("new_id").alias("track_id"), "type", "codec", "language", "name", "is_default", *[c for c in full.columns if c not in ("path", "old_id")])
    blocks = C.mux_blocks(muxed, m.blocks).drop("path").withColumnRenamed("dst", "path")
    first = info_from or inputs[0].path
    last = blocks.groupBy("path").agg(F.max("timecode_ms").alias("duration_ms"))
    base = _only(m.segments, first).select("timecode_scale").withColumn("timecode_scale", F.when(F.col("timecode_scale") > 0, F.col("timecode_scale")).otherwise(X.DEFAULT_SCALE))
    segments = base.withColumn("path", F.lit(name)).join(last, "path", "left").withColumn("duration", F.col("duration_ms") * 1e6 / F.col("timecode_scale"))
    more = {n: _at(_only(getattr(m, n), first), name) for n in ("chapters", "tags", "simple_tags")} if with_metadata else {}
    return write_containers(folder, segments, tracks, blocks, order=_MUX_ORDER, **more)


def merge(spark: SparkSession, sources: Sequence[str], out: str, tracks: dict[str, Sequence[int]] | None = None) -> list[tuple]:
    """All, or the chosen, tracks of the sources; chapters and tags of the first."""
    inputs = []
    for path in sources:
        rows = open_media(spark, path).tracks.orderBy("track_index").select("track_id", "is_default").collect()
        wanted = (tracks or {}).get(path)
        inputs += [TrackInput(path, r["track_id"], is_default=r["is_default"]) for r in rows if not wanted or r["track_id"] in wanted]
    if not inputs:
        raise ValueError("no tracks selected")
    return mux(spark, inputs, out, sources[0], with_metadata=True)


def merge_with_subtitles(spark: SparkSession, base: str, subtitle: str, out: str, language: str = "und", name: str = "", sources: Sequence[str] = (), tracks: dict[str, Sequence[int]] | None = None, format: str | None = None) -> list[tuple]:
    """base merged with the other sources, and a subtitle file added to what comes out.

    Without other sources it is merge_subtitle(). The merged file between the
    two steps stands beside out and is removed.
    """
    if not sources:
        return merge_subtitle(spark, base, subtitle, out, language, name, format)
    folder, file = _split_target(out)
    between = f"{folder}/{file}.merged-{uuid.uuid4().hex}"
    try:
        merge(spark, [base, *sources], between, tracks)
        return merge_subtitle(spark, between, subtitle, out, language, name, format)
    finally:
        system, where = resolve(between)
        if system.get_file_info(where).type == pafs.FileType.File:
            system.delete_file(where)


def join(spark: SparkSession, sources: Sequence[str], out: str) -> list[tuple]:
    """The sources one after another; their track layouts must agree."""
    m = _open_all(spark, sources)
    folder, name = _split_target(out)
    order = spark.createDataFrame([(name, n, p) for n, p in enumerate(sources, 1)], "dst string, ord long, path string")
    wrong = C.join_layouts(order, m.tracks).take(1)
    if wrong:
        raise ValueError(f"{wrong[0]['path']}: track {wrong[0]['pos']} is {wrong[0]['type']}, not {wrong[0]['want']}")
    blocks = C.join_blocks(order, m.segments, m.tracks, m.blocks).drop("path").withColumnRenamed("dst", "path")
    total = C.join_totals(order, m.segments).first()["total_ms"]
    first = sources[0]
    segments = _at(_only(m.segments, first), name).withColumn("duration", F.lit(total) * 1e6 / F.greatest("timecode_scale", F.lit(1)))
    rest = {n: _at(_only(getattr(m, n), first), name) for n in ("chapters", "attachments", "tags", "simple_tags")}
    return write_containers(folder, segments, _at(_only(m.tracks, first), name), blocks, order=("source_ord", "block_seq"), **rest)


def split(spark: SparkSession, path: str, folder: str, ranges: Sequence[tuple[int, int]] = (), pattern: str = "part_%03d.mkv") -> list[tuple]:
    """Parts at the given ranges (end 0 is open), or at the chapters; each begins at a keyframe."""
    # What lies before every range is neither part of one nor ends one, so its clusters aren't read.
    first = min((a for a, _ in ranges), default=0)
    m = open_media(spark, path, **({"startMs": first} if first > 0 else {}))
    spans = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(ranges, 1)], "range_id int, start_ms long, end_ms long") if ranges else C.chapter_ranges(m.chapters).drop("path")
    if not spans.take(1):
        raise ValueError("no ranges and no chapters")
    name = F.format_string(pattern, F.col("range_id"))
    blocks = B.split_at_keyframes(m.blocks, spans, m.tracks).withColumn("path", name)
    each = lambda df: df.drop("path").crossJoin(spans.select(name.alias("path")))
    # The parts keep the metadata of the whole but for the duration, which is theirs.
    return write_containers(folder, each(m.segments), each(m.tracks), blocks, each(m.chapters), each(m.attachments), each(m.tags), each(m.simple_tags), compat_duration=False)


def remove_track(spark: SparkSession, path: str, out: str, track_ids: Sequence[int]) -> list[tuple]:
    m = open_media(spark, path)
    folder, name = _split_target(out)
    tracks, blocks = C.remove_track(m.tracks, m.blocks, m.tracks.where(F.col("track_id").isin(list(track_ids))).select("path", "track_id").distinct())
    if not tracks.take(1):
        raise ValueError("no track would be left")
    m = replace(m, tracks=tracks.drop("old_id"), blocks=blocks)
    return replace(m, **{n: _at(getattr(m, n), name) for n in ("segments", "tracks", "chapters", "attachments", "tags", "simple_tags", "blocks")}).write(folder)


def add_track(spark: SparkSession, path: str, source: TrackInput, out: str) -> list[tuple]:
    """The file with one more track, merged in by time; its id is the greatest plus one."""
    base, other = open_media(spark, path), open_media(spark, source.path)
    folder, name = _split_target(out)
    found = other.tracks.where(F.col("track_id") == source.track_id).limit(1)
    if not found.take(1):
        raise ValueError(f"track {source.track_id} not found in {source.path}")
    new = (base.tracks.agg(F.max("track_id")).first()[0] or 0) + 1
    place = base.tracks.count()
    over = lambda c, v: F.lit(v) if v else F.col(c)
    extra = found.withColumn("track_id", F.lit(new)).withColumn("track_index", F.lit(place)).withColumn("language", over("language", source.language)).withColumn("name", over("name", source.name)).withColumn("is_default", F.lit(source.is_default)).withColumn("track_uid", F.lit(None).cast("decimal(20,0)"))
    mine = _at(base.blocks, name).withColumn("side", F.lit(0))
    more = _at(other.blocks.where(F.col("track_number") == source.track_id), name).withColumn("track_number", F.lit(new)).withColumn("side", F.lit(1))
    rest = {n: _at(getattr(base, n), name) for n in ("chapters", "attachments", "tags", "simple_tags")}
    return write_containers(folder, _at(base.segments, name), _at(base.tracks.unionByName(extra), name), mine.unionByName(more), order=("timecode_ms", "side", "block_seq"), **rest)


def edit_metadata(spark: SparkSession, path: str, out: str, **edits: Callable[[DataFrame], DataFrame]) -> list[tuple]:
    """The file with edits applied to the named metadata frames."""
    m = open_media(spark, path)
    folder, name = _split_target(out)
    names = ("segments", "tracks", "chapters", "attachments", "tags", "simple_tags")
    frames = C.edit({n: getattr(m, n) for n in names}, **edits)
    return replace(m, **{n: _at(df, name) for n, df in frames.items()}, blocks=_at(m.blocks, name)).write(folder)


def edit_in_place(spark: SparkSession, path: str, **edits: Callable[[DataFrame], DataFrame]) -> None:
    """Metadata of a file overwritten where it is; raises if it doesn't fit."""
    m = open_media(spark, path)
    names = ("segments", "tracks", "chapters", "attachments", "tags", "simple_tags")
    frames = C.edit({n: getattr(m, n) for n in names}, **edits)
    rows = {n: [r.asDict() for r in df.collect()] for n, df in frames.items()}  # one file's metadata
    _edit_in_place(path, metadata_parts(rows["segments"][0], rows["tracks"], rows["chapters"], rows["attachments"], rows["tags"], rows["simple_tags"]))


def extract_attachment(spark: SparkSession, path: str, attachment_id: int, out: str) -> int:
    found = open_media(spark, path).attachments.where(F.col("id") == attachment_id).orderBy("att_index").limit(1).collect()
    if not found:
        raise ValueError(f"attachment {attachment_id} not found")
    system, where = resolve(out)
    with system.open_output_stream(where) as f:
        f.write(found[0]["data"] or b"")
    return found[0]["size"]


def _subtitle_track(m: Media, track_id: int, codecs: Sequence[str] | None) -> DataFrame:
    t = m.tracks.where(F.col("track_id") == track_id)
    if not C.subtitle_tracks(t).where("is_ass" if codecs else "is_subtitle").take(1):
        raise ValueError(f"track {track_id} is no such subtitle track")
    return t


def extract_subtitle(spark: SparkSession, path: str, track_id: int, out: str) -> list[tuple[str, int]]:
    """An SRT file of a subtitle track."""
    m = open_media(spark, path)
    _subtitle_track(m, track_id, None)
    folder, name = _split_target(out)
    cues = U.extract_srt(B.subtitle_texts(m.blocks.where(F.col("track_number") == track_id)), FILE_CHUNK)
    return write_streams(folder, cues.select(F.lit(name).alias("file"), F.col("number").alias("seq"), F.col("cue").alias("data")))


def extract_ass(spark: SparkSession, path: str, track_id: int, out: str) -> list[tuple[str, int]]:
    """An ASS file of a subtitle track: its header, then the Dialogue lines."""
    m = open_media(spark, path)
    t = _subtitle_track(m, track_id, ["ass", "ssa"])
    folder, name = _split_target(out)
    head = t.select(F.lit(name).alias("file"), F.lit(-1).cast("bigint").alias("seq"), F.concat(trim_nulls(F.coalesce("codec_private", F.lit(b""))), F.lit("\n")).alias("data"))
    lines = U.extract_ass(B.ass_payloads(m.blocks.where(F.col("track_number") == track_id)))
    return write_streams(folder, head.unionByName(lines.select(F.lit(name).alias("file"), F.col("block_seq").alias("seq"), F.concat("line", F.lit("\n")).alias("data"))))


def _read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), "value")


def subtitle_kind(path: str, format: str | None = None) -> str:
    """srt or ass, as named or by the suffix of a path."""
    if format not in (None, "", "srt", "ass", "ssa"):
        raise ValueError(f"unknown format {format}; there are srt and ass")
    return "ass" if (format or path.lower()[-3:]) in ("ass", "ssa") else "srt"


def merge_subtitle(spark: SparkSession, path: str, subtitle: str, out: str, language: str = "und", name: str = "", format: str | None = None) -> list[tuple]:
    """The file with an SRT or ASS file as one more track, each event before the first block that reached its time.

    format is srt or ass; the file's suffix decides if None.
    """
    m = open_media(spark, path)
    folder, dst = _split_target(out)
    low = subtitle.lower()
    ass = subtitle_kind(subtitle, format) == "ass"
    text = _read_text(spark, subtitle)
    if ass:
        events = U.parse_ass(text).select(F.lit(path).alias("path"), "seq", "start_ms", U.ass_block_payload(F.col("seq") - 1, F.col("fields")).alias("data"))
        header = text.select(U.ass_header(F.col("value"))).first()[0]
    else:
        events = U.parse_srt(text).select(F.lit(path).alias("path"), "seq", "start_ms", F.col("text").alias("data"))
        header = None
    if not events.take(1):
        raise ValueError("the subtitle file has no events")
    new = (m.tracks.agg(F.max("track_id")).first()[0] or 0) + 1
    codec = "ssa" if low.endswith(".ssa") else "ass" if ass else "srt"
    row = {c: None for c in m.tracks.columns} | {"path": dst, "track_index": m.tracks.count(), "track_id": new, "type": "subtitle", "codec": codec, "language": language, "name": name, "is_default": True, "is_forced": False, "codec_private": header.encode() if header else None}
    track = spark.createDataFrame([tuple(row[c] for c in m.tracks.columns)], m.tracks.schema)
    placed = B.inject_subtitles(m.blocks, events, FILE_CHUNK).select(F.lit(dst).alias("path"), F.lit(new).alias("track_number"), F.col("start_ms").alias("timecode_ms"), F.lit(False).alias("keyframe"), F.col("data").cast("binary").alias("data"), F.coalesce("before_seq", F.lit(C.MAX_SEQ)).alias("block_seq"), F.lit(0).alias("side"), F.col("seq").cast("long").alias("sub"))
    own = _at(m.blocks, dst).select("path", "track_number", "timecode_ms", "keyframe", "data", "block_seq", F.lit(1).alias("side"), F.lit(0).cast("long").alias("sub"))
    rest = {n: _at(getattr(m, n), dst) for n in ("chapters", "attachments", "tags", "simple_tags")}
    return write_containers(folder, _at(m.segments, dst), _at(m.tracks, dst).unionByName(track), own.unionByName(placed), order=("block_seq", "side", "sub"), **rest)
