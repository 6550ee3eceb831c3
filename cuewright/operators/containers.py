"""Operators on whole containers: validation, comparison, patches, mux, merge, join, tracks added and removed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions.scalars import quoted
from cuewright.operators.blocks import backward_timecodes, blocks_of, counts_by_track, numbered, remapped
from cuewright.operators.ordered import CHUNK, carried

MAX_SEQ = 1 << 40


def _issue(severity: str, message: Column | str, check: str) -> list[Column]:
    return [F.lit(check).alias("check_id"), F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message")]


# --- validation ---------------------------------------------------------------------------------------------------


#: Files of up to this many bytes may well hold metadata only.
LEAST_FILE = 1024


def validate(segments: DataFrame, tracks: DataFrame, blocks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(path, check_id, severity, message): what is wrong with each container of segments.

    Null texts count as empty, a null scale or duration as 0. Blocks and
    tracks of other paths are not looked at. A file_bytes column of segments,
    if there is one, spares small files the note that they have no blocks.
    A path's tracks are few and are held together; its blocks are counted.
    """
    seg = segments.select("path", "timecode_scale", "duration", "duration_ms", "muxing_app", "writing_app", *(["file_bytes"] if "file_bytes" in segments.columns else []))
    blk = blocks.select("path", "block_seq", "track_number", "timecode_ms", "keyframe")
    entry = F.struct("track_index", "track_id", "type", "codec", "language", "width", "height", F.coalesce(F.length("codec_private"), F.lit(0)).alias("private"), "sample_rate")
    listed = tracks.groupBy("path").agg(F.sort_array(F.collect_list(entry)).alias("tracks"))
    per_track = blk.groupBy("path", "track_number").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("keyframe"), F.lit(False)).alias("key"))
    counted = per_track.groupBy("path").agg(F.sum("n").alias("n_blocks"), F.bool_or("key").alias("any_keyframe"), F.collect_list("track_number").alias("filled"))
    have = seg.join(listed, "path", "left").join(counted, "path", "left").withColumn("tracks", F.coalesce("tracks", F.array().cast(listed.schema["tracks"].dataType)))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    none = F.col("n_blocks").isNull()
    large = F.coalesce(F.col("file_bytes") > LEAST_FILE, F.lit(True)) if "file_bytes" in seg.columns else F.lit(True)
    checks = [
        ("V01", "error", "missing TimecodeScale", zero("timecode_scale")),
        ("V02", "warning", "no duration set", zero("duration") & zero("duration_ms")),
        ("V03", "warning", "missing MuxingApp", empty(F.col("muxing_app"))),
        ("V04", "warning", "missing WritingApp", empty(F.col("writing_app"))),
        ("V05", "error", "no tracks", F.size("tracks") == 0),
        ("V12", "warning", "no video track", ~F.exists("tracks", lambda t: F.coalesce(t.type == "video", F.lit(False)))),
        ("V16", "warning", "no blocks found (metadata-only file?)", none & large),
        ("V17", "warning", "no keyframes found", ~none & ~F.col("any_keyframe")),
    ]

    def of_track(t: Column, i: Column) -> Column:
        say = lambda text: F.concat(F.lit("track "), t.track_id.cast("string"), F.lit(text))
        video, audio = t.type == "video", t.type == "audio"
        again = F.exists(F.slice(F.col("tracks"), F.lit(1), i), lambda x: x.track_id == t.track_id)
        found = [
            ("V06", "error", F.concat(F.lit("duplicate track ID "), t.track_id.cast("string")), again),
            ("V07", "error", say(": no codec"), empty(t.codec)),
            ("V08", "warning", say(": video without dimensions"), video & (t.width.isNull() | t.height.isNull())),
            ("V09", "warning", say(": video without CodecPrivate"), video & (t.private == 0)),
            ("V10", "warning", say(": audio without sample rate"), audio & t.sample_rate.isNull()),
            ("V11", "warning", say(": no language set"), empty(t.language)),
            ("V18", "warning", F.concat(say(" ("), F.coalesce(t.type, F.lit("")), F.lit("): no blocks")), ~none & ~F.array_contains("filled", t.track_id)),
        ]
        return F.array(*[F.when(when, F.struct(*_issue(sev, msg, cid))) for cid, sev, msg, when in found])

    fired = F.concat(F.array(*[F.when(when, F.struct(*_issue(sev, msg, cid))) for cid, sev, msg, when in checks]), F.flatten(F.transform("tracks", of_track)))
    out = have.select("path", F.explode(F.filter(fired, lambda x: x.isNotNull())).alias("i")).select("path", "i.*")
    back = backward_timecodes(blk, chunk=chunk).join(seg.select("path"), "path", "left_semi")
    text = F.concat(F.lit("timecode went backwards: "), F.col("previous_ms").cast("string"), F.lit("ms → "), F.col("timecode_ms").cast("string"), F.lit("ms at block "), F.col("block_no").cast("string"))
    return out.unionByName(back.select("path", *_issue("warning", text, "V15")))


def tracks_without_blocks(tracks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Tracks that have no block in a container that has some."""
    counts = counts_by_track(blocks)
    some = counts.select("path").distinct()
    missing = tracks.join(counts.select("path", F.col("track_number").alias("track_id")), ["path", "track_id"], "left_anti")
    return missing.join(some, "path", "left_semi")


def issue_text(severity: Column, message: Column) -> Column:
    return F.concat(F.lit("["), severity, F.lit("] "), message)


def probe_json(segments: DataFrame, tracks: DataFrame, chapters: DataFrame, attachments: DataFrame | None = None, tags: DataFrame | None = None, simple_tags: DataFrame | None = None, cues: DataFrame | None = None) -> DataFrame:
    """(path, json): the metadata of each container of segments as one JSON text; what is null is left out.

    Trees are told by node and parent_node. A path's metadata is held together,
    attachments without their data.
    """
    parts = {
        "tracks": (tracks, ["track_index", "track_id", "type", "codec", "language", "name", "is_default", "is_forced", "width", "height", "channels", "sample_rate", "bit_depth", "track_uid"]),
        "chapters": (chapters, ["node", "parent_node", "depth", "ordinal", "id", "title", "start_ms", "end_ms"]),
        "attachments": (attachments, ["att_index", "id", "name", "mime_type", "size"]),
        "tags": (tags, ["tag_index", "target_type", "target_id"]),
        "simple_tags": (simple_tags, ["tag_index", "node", "parent_node", "depth", "name", "value", "language"]),
        "cues": (cues, ["cue_index", "time_raw", "time_ms", "track", "cluster_pos"]),
    }
    out = segments.select("path", *[c for c in ("title", "muxing_app", "writing_app", "duration_ms", "timecode_scale") if c in segments.columns])
    for name, (df, columns) in parts.items():
        if df is not None:
            out = out.join(df.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name)), "path", "left")
    return out.select("path", F.to_json(F.struct(*out.columns), {"pretty": "true"}).alias("json"))


# --- comparison ---------------------------------------------------------------------------------------------------


def _diff(kind: Column | str, section: Column, detail: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), section.alias("section"), detail.alias("detail"))


def _arrow(a: Column, b: Column) -> Column:
    return F.concat(F.coalesce(a.cast("string"), F.lit("")), F.lit(" → "), F.coalesce(b.cast("string"), F.lit("")))


def compare_tracks(a: DataFrame, b: DataFrame, pair: Sequence[str] = ("pair",)) -> DataFrame:
    """pair + (type, section, detail): differences of two track lists by position.

    a and b: pair columns + (pos, type, codec, language, name, is_default, is_forced), pos from 1.
    """
    fields = ["type", "codec", "language", "name", "is_default", "is_forced"]
    named = lambda df, s: df.select(*pair, "pos", *[F.col(f).alias(f"{s}_{f}") for f in fields], F.lit(True).alias(s))
    both = named(a, "a").join(named(b, "b"), [*pair, "pos"], "full_outer")
    place = F.concat(F.lit("track["), F.col("pos").cast("string"), F.lit("]"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    summary = lambda s: F.concat(text(f"{s}_type"), F.lit(" "), text(f"{s}_codec"), F.lit(" lang="), text(f"{s}_language"), F.lit(" name="), quoted(F.col(f"{s}_name")))
    rows = [F.when(F.col("a").isNull(), _diff("added", place, summary("b"))), F.when(F.col("b").isNull(), _diff("removed", place, summary("a")))]
    here = F.col("a") & F.col("b")
    for f, label in (("type", "type"), ("codec", "codec"), ("language", "language"), ("name", "name")):
        x, y = text(f"a_{f}"), text(f"b_{f}")
        detail = F.concat(quoted(x), F.lit(" → "), quoted(y)) if f == "name" else _arrow(x, y)
        rows.append(F.when(here & (x != y), _diff("changed", F.concat(place, F.lit("." + label)), detail)))
    for f, label in (("is_default", "default"), ("is_forced", "forced")):
        x, y = F.coalesce(F.col(f"a_{f}"), F.lit(False)), F.coalesce(F.col(f"b_{f}"), F.lit(False))
        rows.append(F.when(here & (x != y), _diff("changed", F.concat(place, F.lit("." + label)), _arrow(x, y))))
    return both.select(*pair, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("d")).select(*pair, "d.*")


def compare_chapters(a: DataFrame, b: DataFrame, pair: Sequence[str] = ("pair",)) -> DataFrame:
    """Differences of two lists of top chapters by position: pair columns + (pos, title, start_ms, end_ms)."""
    count = lambda df, n: df.groupBy(*pair).agg(F.count(F.lit(1)).alias(n))
    sizes = count(a, "na").join(count(b, "nb"), list(pair), "full_outer").na.fill(0, ["na", "nb"]).where("na <> nb")
    out = sizes.select(*pair, _diff("changed", F.lit("chapters.count"), _arrow(F.col("na"), F.col("nb"))).alias("d"))
    named = lambda df, s: df.select(*pair, "pos", *[F.col(f).alias(f"{s}_{f}") for f in ("title", "start_ms", "end_ms")])
    both = named(a, "a").join(named(b, "b"), [*pair, "pos"])
    place = lambda x: F.concat(F.lit("chapter["), F.col("pos").cast("string"), F.lit("]." + x))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    ms = lambda c: F.coalesce(F.col(c), F.lit(0))
    span = lambda s: F.concat(ms(f"{s}_start_ms").cast("string"), F.lit("-"), ms(f"{s}_end_ms").cast("string"), F.lit("ms"))
    moved = (ms("a_start_ms") != ms("b_start_ms")) | (ms("a_end_ms") != ms("b_end_ms"))
    rows = [
        F.when(text("a_title") != text("b_title"), _diff("changed", place("title"), F.concat(quoted(text("a_title")), F.lit(" → "), quoted(text("b_title"))))),
        F.when(moved, _diff("changed", place("time"), _arrow(span("a"), span("b")))),
    ]
    more = both.select(*pair, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("d"))
    return out.unionByName(more).select(*pair, "d.*")


def compare_info(a: DataFrame, b: DataFrame, pair: Sequence[str] = ("pair",)) -> DataFrame:
    """Differences of title, apps and duration: pair columns + (title, muxing_app, writing_app, duration_ms)."""
    both = a.alias("a").join(b.alias("b"), list(pair))
    rows = []
    for f in ("title", "muxing_app", "writing_app"):
        x, y = F.coalesce(F.col(f"a.{f}"), F.lit("")), F.coalesce(F.col(f"b.{f}"), F.lit(""))
        rows.append(F.when(x != y, _diff("changed", F.lit(f"info.{f}"), F.concat(quoted(x), F.lit(" → "), quoted(y)))))
    x, y = F.coalesce(F.col("a.duration_ms"), F.lit(0)), F.coalesce(F.col("b.duration_ms"), F.lit(0))
    rows.append(F.when(x != y, _diff("changed", F.lit("duration"), F.concat(x.cast("string"), F.lit("ms → "), y.cast("string"), F.lit("ms")))))
    return both.select(*pair, F.explode(F.filter(F.array(*rows), lambda v: v.isNotNull())).alias("d")).select(*pair, "d.*")


def compare_counts(a: DataFrame, b: DataFrame, section: str, pair: Sequence[str] = ("pair",)) -> DataFrame:
    """A difference where two lists (attachments, tags) have different lengths."""
    count = lambda df, n: df.groupBy(*pair).agg(F.count(F.lit(1)).alias(n))
    sizes = count(a, "na").join(count(b, "nb"), list(pair), "full_outer").na.fill(0, ["na", "nb"]).where("na <> nb")
    return sizes.select(*pair, _diff("changed", F.lit(f"{section}.count"), _arrow(F.col("na"), F.col("nb"))).alias("d")).select(*pair, "d.*")


# --- edits --------------------------------------------------------------------------------------------------------


def edit(frames: dict[str, DataFrame], **edits: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """The named metadata frames with the given edits applied; a frame without one stays."""
    unknown = edits.keys() - frames.keys()
    if unknown:
        raise ValueError(f"no such frames: {', '.join(sorted(unknown))}")
    return {name: df.transform(edits[name]) if name in edits else df for name, df in frames.items()}


def set_title(segments: DataFrame, path: str, title: str) -> DataFrame:
    return segments.withColumn("title", F.when(F.col("path") == path, F.lit(title)).otherwise(F.col("title")))


def apply_patches(tracks: DataFrame, patches: DataFrame, version: str = "patched_at", tie: str = "patch_id") -> DataFrame:
    """tracks with the patches of (path, track_id) applied: of each column the latest value that is not null.

    A null in a patch keeps what was there; patches without a track change nothing.
    """
    cols = ["language", "name", "is_default", "is_forced"]
    order = F.struct(version, tie)
    last = patches.groupBy("path", "track_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_{c}") for c in cols])
    out = tracks.join(last, ["path", "track_id"], "left")
    return out.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in tracks.columns])


def remove_track(tracks: DataFrame, blocks: DataFrame, drop: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the tracks of drop (path, track_id): tracks renumbered 1..n in list order, and their blocks.

    Tracks gain old_id. Of a repeated id the first track's new number counts.
    """
    kept = tracks.join(drop, ["path", "track_id"], "left_anti")
    new = F.row_number().over(Window.partitionBy("path").orderBy("track_index")).cast("long")
    kept = kept.withColumn("old_id", F.col("track_id")).withColumn("track_id", new).select(*tracks.columns, "old_id")
    remap = kept.groupBy("path", "old_id").agg(F.min("track_id").alias("new_id"))
    return kept, remapped(blocks, remap)


def chapter_ranges(chapters: DataFrame) -> DataFrame:
    """(path, range_id, start_ms, end_ms) of the top chapters: own end, else the next start, else 0 (open).

    A path's chapters are few, so their window is small.
    """
    top = chapters.where("depth = 0")
    w = Window.partitionBy("path").orderBy("ordinal")
    end = F.coalesce(F.when(F.coalesce(F.col("end_ms"), F.lit(0)) != 0, F.col("end_ms")), F.lead("start_ms").over(w), F.lit(0))
    return top.select("path", F.row_number().over(w).alias("range_id"), F.coalesce("start_ms", F.lit(0)).alias("start_ms"), end.alias("end_ms"))


def part_name(pattern: str, number: Column) -> Column:
    return F.format_string(pattern, number)


# --- streams put together -----------------------------------------------------------------------------------------


def mux_tracks(inputs: DataFrame, tracks: DataFrame) -> DataFrame:
    """Tracks of the new containers: inputs (dst, ord, path, track_id, language, name, is_default) looked up and renumbered.

    The first track of an id counts. Language and name are taken over from
    inputs unless null or empty, is_default always (null: false). An input
    without a track raises when its row is read.
    """
    first = tracks.groupBy("path", "track_id").agg(F.min_by(F.struct("type", "codec", "language", "name"), "track_index").alias("t"))
    found = inputs.join(first, ["path", "track_id"], "left")
    ok = F.when(F.col("t").isNull(), F.raise_error(F.concat(F.lit("track "), F.col("track_id").cast("string"), F.lit(" not found in "), F.col("path")))).otherwise(F.col("t.type"))
    over = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(F.col(f"t.{c}")).alias(c)
    found = numbered(found, ["dst"], "ord", "new_id")
    return found.select("dst", "new_id", "ord", "path", F.col("track_id").alias("old_id"), ok.alias("type"), F.col("t.codec").alias("codec"), over("language"), over("name"), F.coalesce("is_default", F.lit(False)).alias("is_default"))


def mux_blocks(muxed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks of the new containers with the key that orders them: (timecode_ms, source_ord, block_seq).

    Of two inputs with one (path, track) the last counts. The order is a key,
    not a number, so that no container is sorted in one task; a writer sorts
    by ranges of it. Ties of a timecode go by the place of the source.
    """
    sources = muxed.groupBy("dst", "path").agg(F.min("ord").alias("source_ord"))
    last = muxed.groupBy("dst", "path", "old_id").agg(F.max("new_id").alias("new_id")).join(sources, ["dst", "path"])
    pairs = last.withColumnRenamed("old_id", "track_number")
    out = blocks.join(pairs, ["path", "track_number"])
    return out.select("dst", F.col("new_id").alias("track_number"), "timecode_ms", "source_ord", "block_seq", "path", "keyframe", *(["data"] if "data" in blocks.columns else []))


def join_layouts(sources: DataFrame, tracks: DataFrame) -> DataFrame:
    """Mismatches of the track layouts of sources (dst, ord, path) with the first of their dst; empty if they fit."""
    listed = _listed(tracks).select("path", "pos", "type")
    rows = sources.join(listed, "path").select("dst", "ord", "path", "pos", "type")
    first = sources.groupBy("dst").agg(F.min_by("path", "ord").alias("first"))
    want = first.join(listed, first["first"] == listed["path"]).select("dst", "pos", F.col("type").alias("want"))
    every = sources.join(want, "dst").select("dst", "path", "pos", "want")
    both = every.join(rows.select("dst", "path", "pos", "type"), ["dst", "path", "pos"], "full_outer")
    return both.where(~F.col("type").eqNullSafe(F.col("want")))


def _listed(tracks: DataFrame) -> DataFrame:
    return tracks.withColumn("pos", F.row_number().over(Window.partitionBy("path").orderBy("track_index")))


def join_offsets(sources: DataFrame, segments: DataFrame) -> DataFrame:
    """sources (dst, ord, path) + offset_ms: the durations of the sources before."""
    own = sources.join(segments.select("path", "duration_ms"), "path", "left").withColumn("duration_ms", F.coalesce("duration_ms", F.lit(0)))
    return carried(own, ["dst"], "ord", {"offset_ms": ("sum", F.col("duration_ms"))})


def join_totals(sources: DataFrame, segments: DataFrame) -> DataFrame:
    """(dst, total_ms, n_sources): the durations of the sources (dst, path) of each joined container; null ones count 0."""
    own = sources.join(segments.select("path", "duration_ms"), "path", "left")
    return own.groupBy("dst").agg(F.coalesce(F.sum("duration_ms"), F.lit(0)).cast("bigint").alias("total_ms"), F.count(F.lit(1)).alias("n_sources"))


def subtitle_tracks(tracks: DataFrame) -> DataFrame:
    """(path, track_id, is_subtitle, is_ass): whether a track's texts can be extracted, and as ASS."""
    text = F.coalesce(F.col("type") == "subtitle", F.lit(False))
    ass = text & F.coalesce(F.col("codec").isin("ass", "ssa"), F.lit(False))
    return tracks.groupBy("path", "track_id").agg(F.bool_or(text).alias("is_subtitle"), F.bool_or(ass).alias("is_ass"))


def join_blocks(sources: DataFrame, segments: DataFrame, tracks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks of sources one after another: tracks mapped by position to the first source's, times offset.

    Ordered by (source ord, block_seq). Layouts are assumed to fit, see join_layouts().
    """
    offsets = join_offsets(sources, segments)
    first = sources.groupBy("dst").agg(F.min_by("path", "ord").alias("first"))
    listed = _listed(tracks).select("path", "pos", "track_id")
    target = first.join(listed, first["first"] == listed["path"]).select("dst", "pos", F.col("track_id").alias("new_id"))
    own = sources.join(listed, "path").join(target, ["dst", "pos"]).groupBy("dst", "path", F.col("track_id").alias("track_number")).agg(F.max_by("new_id", "pos").alias("new_id"))
    pairs = own.join(offsets.select("dst", "ord", "path", "offset_ms"), ["dst", "path"])
    out = blocks.join(pairs, ["path", "track_number"])
    return out.select("dst", F.col("new_id").alias("track_number"), (F.col("timecode_ms") + F.col("offset_ms")).alias("timecode_ms"), F.col("ord").alias("source_ord"), "block_seq", "path", "keyframe", *(["data"] if "data" in blocks.columns else []))


def add_track(base: DataFrame, blocks: DataFrame, added: DataFrame, new_id: DataFrame) -> DataFrame:
    """blocks of base paths with one more track merged in by time.

    added: (path, block_seq, timecode_ms, keyframe) of the new track, path being
    the container it goes to; new_id: (path, new_id). The order key is
    (timecode_ms, side, block_seq), the container's own blocks first on ties.
    """
    own = blocks_of(blocks, base) if "track_id" in base.columns else blocks.join(base.select("path").distinct(), "path", "left_semi")
    mine = own.select("path", F.lit(0).alias("side"), "block_seq", "track_number", "timecode_ms", "keyframe")
    more = added.join(new_id, "path").select("path", F.lit(1).alias("side"), "block_seq", F.col("new_id").alias("track_number"), "timecode_ms", "keyframe")
    return mine.unionByName(more)
