"""Writing container files, raw track streams and text files from DataFrames.

A file is written by one task in one pass: metadata, clusters as their blocks
come, the cue index at the end. Sizes are known before bytes are written, so
nothing is patched afterwards and any file system that can append will do.
Files get a temporary name and are moved when complete, so a task that is
tried again leaves nothing behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import lru_cache
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.functions.codecs import CODEC_NAMES
from cuewright.operators.blocks import CLUSTER_MS, CUE_INTERVAL_MS
from cuewright.sources import ebml as X
from cuewright.sources.container_source import Container, resolve

APP = "cuewright"
#: Bytes copied at a time where a file can't be changed in place.
COPY_BYTES = 8 << 20
#: Bytes of a new file that are gathered before they are written.
WRITE_BYTES = 64 << 10
_LONG_IDS = {v: k for k, v in CODEC_NAMES.items()}
Row = Mapping[str, Any]


# --- metadata -----------------------------------------------------------------------------------------------------


_kept = lru_cache(4096)(X.encode)


def _often(name: str, text: str | None) -> bytes:
    """Like encode(), for texts that come again and again, such as languages; short ones are kept."""
    return _kept(name, text) if text is None or len(text) <= 64 else X.encode(name, text)


@lru_cache
def file_header() -> bytes:
    body = b"".join(X.encode(n, v) for n, v in (("ebml_version", 1), ("ebml_read_version", 1), ("max_id_length", 4), ("max_size_length", 8), ("doc_type", "matroska"), ("doc_type_version", 4), ("doc_type_read_version", 2)))
    return X.encode("header", body)


def encode_info(info: Row, duration_ms: int | None = None) -> bytes:
    """duration_ms replaces the duration that info has, since most operators change it."""
    scale = info.get("timecode_scale") or X.DEFAULT_SCALE
    duration = duration_ms * 1e6 / scale if duration_ms else info.get("duration") or None
    fields = [("segment_uid", info.get("segment_uid")), ("prev_uid", info.get("prev_uid")), ("next_uid", info.get("next_uid")), ("timecode_scale", scale), ("duration", duration), ("date_utc", info.get("date_utc_ns")), ("title", info.get("title") or None), ("muxing_app", info.get("muxing_app") or APP), ("writing_app", info.get("writing_app") or APP)]
    return X.encode("info", b"".join(X.encode(n, v) for n, v in fields))


def _track(t: Row) -> bytes:
    kind = t.get("type") or ""
    number = int(t["track_id"])
    out = [X.encode("track_number", number), X.encode("track_uid", int(t.get("track_uid") or number)), X.encode("track_type", X.TYPE_CODES.get(kind, 0)), _often("codec_id", _LONG_IDS.get(t.get("codec") or "", t.get("codec") or "")), _often("language", t.get("language") or None), X.encode("name", t.get("name") or None)]
    if t.get("is_default") is False:
        out.append(X.encode("flag_default", 0))
    if t.get("is_forced"):
        out.append(X.encode("flag_forced", 1))
    out.append(X.encode("codec_private", t.get("codec_private") or None))
    if t.get("header_stripping"):
        comp = X.encode("comp_algo", 3) + X.encode("comp_settings", t["header_stripping"])
        out.append(X.encode("encodings", X.encode("encoding", X.encode("compression", comp))))
    if kind == "video":
        out.append(X.encode("video", X.encode("width", t.get("width")) + X.encode("height", t.get("height"))))
    if kind == "audio":
        out.append(X.encode("audio", X.encode("sample_rate", t.get("sample_rate")) + X.encode("channels", t.get("channels")) + X.encode("bit_depth", t.get("bit_depth"))))
    return X.encode("track", b"".join(out))


def encode_tracks(tracks: Iterable[Row]) -> bytes:
    body = b"".join(_track(t) for t in sorted(tracks, key=lambda t: t["track_index"]))
    return X.encode("tracks", body) if body else b""


def encode_chapters(chapters: Iterable[Row]) -> bytes:
    """Chapters with their sub-chapters, in one edition."""
    rows = sorted(chapters, key=lambda c: (c.get("depth", 0), c.get("ordinal", 0)))
    below: dict[int, list[Row]] = {}
    for c in rows:
        below.setdefault(c.get("parent_node", -1), []).append(c)

    # From the deepest rows up, so that any depth will do: a node's children are encoded before it.
    done: dict[int, bytes] = {}
    order, stack = [], list(below.get(-1, []))
    while stack:
        c = stack.pop()
        order.append(c)
        stack += below.get(c["node"], [])
    for c in reversed(order):
        out = [X.encode("chapter_uid", int(c.get("id") or 0) or c["node"] + 1), X.encode("chapter_start", (c.get("start_ms") or 0) * 1_000_000)]
        if (c.get("end_ms") or 0) > 0:
            out.append(X.encode("chapter_end", c["end_ms"] * 1_000_000))
        if c.get("title"):
            out.append(X.encode("display", X.encode("chapter_string", c["title"]) + _often("chapter_language", "und")))
        out.append(X.encode("chapter_segment_uid", c.get("segment_uid")))
        done[c["node"]] = X.encode("chapter", b"".join(out + [done.pop(x["node"]) for x in below.get(c["node"], [])]))
    body = b"".join(done[c["node"]] for c in below.get(-1, []))
    return X.encode("chapters", X.encode("edition", body)) if body else b""


def encode_attachments(attachments: Iterable[Row]) -> bytes:
    body = b"".join(
        X.encode("attachment", b"".join(X.encode(n, v) for n, v in (("file_name", a.get("name") or None), ("mime_type", a.get("mime_type") or None), ("file_uid", int(a["id"]) if a.get("id") else None), ("file_data", a.get("data") or None))))
        for a in sorted(attachments, key=lambda a: a["att_index"])
    )
    return X.encode("attachments", body) if body else b""


def encode_tags(tags: Iterable[Row], simple_tags: Iterable[Row]) -> bytes:
    below: dict[tuple[int, int], list[Row]] = {}
    for s in sorted(simple_tags, key=lambda s: s["node"]):
        below.setdefault((s["tag_index"], s.get("parent_node", -1)), []).append(s)

    def simple(s: Row) -> bytes:
        fields = [_often("tag_name", s.get("name") or None), X.encode("tag_string", s.get("value") or None), _often("tag_language", s.get("language") or None), X.encode("tag_binary", s.get("data") or None)]
        return X.encode("simple_tag", b"".join([*fields, *[simple(x) for x in below.get((s["tag_index"], s["node"]), [])]]))

    out = b""
    for t in sorted(tags, key=lambda t: t["tag_index"]):
        target = _often("target_type", t.get("target_type") or None) + X.encode("tag_track_uid", int(t["target_id"]) if t.get("target_id") else None)
        out += X.encode("tag", X.encode("targets", target) + b"".join(simple(s) for s in below.get((t["tag_index"], -1), [])))
    return X.encode("tags", out) if out else b""


def metadata_parts(info: Row, tracks: Iterable[Row] = (), chapters: Iterable[Row] = (), attachments: Iterable[Row] = (), tags: Iterable[Row] = (), simple_tags: Iterable[Row] = (), duration_ms: int | None = None) -> list[bytes]:
    parts = [encode_info(info, duration_ms), encode_tracks(tracks), encode_chapters(chapters), encode_attachments(attachments), encode_tags(tags, simple_tags)]
    return [p for p in parts if p]


def seek_head(parts: Sequence[bytes], after: int = 0) -> bytes:
    """An index of the parts that follow it directly; its own size and the places depend on each other."""

    def build(offset: int) -> bytes:
        body, at = b"", offset + after
        for p in parts:
            element, w = X.read_vint(p, 0, keep_marker=True)
            body += X.encode("seek", X.encode("seek_id", p[:w]) + X.encode("seek_position", at))
            at += len(p)
        return X.encode("seek_head", body)

    size = 0
    for _ in range(8):
        made = build(size)
        if len(made) == size:
            return made
        size = len(made)
    return build(size) + X.void(0)


class ContainerWriter:
    """Streams one container: start(), block() in order, finish()."""

    def __init__(self, out: Any, scale: int = X.DEFAULT_SCALE) -> None:
        self.out, self.scale = out, scale or X.DEFAULT_SCALE
        self.cluster: list[tuple[int, int, bool, bytes]] = []
        self.start_ms = 0
        self.until = (0, 0)
        self.cues: list[tuple[int, int, int]] = []
        self.written = self.body_at = self.n_blocks = 0

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def start(self, parts: Sequence[bytes]) -> None:
        self._write(file_header())
        self._write(X.id_bytes(X.SEGMENT_ID) + X.size_bytes(X.UNKNOWN))
        self.body_at = self.written
        self._write(seek_head(parts))
        for p in parts:
            self._write(p)

    def ticks(self, ms: int) -> int:
        return ms * 1_000_000 // self.scale

    def block(self, track: int, ms: int, keyframe: bool, data: bytes) -> None:
        self.blocks([(track, ms, keyframe, data)])

    def blocks(self, rows: Iterable[tuple[int, int, bool, bytes]]) -> None:
        """Many blocks (track, ms, keyframe, data), in order."""
        cluster, (least, end) = self.cluster, self.until
        for row in rows:
            ms = row[1]
            if not least <= ms < end or not cluster:
                self._flush()
                self.start_ms, cluster = ms, self.cluster
                # The times whose ticks lie at most 2^15 from the cluster's; ticks are rounded down.
                first = self.ticks(ms)
                least, end = (-(-self.scale * (first + x) // 1_000_000) for x in (-32768, 32768))
                end = min(end, ms + CLUSTER_MS)
                self.until = (least, end)
            cluster.append(row)
            self.n_blocks += 1

    def _flush(self) -> None:
        if not self.cluster:
            return
        base = self.ticks(max(0, self.start_ms))
        entry = next(((ms, t) for t, ms, key, _ in self.cluster if key), None)
        if entry is None and (not self.cues or self.cluster[0][1] - self.cues[-1][0] >= CUE_INTERVAL_MS):
            entry = (self.cluster[0][1], self.cluster[0][0])
        if entry is not None:
            self.cues.append((entry[0], entry[1], self.written - self.body_at))
        scale, encode = self.scale, X.encode_block
        body = X.encode("timestamp", base) + b"".join([encode(t, ms * 1_000_000 // scale - base, key, data) for t, ms, key, data in self.cluster])
        self._write(X.encode("cluster", body))
        self.cluster = []

    def finish(self) -> int:
        self._flush()
        points = b"".join(X.encode("cue_point", X.encode("cue_time", self.ticks(max(0, ms))) + X.encode("cue_positions", X.encode("cue_track", t) + X.encode("cue_cluster", at))) for ms, t, at in self.cues)
        if points:
            self._write(X.encode("cues", points))
        return self.written


# --- sinks --------------------------------------------------------------------------------------------------------


class _Target:
    """A file under a folder, written beside its name and moved there when complete."""

    def __init__(self, folder: str, name: str, made: set[str] | None = None) -> None:
        """made: folders known to be there, to which this file's is added."""
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"{name} leaves the folder")
        self.fs, where = resolve(folder)
        self.path = f"{where.rstrip('/')}/{name}"
        parent = self.path.rsplit("/", 1)[0]
        if made is None or parent not in made:
            self.fs.create_dir(parent, recursive=True)
        if made is not None:
            made.add(parent)
        self.temp = f"{parent}/._{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp, buffer_size=WRITE_BYTES)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)

    def abandon(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temp)


def file_name(path: str) -> str:
    """Where a container goes below the output folder."""
    return path.split("://", 1)[-1].lstrip("/")


def _packed(df: DataFrame | None, columns: Sequence[str], name: str) -> DataFrame | None:
    if df is None:
        return None
    have = [c for c in columns if c in df.columns]
    return df.groupBy("path").agg(F.collect_list(F.struct(*have)).alias(name))


def _plain(a: pa.Array) -> list[Any]:
    """What to_pylist() gives, with structs taken apart by column, which is several times as fast."""
    if pa.types.is_list(a.type):
        items = _plain(a.flatten())
        ends = pc.fill_null(pc.list_value_length(a), 0).to_numpy().cumsum().tolist()
        return [items[start:end] if there else None for start, end, there in zip([0, *ends], ends, a.is_valid().to_pylist())]
    if pa.types.is_struct(a.type) and not a.null_count:
        names = [f.name for f in a.type]
        return [dict(zip(names, values)) for values in zip(*[_plain(c) for c in a.flatten()])]
    if pa.types.is_string(a.type) or pa.types.is_binary(a.type) or (not a.null_count and (pa.types.is_integer(a.type) or pa.types.is_boolean(a.type))):
        return a.to_numpy(zero_copy_only=False).tolist()
    return a.to_pylist()


def write_containers(folder: str, segments: DataFrame, tracks: DataFrame, blocks: DataFrame | None = None, chapters: DataFrame | None = None, attachments: DataFrame | None = None, tags: DataFrame | None = None, simple_tags: DataFrame | None = None, compat_duration: bool = True, order: Sequence[str] = ("block_seq",), repeated: bool = False) -> list[tuple[str, str, int, int]]:
    """Writes one file for each path of segments; returns (path, file, n_blocks, n_bytes) of each.

    Blocks are written in the order of the order columns (numbers) in clusters
    of a second. compat_duration keeps the duration of segments;
    otherwise it is that of the blocks. Where blocks may be repeated, equal
    rows are written once, for which they need no exchange of their own. The
    metadata of one path is held together in memory; its blocks aren't.
    """
    columns = {
        "tracks": ["track_index", "track_id", "type", "codec", "language", "name", "is_default", "is_forced", "codec_private", "header_stripping", "width", "height", "channels", "sample_rate", "bit_depth", "track_uid"],
        "chapters": ["node", "parent_node", "depth", "ordinal", "id", "title", "start_ms", "end_ms", "segment_uid"],
        "attachments": ["att_index", "id", "name", "mime_type", "data"],
        "tags": ["tag_index", "target_type", "target_id"],
        "simple_tags": ["tag_index", "node", "parent_node", "name", "value", "data", "language"],
    }
    given = {"tracks": tracks, "chapters": chapters, "attachments": attachments, "tags": tags, "simple_tags": simple_tags}
    meta = segments.select("path", *[c for c in ("title", "muxing_app", "writing_app", "duration", "duration_ms", "timecode_scale", "date_utc_ns", "segment_uid", "prev_uid", "next_uid") if c in segments.columns])
    for name, df in given.items():
        packed = _packed(df, columns[name], name)
        meta = meta.join(packed, "path", "left") if packed is not None else meta
    if not compat_duration and blocks is not None:
        meta = meta.join(blocks.groupBy("path").agg(F.max("timecode_ms").alias("computed_ms")), "path", "left")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [dict(zip(batch.schema.names, values)) for values in zip(*[_plain(c) for c in batch.columns])]
            parts = [metadata_parts(r, *[r.get(n) or [] for n in columns], duration_ms=r.get("computed_ms")) for r in rows]
            data = [len(p).to_bytes(1, "big") + b"".join(len(x).to_bytes(8, "big") for x in p) + b"".join(p) for p in parts]
            scale = [r.get("timecode_scale") or X.DEFAULT_SCALE for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0] * len(rows), pa.int64()), pa.array(scale, pa.int64()), pa.array([False] * len(rows)), pa.array(data, pa.binary())], ["path", "track_number", "timecode_ms", "keyframe", "data"])

    stream = meta.mapInArrow(heads, "path string, track_number bigint, timecode_ms bigint, keyframe boolean, data binary").withColumn("head", F.lit(True))
    places = [f"o{i}" for i in range(len(order))]
    stream = stream.select("*", *[F.lit(0).cast("bigint").alias(o) for o in places])
    if blocks is not None:
        own = blocks.select("path", F.col("track_number").cast("bigint").alias("track_number"), F.col("timecode_ms").cast("bigint").alias("timecode_ms"), "keyframe", "data", F.lit(False).alias("head"), *[F.col(c).cast("bigint").alias(o) for c, o in zip(order, places)])
        stream = stream.unionByName(own)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        made: set[str] = set()
        path, target, writer, last = None, None, None, None

        def end() -> None:
            n = writer.finish()
            target.close()
            done.append((path, target.path, writer.n_blocks, n))

        try:
            for batch in batches:
                paths, tracks, times, keys, data, *numbers = [_plain(c) for c in (*batch.columns[:5], *batch.columns[6:])]
                heads = batch.column(5).to_numpy(zero_copy_only=False).nonzero()[0].tolist()
                for start, stop in zip([-1, *heads], [*heads, len(paths)]):
                    if start >= 0:
                        if writer is not None:
                            end()
                        path, last = paths[start], None
                        target = _Target(folder, file_name(path), made)
                        writer = ContainerWriter(target.out, times[start])
                        packed = data[start]
                        at, parts = 1 + 8 * packed[0], []
                        for i in range(packed[0]):
                            size = int.from_bytes(packed[1 + 8 * i : 9 + 8 * i], "big")
                            parts.append(packed[at : at + size])
                            at += size
                        writer.start(parts)
                    start += 1
                    if writer is None or start == stop:
                        continue
                    if paths[stop - 1] != path:
                        # Blocks of paths that segments don't have.
                        stop = next(i for i in range(start, stop) if paths[i] != path)
                    rows = list(zip(*[c[start:stop] for c in (tracks, times, keys, data, *(numbers if repeated else ()))]))
                    if repeated and rows:
                        before, last = [last, *rows], rows[-1]
                        rows = [r for r, x in zip(rows, before) if r != x]
                    writer.blocks([(r[0], r[1], bool(r[2]), r[3] or b"") for r in rows])
            if writer is not None:
                end()
                target = writer = None
        except BaseException:
            if target is not None:
                target.abandon()
            raise
        cols = list(zip(*done)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["path", "file", "n_blocks", "n_bytes"])

    written = stream.repartition("path").sortWithinPartitions("path", F.col("head").desc(), *places, *(["track_number", "timecode_ms", "keyframe", "data"] if repeated else [])).mapInArrow(write, "path string, file string, n_blocks bigint, n_bytes bigint")
    return [tuple(r) for r in written.collect()]


def write_streams(folder: str, rows: DataFrame) -> list[tuple[str, int]]:
    """rows (file, seq, data): the data of each file name joined in order, one file each; returns (file, n_bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        name, target, n = None, None, 0
        try:
            for batch in batches:
                for f, _, data in zip(*[c.to_pylist() for c in batch.columns]):
                    if f != name:
                        if target is not None:
                            target.close()
                            done.append((target.path, n))
                        name, target, n = f, _Target(folder, f), 0
                    target.out.write(data or b"")
                    n += len(data or b"")
            if target is not None:
                target.close()
                done.append((target.path, n))
                target = None
        except BaseException:
            if target is not None:
                target.abandon()
            raise
        cols = list(zip(*done)) or [()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64()))], ["file", "n_bytes"])

    spread = rows.select("file", "seq", F.col("data").cast("binary").alias("data")).repartition("file").sortWithinPartitions("file", "seq")
    return [tuple(r) for r in spread.mapInArrow(write, "file string, n_bytes bigint").collect()]


def edit_in_place(path: str, parts: Sequence[bytes]) -> None:
    """Overwrites the metadata before the first cluster, padding what is left over.

    The seek head is left alone unless it lies inside the region. Raises if the
    new metadata doesn't fit, or leaves a gap of one byte that can't be padded.
    """
    region = Container(path).metadata_region()
    if region is None:
        raise X.FormatError("no metadata before the first cluster")
    start, end = region
    body = b"".join(parts)
    gap = end - start - len(body)
    if gap < 0 or gap == 1:
        raise X.FormatError(f"{len(body)} bytes of metadata don't fit a region of {end - start}")
    system, where = resolve(path)
    made = body + X.void(gap)
    if isinstance(system, pafs.LocalFileSystem):
        with open(where, "r+b") as f:
            f.seek(start)
            f.write(made)
        return
    # Elsewhere files can't be changed in part: the file is written beside itself and moved.
    beside = f"{where}._{uuid.uuid4().hex}"
    with system.open_input_file(where) as old, system.open_output_stream(beside) as new:
        for begin, stop in ((0, start), (end, old.size())):
            old.seek(begin)
            while begin < stop:
                piece = old.read(min(COPY_BYTES, stop - begin))
                if not piece:
                    raise X.FormatError("file cut short")
                new.write(piece)
                begin += len(piece)
            if stop == start:
                new.write(made)
    system.move(beside, where)
