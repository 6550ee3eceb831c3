"""Container files as DataFrames: a Python data source.

    spark.dataSource.register(ContainerSource)
    spark.read.format("container").option("table", "blocks").load("/media")

Options: table (see schemas.TABLES), payload (false leaves data columns null
and attachment bytes unread), mode (PERMISSIVE skips a
broken file or its rest, FAILFAST raises), laces (standard or compat: the bias
of size differences, see ebml.lace_sizes), startMs and endMs (blocks of that
time only; clusters that can't hold any are passed over unread), splitBytes (how much of a file is read
in one piece when blocks are read). A task takes many small files or pieces, up to DEFAULT_SPLIT
bytes; minBytes passes over smaller files. Files are read through pyarrow's file
systems, so any URI that those know will do; other file systems are registered
with register_filesystem(), and contents held in a column are read by
decode_containers().

Metadata is looked up before the first cluster and by the seek head; the
clusters are walked over only for what neither has. A split of a file finds
its first cluster by the cue index, or where that isn't listed by the
cluster's own mark, so what it reads doesn't grow with its place in the file.
"""

from __future__ import annotations

import fnmatch
import io
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from cuewright.functions.codecs import CODEC_NAMES
from cuewright.runtime import col, require, ship
from cuewright.schemas import TABLES
from cuewright.sources import ebml as X

BATCH_ROWS, BATCH_BYTES = 4096, 16 << 20
DEFAULT_SPLIT = 128 << 20
#: Files that share a task at most: as many as make TASKS tasks of all files, between these bounds.
LEAST_FILES, MOST_FILES, TASKS = 512, 4096, 64
#: Bytes read at once in the search for a cluster's mark, and elements after it that must be in order.
SEARCH_BYTES, SEARCH_CHAIN = 1 << 20, 4

#: Files of so many bytes are read at once instead of element by element.
SMALL_FILE = 256 << 10

_LOCAL = pafs.LocalFileSystem()
_FILESYSTEMS: dict[str, Callable[[], pafs.FileSystem]] = {}


def register_filesystem(scheme: str, make: Callable[[], pafs.FileSystem]) -> None:
    """Paths 'scheme://...' go to the file system that make() gives, called where it is needed.

    Register it in a module that workers import too; what is registered on the
    driver alone is known there alone.
    """
    _FILESYSTEMS[scheme] = make


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    scheme, mark, rest = path.partition("://")
    if mark and scheme in _FILESYSTEMS:
        return _FILESYSTEMS[scheme](), rest
    return pafs.FileSystem.from_uri(path) if "://" in path else (_LOCAL, path)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at a path, below a folder, or matching a pattern of the last path part."""
    head, _, last = path.rpartition("/")
    pattern = last if any(c in last for c in "*?[") else None
    system, where = resolve(head if pattern else path)
    prefix = path[: len(path) - len(path.split("://", 1)[1])] if "://" in path else ""
    info = system.get_file_info(where)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [(i.path, i.size) for i in system.get_file_info(pafs.FileSelector(where, recursive=True)) if i.type == pafs.FileType.File and not i.base_name.startswith(("_", "."))]
    return [(prefix + p, size) for p, size in sorted(found) if pattern is None or fnmatch.fnmatch(p.rsplit("/", 1)[-1], pattern)]


def uid(v: int | None) -> Decimal | None:
    return None if v is None else Decimal(v)


class Container:
    """One open file: the headers of its parts, and each relation's rows."""

    def __init__(self, path: str, standard_laces: bool = False, f: BinaryIO | None = None) -> None:
        self.path, self.standard_laces = path, standard_laces
        if f is None:
            system, where = resolve(path)
            f = system.open_input_file(where)
            if f.size() <= SMALL_FILE:
                with f:
                    f = io.BytesIO(f.read())
        self.f = f
        self.length = f.seek(0, 2)
        self.segment = X.open_segment(self.f)
        self.heads_read = 0
        self._front: list[X.Head] | None = None

    def parts(self, at: int | None = None) -> Iterator[X.Head]:
        """Headers of the segment's children, from one of them on."""
        for head in X.level_one(self.f, self.segment, self.length, at):
            self.heads_read += 1
            yield head

    def front(self) -> list[X.Head]:
        """Children up to and with the first cluster."""
        if self._front is None:
            out = []
            for head in self.parts():
                out.append(head)
                if head.element == X.CLUSTER_ID:
                    break
            self._front = out
        return self._front

    def seeks(self) -> list[tuple[int, int]]:
        """(element id, offset in the file) of the entries of the seek head."""
        out = []
        for head in self.front():
            if head.element == X.SEEK_HEAD_ID:
                for entry in X.decode_master(X.read_body(self.f, head)).all("seek"):
                    raw = entry.last("seek_id", b"")
                    if raw:
                        out.append((int.from_bytes(raw, "big"), self.segment.body + entry.last("seek_position", 0)))
        return out

    def find(self, *names: str) -> list[X.Head]:
        """Headers of the named parts in file order: those before the clusters, then those the seek head lists, else any."""
        wanted = {X.IDS[n] for n in names}
        front = self.front()
        found = {h.offset: h for h in front if h.element in wanted}
        clusters = bool(front) and front[-1].element == X.CLUSTER_ID
        if clusters:
            for element, at in self.seeks():
                if element in wanted and at not in found and at < self.length:
                    head = X.read_head(self.f, at)
                    if head is not None and head.element == element and head.size != X.UNKNOWN:
                        found[at] = head
            if not found:
                found = {h.offset: h for h in self.parts(front[-1].offset) if h.element in wanted}
        return [found[at] for at in sorted(found)]

    def masters(self, *names: str) -> Iterator[X.Node]:
        for head in self.find(*names):
            yield X.decode_master(X.read_body(self.f, head))

    def scale(self) -> int:
        found = [n.last("timecode_scale", X.DEFAULT_SCALE) for n in self.masters("info")]
        return found[-1] if found else 0

    def segments(self) -> Iterator[tuple]:
        info = X.Node()
        scale = 0
        for n in self.masters("info"):
            info.values |= n.values
            scale = n.last("timecode_scale", X.DEFAULT_SCALE)
        duration = info.last("duration")
        ms = int(duration * scale / 1e6) if duration and duration > 0 and scale > 0 else 0
        yield (self.path, info.last("title", ""), info.last("muxing_app", ""), info.last("writing_app", ""), duration or 0.0, scale, info.last("date_utc"), info.last("segment_uid"), info.last("prev_uid"), info.last("next_uid"), ms)

    def tracks(self) -> Iterator[tuple]:
        entries = [t for n in self.masters("tracks") for t in n.all("track")]
        for i, t in enumerate(entries):
            video, audio = t.last("video", X.Node()), t.last("audio", X.Node())
            strip = None
            for enc in t.all("encodings"):
                for e in enc.all("encoding"):
                    for c in e.all("compression"):
                        strip = c.last("comp_settings", strip)
            codec = t.last("codec_id", "")
            yield (
                self.path, i, t.last("track_number", 0), X.TRACK_TYPES.get(t.last("track_type"), ""), CODEC_NAMES.get(codec, codec), t.last("language", "eng"), t.last("name", ""), t.last("flag_default", 1) == 1, t.last("flag_forced", 0) == 1,
                t.last("codec_private"), strip, video.last("width"), video.last("height"), audio.last("channels"), audio.last("sample_rate"), audio.last("bit_depth"), uid(t.last("track_uid")),
            )

    def chapters(self) -> Iterator[tuple]:
        node = 0
        roots = [c for n in self.masters("chapters") for e in n.all("edition") for c in e.all("chapter")]
        stack = [(c, -1, 0, i) for i, c in reversed(list(enumerate(roots)))]
        while stack:
            c, parent, depth, ordinal = stack.pop()
            title = next((d.last("chapter_string") for d in reversed(c.all("display")) if d.last("chapter_string") is not None), "")
            yield (self.path, node, parent, depth, ordinal, uid(c.last("chapter_uid")), title, c.last("chapter_start", 0) // 1_000_000, c.last("chapter_end", 0) // 1_000_000, c.last("chapter_segment_uid"))
            stack += [(x, node, depth + 1, i) for i, x in reversed(list(enumerate(c.all("chapter"))))]
            node += 1

    def attachments(self, payload: bool = True) -> Iterator[tuple]:
        i = 0
        for part in self.find("attachments"):
            for head in X.children(self.f, part):
                if head.element != X.IDS["attachment"]:
                    continue
                a, size = X.Node(), 0
                for x in X.children(self.f, head):
                    name, kind = X.ELEMENTS.get(x.element, ("", ""))
                    if name == "file_data":
                        size = x.size
                    if name and kind != "m" and (payload or name != "file_data"):
                        a.values.setdefault(name, []).append(X.decode_value(kind, X.read_body(self.f, x)))
                yield (self.path, i, uid(a.last("file_uid")), a.last("file_name", ""), a.last("mime_type", ""), size, a.last("file_data", b"") if payload else None)
                i += 1

    def _tags(self) -> list[X.Node]:
        return [t for n in self.masters("tags") for t in n.all("tag")]

    def tags(self) -> Iterator[tuple]:
        for i, t in enumerate(self._tags()):
            target = t.last("targets", X.Node())
            yield (self.path, i, target.last("target_type", ""), uid(target.last("tag_track_uid")))

    def simple_tags(self) -> Iterator[tuple]:
        for i, t in enumerate(self._tags()):
            node = 0
            stack = [(s, -1, 0) for s in reversed(t.all("simple_tag"))]
            while stack:
                s, parent, depth = stack.pop()
                yield (self.path, i, node, parent, depth, s.last("tag_name", ""), s.last("tag_string", ""), s.last("tag_binary"), s.last("tag_language", ""))
                stack += [(x, node, depth + 1) for x in reversed(s.all("simple_tag"))]
                node += 1

    def cues(self) -> Iterator[tuple]:
        scale = self.scale()
        points = [p for n in self.masters("cues") for p in n.all("cue_point")]
        for i, p in enumerate(points):
            where = p.last("cue_positions", X.Node())
            raw = p.last("cue_time", 0)
            yield (self.path, i, raw, raw * scale // 1_000_000, where.last("cue_track", 0), where.last("cue_cluster", 0))

    def _cluster_ticks(self, head: X.Head) -> int | None:
        """A cluster's time, where it is the first of its elements, as it should be."""
        first = X.read_head(self.f, head.body)
        if first is None or first.element != X.IDS["timestamp"]:
            return None
        return X.decode_value("u", X.read_body(self.f, first))

    def _is_cluster(self, at: int, chain: int = SEARCH_CHAIN) -> bool:
        """Whether a cluster begins at an offset, judged by the elements in and after it."""
        try:
            while chain > 0 and at < self.length:
                head = X.read_head(self.f, at)
                if head is None or head.element not in X.LEVEL_ONE | {X.VOID_ID}:
                    return False
                if head.element == X.CLUSTER_ID:
                    first = X.read_head(self.f, head.body)
                    if first is None or first.element not in X.CLUSTER_CHILDREN or first.size == X.UNKNOWN or (head.size != X.UNKNOWN and first.end > head.end):
                        return False
                if head.size == X.UNKNOWN:
                    return head.element == X.CLUSTER_ID
                at, chain = head.end, chain - 1
        except X.FormatError:
            return False
        # The last part of a file that was cut short may reach past its end.
        return True

    def first_cluster(self, start: int) -> int | None:
        """The offset from which the segment's children can be walked to reach the first cluster at or after start."""
        front = self.front()
        if not front or front[-1].element != X.CLUSTER_ID:
            return None
        if front[-1].offset >= start:
            return front[-1].offset
        cues = [at for element, at in self.seeks() if element == X.IDS["cues"]]
        if cues:
            scale_free = [self.segment.body + w.last("cue_cluster", 0) for n in self.masters("cues") for p in n.all("cue_point") for w in p.all("cue_positions")]
            before = [at for at in scale_free if front[-1].offset <= at <= start and self._is_cluster(at, 1)]
            if before:
                return max(before)
        mark, at = X.id_bytes(X.CLUSTER_ID), start
        while at < self.length:
            self.f.seek(at)
            window = self.f.read(SEARCH_BYTES + len(mark) - 1)
            place = window.find(mark)
            while place >= 0:
                if self._is_cluster(at + place):
                    return at + place
                place = window.find(mark, place + 1)
            at += SEARCH_BYTES
        return None

    def blocks(self, start: int = 0, end: int | None = None, payload: bool = True, start_ms: int | None = None, end_ms: int | None = None) -> Iterator[tuple]:
        """Frames of the clusters that begin in [start, end) of the file and of [start_ms, end_ms).

        block_seq is the byte offset, plus the place in a lace.
        """
        at = self.first_cluster(start)
        if at is None or (end is not None and at >= end):
            return
        scale = self.scale()
        for head in self.parts(at):
            if head.element != X.CLUSTER_ID or head.offset < start:
                continue
            if end is not None and head.offset >= end:
                return
            if start_ms is not None or end_ms is not None:
                ticks = self._cluster_ticks(head)
                # A block lies at most 2^15 ticks from its cluster's time.
                if ticks is not None and ((start_ms is not None and (ticks + 32768) * scale // 1_000_000 < start_ms) or (end_ms is not None and (ticks - 32768) * scale // 1_000_000 >= end_ms)):
                    continue
            for offset, lace, track, ms, key, data, ticks in X.cluster_blocks(self.f, head, scale, self.standard_laces):
                if (start_ms is not None and ms < start_ms) or (end_ms is not None and ms >= end_ms):
                    continue
                yield (self.path, offset + lace, lace, head.offset - self.segment.body, ticks, track, ms, key, data if payload else None, len(data))

    def elements(self) -> Iterator[tuple]:
        seg = self.segment
        yield (self.path, seg.offset, 0, seg.element, "segment", seg.header, seg.size)
        for h in self.parts():
            yield (self.path, h.offset, 1, h.element, X.ELEMENTS.get(h.element, ("", ""))[0], h.header, h.size)

    def seek_entries(self) -> Iterator[tuple]:
        for i, (element, at) in enumerate(self.seeks()):
            head = X.read_head(self.f, at) if at < self.length else None
            yield (self.path, i, X.ELEMENTS.get(element, ("", ""))[0], at - self.segment.body, head is not None and head.element == element)

    def metadata_region(self) -> tuple[int, int] | None:
        """Bytes [start, end) that hold metadata before the first cluster, for an edit in place."""
        names = {"info", "tracks", "chapters", "attachments", "tags", "void"}
        span = None
        for h in self.front():
            if h.element == X.CLUSTER_ID:
                break
            if X.ELEMENTS.get(h.element, ("", ""))[0] in names:
                span = (h.offset if span is None else span[0], h.end)
        return span


class _Part(InputPartition):
    """Pieces (path, start, end) of files that one task reads."""

    def __init__(self, pieces: list[tuple[str, int, int | None]]) -> None:
        self.pieces = pieces


class ContainerReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema = schema
        self.table = options.get("table", "segments")
        self.path = options.get("path", "")
        self.payload = options.get("payload", "true").lower() == "true"
        self.laces = options.get("laces", "compat").lower() == "standard"
        self.failfast = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        low = {k.lower(): v for k, v in options.items()}
        self.start_ms, self.end_ms = (int(low[k]) if k in low else None for k in ("startms", "endms"))
        self.least = int(low.get("minbytes", 0))
        self.split = int(options.get("splitbytes", options.get("splitBytes", DEFAULT_SPLIT)))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        pieces: list[tuple[str, int, int | None]] = []
        held = 0
        files = [(path, size) for path, size in list_files(self.path) if size >= self.least]
        # What opening a file counts as beside its bytes.
        open_cost = DEFAULT_SPLIT // min(max(len(files) // TASKS, LEAST_FILES), MOST_FILES)
        for path, size in files:
            starts = list(range(0, max(1, size), self.split)) if self.table == "blocks" else [0]
            for start, end in zip(starts, [*starts[1:], None]):
                weight = (size if end is None else end) - start + open_cost
                if pieces and held + weight > DEFAULT_SPLIT + open_cost:
                    out.append(_Part(pieces))
                    pieces, held = [], 0
                pieces.append((path, start, end))
                held += weight
        return [*out, _Part(pieces)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        rows_of = lambda path, start, end: lambda: relation(Container(path, self.laces), self.table, start, end, self.payload, self.start_ms, self.end_ms)
        yield from _batches(to_arrow_schema(self.schema), ((p[0], rows_of(*p)) for p in part.pieces), self.table, self.failfast)  # type: ignore[attr-defined]


def relation(c: Container, table: str, start: int = 0, end: int | None = None, payload: bool = True, start_ms: int | None = None, end_ms: int | None = None) -> Iterator[tuple]:
    """Rows of one table of an open container."""
    if table == "blocks":
        yield from c.blocks(start, end, payload, start_ms, end_ms)
    elif table == "attachments":
        yield from c.attachments(payload)
    elif table == "errors":
        for name in ("segments", "tracks", "chapters", "attachments", "tags", "simple_tags", "cues"):
            for _ in relation(c, name, payload=False):
                pass
        n = 0
        try:
            for _ in c.blocks(payload=False):
                n += 1
        except (X.FormatError, OSError) as e:
            yield (c.path, "clusters" if n == 0 and c.first_cluster(0) is None else "blocks", n, str(e))
    elif table == "files":
        yield (c.path, c.length)
    elif table == "seeks":
        yield from c.seek_entries()
    else:
        yield from getattr(c, table)()


def _batches(schema: pa.Schema, files: Iterable[tuple[str, Callable[[], Iterator[tuple]]]], table: str, failfast: bool) -> Iterator[pa.RecordBatch]:
    """Rows of files in batches of bounded size; of a broken file what could be read, unless failfast."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows: list[tuple] = []
    held = 0
    heavy = [i for i, f in enumerate(schema) if pa.types.is_binary(f.type)]
    for path, rows_of in files:
        try:
            for row in rows_of():
                rows.append(row)
                for i in heavy:
                    held += len(row[i] or b"")
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
        except (X.FormatError, OSError) as e:
            if table == "errors":
                rows.append((path, "file", 0, str(e)))
            elif failfast:
                raise ValueError(f"{path}: {e}") from e
    if rows:
        yield batch(rows)


def decode_containers(files: DataFrame, table: str, path: str = "path", content: str = "content", payload: bool = True, standard_laces: bool = False, failfast: bool = False) -> DataFrame:
    """A relation of containers whose bytes stand in a column, as Spark's binaryFile format gives them.

    Null contents give no rows; broken ones what can be read of them, or an
    error with failfast. Extra columns are ignored.
    """
    if table not in TABLES:
        raise ValueError(f"no such table: {table}; there are {', '.join(TABLES)}")
    require(files, path, content)
    schema = arrow_schema(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield from _batches(schema, ((p, lambda p=p, data=data: relation(Container(p, standard_laces, io.BytesIO(data)), table, payload=payload)) for p, data in given if data is not None), table, failfast)

    return files.select(col(path).cast("string").alias("path"), col(content).cast("binary").alias("content")).mapInArrow(run, TABLES[table])


class ContainerSource(DataSource):
    """Format 'container'."""

    @classmethod
    def name(cls) -> str:
        return "container"

    def schema(self) -> str:
        table = self.options.get("table", "segments")
        if table not in TABLES:
            raise ValueError(f"no such table: {table}; there are {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema: StructType) -> ContainerReader:
        return ContainerReader(schema, dict(self.options))


def read_container(spark: Any, path: str, table: str, **options: Any):
    """A relation of the container files at a path."""
    ship(spark)
    spark.dataSource.register(ContainerSource)
    reader = spark.read.format("container").option("table", table)
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else v)
    return reader.load(path)


def arrow_schema(table: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(TABLES[table]))
