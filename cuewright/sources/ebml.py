"""The container's binary format: element registry, decoding and encoding.

Elements are described by one table; decoding walks it, so that a new element
is a new line. All numbers are fixed values of the public format.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, BinaryIO

HEADER_ID, SEGMENT_ID, CLUSTER_ID, VOID_ID, SEEK_HEAD_ID = 0x1A45DFA3, 0x18538067, 0x1F43B675, 0xEC, 0x114D9B74
UNKNOWN = -1
MAX_ELEMENT = 512 << 20
MAX_BLOCK = 64 << 20
MAX_TAG_DEPTH = 64
DEFAULT_SCALE = 1_000_000

#: id: (name, kind); kinds: m(aster), u(nsigned), s(igned), f(loat), t(ext), b(inary).
ELEMENTS: dict[int, tuple[str, str]] = {
    HEADER_ID: ("header", "m"), 0x4286: ("ebml_version", "u"), 0x42F7: ("ebml_read_version", "u"), 0x42F2: ("max_id_length", "u"), 0x42F3: ("max_size_length", "u"),
    0x4282: ("doc_type", "t"), 0x4287: ("doc_type_version", "u"), 0x4285: ("doc_type_read_version", "u"),
    SEGMENT_ID: ("segment", "m"), SEEK_HEAD_ID: ("seek_head", "m"), 0x4DBB: ("seek", "m"), 0x53AB: ("seek_id", "b"), 0x53AC: ("seek_position", "u"),
    0x1549A966: ("info", "m"), 0x73A4: ("segment_uid", "b"), 0x3CB923: ("prev_uid", "b"), 0x3EB923: ("next_uid", "b"), 0x2AD7B1: ("timecode_scale", "u"), 0x4489: ("duration", "f"),
    0x4D80: ("muxing_app", "t"), 0x5741: ("writing_app", "t"), 0x4461: ("date_utc", "s"), 0x7BA9: ("title", "t"),
    0x1654AE6B: ("tracks", "m"), 0xAE: ("track", "m"), 0xD7: ("track_number", "u"), 0x73C5: ("track_uid", "u"), 0x83: ("track_type", "u"), 0x88: ("flag_default", "u"), 0x55AA: ("flag_forced", "u"),
    0x86: ("codec_id", "t"), 0x22B59C: ("language", "t"), 0x536E: ("name", "t"), 0x63A2: ("codec_private", "b"), 0x6D80: ("encodings", "m"), 0x6240: ("encoding", "m"), 0x5034: ("compression", "m"),
    0x4254: ("comp_algo", "u"), 0x4255: ("comp_settings", "b"), 0xE0: ("video", "m"), 0xB0: ("width", "u"), 0xBA: ("height", "u"), 0xE1: ("audio", "m"), 0xB5: ("sample_rate", "f"), 0x9F: ("channels", "u"), 0x6264: ("bit_depth", "u"),
    0x1043A770: ("chapters", "m"), 0x45B9: ("edition", "m"), 0xB6: ("chapter", "m"), 0x73C4: ("chapter_uid", "u"), 0x91: ("chapter_start", "u"), 0x92: ("chapter_end", "u"), 0x80: ("display", "m"), 0x85: ("chapter_string", "t"), 0x437C: ("chapter_language", "t"), 0x6E67: ("chapter_segment_uid", "b"),
    0x1941A469: ("attachments", "m"), 0x61A7: ("attachment", "m"), 0x466E: ("file_name", "t"), 0x4660: ("mime_type", "t"), 0x465C: ("file_data", "b"), 0x46AE: ("file_uid", "u"),
    0x1254C367: ("tags", "m"), 0x7373: ("tag", "m"), 0x63C0: ("targets", "m"), 0x63CA: ("target_type", "t"), 0x63C5: ("tag_track_uid", "u"), 0x67C8: ("simple_tag", "m"), 0x45A3: ("tag_name", "t"), 0x4487: ("tag_string", "t"), 0x447A: ("tag_language", "t"), 0x4485: ("tag_binary", "b"),
    0x1C53BB6B: ("cues", "m"), 0xBB: ("cue_point", "m"), 0xB3: ("cue_time", "u"), 0xB7: ("cue_positions", "m"), 0xF7: ("cue_track", "u"), 0xF1: ("cue_cluster", "u"),
    CLUSTER_ID: ("cluster", "m"), 0xE7: ("timestamp", "u"), 0xA3: ("simple_block", "b"), 0xA0: ("block_group", "m"), 0xA1: ("block", "b"), 0x9B: ("block_duration", "u"), 0xFB: ("reference_block", "s"), VOID_ID: ("void", "b"),
}
IDS: dict[str, int] = {name: i for i, (name, _) in ELEMENTS.items()}
#: Children of the segment; one of them ends a cluster of unknown size.
LEVEL_ONE = {IDS[n] for n in ("seek_head", "info", "tracks", "chapters", "attachments", "tags", "cues", "cluster")}
CLUSTER_CHILDREN = {IDS[n] for n in ("timestamp", "simple_block", "block_group")} | {0xA7, 0xAB, VOID_ID, 0xBF}
TRACK_TYPES = {1: "video", 2: "audio", 17: "subtitle"}
TYPE_CODES = {v: k for k, v in TRACK_TYPES.items()}


class FormatError(ValueError):
    """The bytes aren't what the format allows."""


# --- numbers ------------------------------------------------------------------------------------------------------


def vint_width(first: int) -> int:
    if not first:
        raise FormatError("a variable-length number can't begin with a zero byte")
    return 9 - first.bit_length()


#: The width of a number by its first byte; a zero byte has none.
_WIDTHS = [0, *(9 - first.bit_length() for first in range(1, 256))]


def read_vint(buf: bytes, at: int = 0, keep_marker: bool = False) -> tuple[int, int]:
    """(value, width) at a place; all value bits set is UNKNOWN unless the marker is kept."""
    if at >= len(buf):
        raise FormatError("no bytes left")
    width = _WIDTHS[buf[at]] or vint_width(0)
    if at + width > len(buf):
        raise FormatError("number cut short")
    value = int.from_bytes(buf[at : at + width], "big")
    if keep_marker:
        return value, width
    value &= (1 << (7 * width)) - 1
    return (UNKNOWN if value == (1 << (7 * width)) - 1 else value), width


def lax_vint(buf: bytes) -> tuple[int, int]:
    """Like read_vint for track numbers and lace sizes: nothing is (0, 0), a short or all-ones number is taken as it is."""
    if not buf:
        return 0, 0
    width = vint_width(buf[0]) if buf[0] else 8
    data = buf[:width].ljust(1, b"\0")
    mask = (1 << (7 * width)) - 1
    return int.from_bytes(data, "big") & mask, min(width, len(buf))


def size_width(size: int) -> int:
    return 8 if size < 0 else next((w for w in range(1, 9) if size <= (1 << (7 * w)) - 2), 8)


def id_bytes(element: int) -> bytes:
    return element.to_bytes((element.bit_length() + 7) // 8 or 1, "big")


def size_bytes(size: int, width: int | None = None) -> bytes:
    if size < 0:
        return b"\x01" + b"\xff" * 7
    w = width or size_width(size)
    return (size | 1 << (7 * w)).to_bytes(w, "big")


# --- encoding -----------------------------------------------------------------------------------------------------

#: Of each element its id's bytes and its kind; the bytes of sizes that take one.
_CODED = {name: (id_bytes(i), kind) for i, (name, kind) in ELEMENTS.items()}
_SHORT_SIZES = [size_bytes(n) for n in range(127)]


def encode(name: str, value: Any) -> bytes:
    """An element by name; a master's value is its encoded content, None gives nothing."""
    if value is None:
        return b""
    mark, kind = _CODED[name]
    if kind == "u":
        value = int(value)
        body = value.to_bytes((value.bit_length() + 7) // 8 or 1, "big")
    elif kind == "s":
        body = int(value).to_bytes(8, "big", signed=True)
    elif kind == "f":
        body = struct.pack(">d", value)
    elif kind == "t":
        body = value.encode("utf-8")
    else:
        body = bytes(value)
    n = len(body)
    return mark + (_SHORT_SIZES[n] if n < 127 else size_bytes(n)) + body


def void(total: int) -> bytes:
    """Padding of exactly total bytes; under two there is none."""
    if total < 2:
        return b""
    for w in range(1, 9):
        if total - 1 - w >= 0 and size_width(total - 1 - w) <= w:
            return b"\xec" + size_bytes(total - 1 - w, w) + bytes(total - 1 - w)
    return b""


# --- decoding -----------------------------------------------------------------------------------------------------


def decode_value(kind: str, body: bytes) -> Any:
    if kind in ("u", "s"):
        if len(body) > 8:
            raise FormatError("integer of more than eight bytes")
        return int.from_bytes(body, "big", signed=kind == "s" and bool(body))
    if kind == "f":
        if len(body) not in (4, 8):
            raise FormatError(f"float of {len(body)} bytes")
        return struct.unpack(">f" if len(body) == 4 else ">d", body)[0]
    if kind == "t":
        return body.rstrip(b"\0").decode("utf-8", "replace")
    return bytes(body)


@dataclass
class Node:
    """A decoded master element: values and children by name, in order."""

    values: dict[str, list[Any]] = field(default_factory=dict)

    def last(self, name: str, default: Any = None) -> Any:
        found = self.values.get(name)
        return found[-1] if found else default

    def all(self, name: str) -> list[Any]:
        return self.values.get(name, [])


def decode_master(body: bytes, depth: int = 0, tag_depth: int = 0) -> Node:
    """The known elements of a master's content; unknown ids are passed over by their size."""
    values: dict[str, list[Any]] = {}
    at, end = 0, len(body)
    while at < end:
        w = _WIDTHS[body[at]]
        if w and at + w < end and 0x80 <= body[at + w] < 0xFF:
            # A size of one byte, as most are.
            element, size = body[at : at + w], body[at + w] & 0x7F
            at += w + 1
        else:
            _, w = read_vint(body, at, keep_marker=True)
            size, v = read_vint(body, at + w)
            element = body[at : at + w]
            at += w + v
        if size == UNKNOWN:
            raise FormatError("element of unknown size inside a master")
        if at + size > end:
            raise FormatError("element goes past its parent")
        name, kind = _BY_BYTES.get(element, _NONE)
        if name:
            inner = body[at : at + size]
            if kind == "m":
                deeper = tag_depth + (name == "simple_tag")
                if deeper > MAX_TAG_DEPTH:
                    raise FormatError("tag nesting is too deep")
                value: Any = decode_master(inner, depth + 1, deeper)
            elif kind == "u" and size <= 8:
                value = int.from_bytes(inner, "big")
            else:
                value = decode_value(kind, inner)
            if name in values:
                values[name].append(value)
            else:
                values[name] = [value]
        at += size
    return Node(values)


_NONE = ("", "")
_BY_BYTES = {id_bytes(i): v for i, v in ELEMENTS.items()}


@dataclass(slots=True)
class Head:
    """An element's header in a file."""

    element: int
    offset: int
    header: int
    size: int

    @property
    def body(self) -> int:
        return self.offset + self.header

    @property
    def end(self) -> int:
        return self.body + self.size


def read_head(f: BinaryIO, at: int) -> Head | None:
    """The header at an offset; None at the end of the file."""
    f.seek(at)
    raw = f.read(16)
    if not raw:
        return None
    w = _WIDTHS[raw[0]]
    if w and w < len(raw) and 0x80 <= raw[w] < 0xFF:
        return Head(int.from_bytes(raw[:w], "big"), at, w + 1, raw[w] & 0x7F)
    element, w = read_vint(raw, 0, keep_marker=True)
    size, v = read_vint(raw, w)
    return Head(element, at, w + v, size)


def open_segment(f: BinaryIO) -> Head:
    """The segment's header, after a valid file header."""
    first = read_head(f, 0)
    if first is None or first.element != HEADER_ID or first.size == UNKNOWN:
        raise FormatError("not a container: it doesn't begin with the file header")
    at = first.end
    while (head := read_head(f, at)) is not None:
        if head.element == SEGMENT_ID:
            return head
        if head.size == UNKNOWN:
            break
        at = head.end
    raise FormatError("no segment")


def level_one(f: BinaryIO, segment: Head, length: int, at: int | None = None) -> Iterator[Head]:
    """Headers of the segment's children, from the one at an offset on; a cluster of unknown size ends where the next child begins."""
    at = segment.body if at is None else at
    end = length if segment.size == UNKNOWN else min(length, segment.end)
    while at < end:
        head = read_head(f, at)
        if head is None:
            return
        if head.size == UNKNOWN:
            if head.element != CLUSTER_ID:
                raise FormatError("only clusters may be of unknown size here")
            inner = head.body
            while inner < end:
                child = read_head(f, inner)
                if child is None or child.element in LEVEL_ONE:
                    break
                if child.size == UNKNOWN:
                    raise FormatError("element of unknown size inside a cluster")
                inner = child.end
            head = Head(head.element, head.offset, head.header, inner - head.body)
        yield head
        at = head.end


def children(f: BinaryIO, parent: Head) -> Iterator[Head]:
    """Headers of the elements in a master, whose bodies stay unread."""
    at = parent.body
    while at < parent.end:
        head = read_head(f, at)
        if head is None:
            raise FormatError("file cut short")
        if head.size == UNKNOWN or head.end > parent.end:
            raise FormatError("element goes past its parent")
        yield head
        at = head.end


def read_body(f: BinaryIO, head: Head, most: int = MAX_ELEMENT) -> bytes:
    if head.size > most:
        raise FormatError(f"element of {head.size} bytes is larger than {most}")
    f.seek(head.body)
    body = f.read(head.size)
    if len(body) < head.size:
        raise FormatError("file cut short")
    return body


# --- blocks -------------------------------------------------------------------------------------------------------


def lace_sizes(kind: int, count: int, data: bytes, standard: bool = False) -> tuple[list[int], int]:
    """(sizes of all frames, bytes of the size header); kind 1 Xiph, 2 fixed, 3 EBML.

    Size differences of EBML laces are held with a bias: half the range of
    their width or, as the published format has it (standard), one less.
    """
    if kind == 2:
        return [len(data) // count] * count, 0
    sizes: list[int] = []
    at = 0
    if kind == 1:
        for _ in range(count - 1):
            size = 0
            while True:
                if at >= len(data):
                    raise FormatError("lace sizes cut short")
                size += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    elif count > 1:
        size, w = lax_vint(data)
        at = w
        sizes.append(size)
        for _ in range(count - 2):
            raw, w = lax_vint(data[at:])
            if not w:
                raise FormatError("lace sizes cut short")
            at += w
            size += raw - (1 << (7 * w - 1)) + standard
            sizes.append(size)
    rest = len(data) - at - sum(sizes)
    if rest < 0 or any(s < 0 for s in sizes):
        raise FormatError("lace sizes don't fit the block")
    return [*sizes, rest], at


def encode_lace(kind: int, frames: list[bytes], standard: bool = False) -> bytes:
    """Frames of one block behind their sizes: count, size header, data; kind as in lace_sizes()."""
    if not 1 <= len(frames) <= 256:
        raise FormatError(f"a lace holds 1 to 256 frames, not {len(frames)}")
    sizes = [len(x) for x in frames]
    head = bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 2:
        if len(set(sizes)) > 1:
            raise FormatError("frames of a fixed lace must have one size")
    elif len(frames) > 1:
        head += size_bytes(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            # The least width whose biased range holds the difference.
            w = next(w for w in range(1, 9) if 0 <= b - a + (1 << (7 * w - 1)) - standard < (1 << (7 * w)) - 1)
            head += (b - a + (1 << (7 * w - 1)) - standard | 1 << (7 * w)).to_bytes(w, "big")
    return head + b"".join(frames)


def block_frames(body: bytes, simple: bool, standard: bool = False) -> tuple[int, int, bool, list[bytes]]:
    """(track, relative timecode, keyframe, frames); only a simple block tells of keyframes."""
    track, w = lax_vint(body)
    if len(body) < w + 3 or not w:
        raise FormatError("block cut short")
    rel = struct.unpack(">h", body[w : w + 2])[0]
    flags = body[w + 2]
    data = body[w + 3 :]
    kind = flags >> 1 & 3
    key = simple and bool(flags & 0x80)
    if not kind:
        return track, rel, key, [data]
    if not data:
        raise FormatError("laced block without frames")
    count = data[0] + 1
    data = data[1:]
    sizes, at = lace_sizes(kind, count, data, standard)
    frames = []
    for s in sizes:
        frames.append(data[at : at + s])
        at += s
    return track, rel, key, frames


def cluster_blocks(f: BinaryIO, cluster: Head, scale: int, standard: bool = False) -> Iterator[tuple[int, int, int, int, bool, bytes, int]]:
    """(offset, lace index, track, timecode ms, keyframe, data, cluster ticks) of a cluster's frames in order."""
    ticks, at = 0, cluster.body
    while at < cluster.end:
        head = read_head(f, at)
        if head is None:
            return
        if head.size == UNKNOWN or head.end > cluster.end:
            raise FormatError("element goes past its cluster")
        name = ELEMENTS.get(head.element, _NONE)[0]
        if name == "timestamp":
            ticks = decode_value("u", read_body(f, head))
        elif name in ("simple_block", "block_group"):
            body = read_body(f, head, MAX_BLOCK)
            if name == "block_group":
                body = decode_master(body).last("block")
                if body is None:
                    raise FormatError("block group without a block")
            track, rel, key, frames = block_frames(body, name == "simple_block", standard)
            ms = (ticks + rel) * scale
            ms = ms // 1_000_000 if ms >= 0 else -(-ms // 1_000_000)
            for i, data in enumerate(frames):
                yield head.offset, i, track, ms, key and i == 0, data, ticks
        at = head.end


_SHORT_BLOCK = struct.Struct(">BBBhB")


def encode_block(track: int, rel: int, keyframe: bool, data: bytes, lacing: int = 0, group: bool = False) -> bytes:
    """A simple block, or one in a block group; with lacing, data is what encode_lace() gave."""
    if not -32768 <= rel <= 32767:
        raise FormatError(f"relative timecode {rel} doesn't fit")
    if not group and not lacing and 0 <= track < 127 and len(data) < 123:
        # The sizes of track number and block take a byte each.
        return _SHORT_BLOCK.pack(0xA3, 0x84 + len(data), 0x80 | track, rel, 0x80 if keyframe else 0) + data
    body = size_bytes(track) + struct.pack(">h", rel) + bytes([(keyframe and not group) << 7 | lacing << 1]) + data
    return encode("block_group", encode("block", body)) if group else encode("simple_block", body)
