"""Codec names: long ids of the container format and their short names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids of the container format's registry, and the short names that results use for them.
CODEC_NAMES: dict[str, str] = {
    "V_MPEG4/ISO/AVC": "h264",
    "V_MPEGH/ISO/HEVC": "hevc",
    "V_VP8": "vp8",
    "V_VP9": "vp9",
    "V_AV1": "av1",
    "V_MS/VFW/FOURCC": "vfw",
    "A_AAC": "aac",
    "A_AC3": "ac3",
    "A_EAC3": "eac3",
    "A_DTS": "dts",
    "A_FLAC": "flac",
    "A_VORBIS": "vorbis",
    "A_OPUS": "opus",
    "A_TRUEHD": "truehd",
    "A_PCM/INT/LIT": "pcm",
    "S_TEXT/UTF8": "srt",
    "S_TEXT/ASS": "ass",
    "S_TEXT/SSA": "ssa",
    "S_VOBSUB": "vobsub",
    "S_HDMV/PGS": "pgs",
    "S_DVBSUB": "dvbsub",
}


def _lookup(c: Column, pairs: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def codec_short_name(c: Column) -> Column:
    """Short name of a codec id; unknown ids, and null, pass through."""
    return _lookup(c, CODEC_NAMES)


def codec_id_from_short(c: Column) -> Column:
    """Codec id of a short name; unknown names, and null, pass through."""
    return _lookup(c, {v: k for k, v in CODEC_NAMES.items()})
