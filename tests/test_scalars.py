"""Expected values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from cuewright.functions import scalars as S
from cuewright.functions.codecs import CODEC_NAMES, codec_id_from_short, codec_short_name


def run(spark, f, values, kind):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


CASES = [
    (S.element_id_len, "long", {0x86: 1, 0xFF: 1, 0x4286: 2, 0x42F7: 2, 0x2B6661: 3, 0x1A45DFA3: 4, None: None}),
    (S.data_size_len, "long", {0: 1, 126: 1, 127: 2, 16382: 2, 16383: 3, 2097150: 3, 2097151: 4, 268435454: 4, 268435455: 5, -1: 8, -100: 8, None: None}),
    (S.uint_len, "long", {0: 1, 1: 1, 255: 1, 256: 2, 65535: 2, 65536: 3, -1: 8, 2**63 - 1: 8, None: None}),
    (S.vint_len, "long", {0: 1, 1: 1, 126: 1, 127: 2, 128: 2, 16382: 2, 16383: 3, -1: 8}),
    (S.signed_vint_len, "long", {0: 1, 1: 1, -1: 1, 63: 1, -64: 1, 64: 2, -65: 2, 8191: 2, -8192: 2, 8192: 3, None: None}),
    (S.parse_srt_time, "string", {"00:00:00,000": 0, "00:01:11,908": 71908, "01:30:00,000": 5400000, "99:59:59,999": 359999999, "00:00:01,5": 1005, "bad": None, "00:00:00": None, "": None, "00:00:01.000": None, None: None}),
    (S.srt_time, "long", {0: "00:00:00,000", 71908: "00:01:11,908", 5400000: "01:30:00,000", 9000061: "02:30:00,061", None: None}),
    (S.parse_ass_time, "string", {"0:00:00.00": 0, "0:01:11.90": 71900, "1:30:00.00": 5400000, "9:59:59.99": 35999990, "bad": None, "0:00:00": None, "": None}),
    (S.ass_time, "long", {0: "0:00:00.00", 71900: "0:01:11.90", 5400000: "1:30:00.00", 3723450: "1:02:03.45", None: None}),
    (S.clock_time, "long", {3723456: "01:02:03", None: None}),
    (S.is_digits_only, "string", {"123": True, "0": True, "": False, "12a": False, " ": False}),
    (S.sanitize_codec, "string", {"h264": "h264", "../../out": "____out", "V_MPEG4/ISO/AVC": "V_MPEG4_ISO_AVC", "": "raw", "back\\slash": "back_slash", None: None}),
    (S.safe_path, "string", {"1.h264": "1.h264", "sub/2.aac": "sub/2.aac", "./ok.h264": "ok.h264", "a/../b": "b", "../../../srv/key": None, "../../out": None, "/srv/key": None, "a/../../b": None, None: None}),
    (S.format_bytes, "long", {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1536: "1.5 KB", 16640: "16.2 KB", 1048576: "1.0 MB", 1 << 30: "1.0 GB", None: None}),
    (S.parse_track_ids, "string", {"1, 2,30": [1, 2, 30], "1,x": None, None: None}),
    (S.subtitle_format, "string", {"a.ASS": "ass", "b.ssa": "ass", "c.srt": "srt", "d": "srt", None: None}),
    (codec_id_from_short, "string", {"h264": "V_MPEG4/ISO/AVC", "opus": "A_OPUS", "srt": "S_TEXT/UTF8", "Z_NONE": "Z_NONE", None: None}),
    (codec_short_name, "string", {**CODEC_NAMES, "X_OTHER": "X_OTHER"}),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0].__name__)
def test_values(spark, case):
    f, kind, pairs = case
    assert run(spark, f, list(pairs), kind) == list(pairs.values())


def test_round_trips(spark):
    ms = [0, 8130457, 359999999]
    assert run(spark, lambda c: S.parse_srt_time(S.srt_time(c)), ms, "long") == ms
    assert run(spark, lambda c: S.parse_ass_time(S.ass_time(c)), [8130450], "long") == [8130450]


def test_rest(spark):
    one = spark.range(1)

    def get(c):
        return one.select(c.alias("x")).first()["x"]

    lit = F.lit
    assert get(S.timecode_ms(lit(1000), lit(1_000_000))) == 1000 and get(S.timecode_ms(lit(500), lit(0))) == 0
    assert get(S.timecode_ms(lit(2**63 - 1), lit(2))) is None and get(S.timecode_ms(lit(-(2**63)), lit(2))) is None and get(S.timecode_ms(lit(-1999), lit(500_000))) == -999
    assert get(S.duration_ms(lit(2.5), lit(1_000_000))) == 2 and get(S.duration_ms(lit(0.0), lit(1_000_000))) == 0
    assert bytes(get(S.encode_element_id(lit(0x2AD7B1)))) == bytes.fromhex("2ad7b1") and bytes(get(S.encode_data_size(lit(-1)))) == bytes.fromhex("01ffffffffffffff")
    assert bytes(get(S.encode_data_size(lit(127)))) == bytes.fromhex("407f") and bytes(get(S.encode_uint(lit(0)))) == b"\0"
    assert get(S.decode_uint(lit(b"\xff" * 8))) == 2**64 - 1 and get(S.decode_uint(lit(b""))) == 0 and get(S.decode_uint(lit(b"\1" * 9))) is None
    sizes = F.array(lit(300).cast("long"), lit(50).cast("long"))
    assert [get(S.lacing_header_len(lit(k), sizes)) for k in ("xiph", "fixed", "other")] == [2, 0, 0]
    assert get(S.lacing_header_len(lit("ebml"), F.array().cast("array<bigint>"))) == 0
    assert tuple(get(S.parse_srt_time_line(lit("00:10:07,250 --> 00:10:09,000")))) == (607250, 609000) and get(S.parse_srt_time_line(lit("a --> b --> c"))) is None
    assert [tuple(r) for r in get(S.parse_time_ranges(lit("0-100, 100-0")))] == [(0, 100), (100, 0)] and get(S.parse_time_ranges(lit("1-"))) is None
    assert tuple(get(S.source_spec(lit("s3://x/a.mkv:3")))) == ("s3://x/a.mkv", 3)
    assert get(S.quoted(lit('a"b\\c'))) == '"a\\"b\\\\c"' and get(S.progress_percent(lit(5), lit(0))) == -1 and get(S.progress_percent(lit(50), lit(40))) == 100
    assert get(S.trim_nulls(lit(b"ferry\0\0"))) == "ferry" and get(S.trim_nulls(lit(b"\0\0"))) == "" and get(S.default_subtitle_end(lit(5))) == 3005
    assert tuple(get(S.parse_dialogue(lit("Dialogue: 3,0:10:07.25,0:10:09.00,Low,Ann,0,0,0,,one, two, three")))) == (607250, 609000, "Low,Ann,0,0,0,,one, two, three")
    assert get(S.parse_dialogue(lit("Dialogue: 0,x,0:00:04.00,Low,,0,0,0,,one"))) is None and get(S.parse_dialogue(lit("Dialogue: 0,0:00:01.00"))) is None
