"""Scalar functions of the container and subtitle formats as Column expressions.

They stay in the JVM and inside code generation; null in gives null out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MS_MINUTE, MS_HOUR = 60_000, 3_600_000
DEFAULT_SUBTITLE_MS = 3000


def _least_width(value: Column, limits: list[Column | int], last: int) -> Column:
    """1-based place of the first limit that value doesn't exceed."""
    out = F.when(value <= F.lit(limits[0]), 1)
    for i, limit in enumerate(limits[1:], 2):
        out = out.when(value <= F.lit(limit), i)
    return F.when(value.isNull(), None).otherwise(out.otherwise(last)).cast("int")


def element_id_len(c: Column) -> Column:
    return F.when(c >= 0x10000000, 4).when(c >= 0x200000, 3).when(c >= 0x4000, 2).when(c.isNotNull(), 1).cast("int")


def data_size_len(c: Column) -> Column:
    """Bytes of a size field; a negative (unknown) size takes eight."""
    return F.when(c < 0, 8).otherwise(_least_width(c, [(1 << (7 * w)) - 2 for w in range(1, 8)], 8)).cast("int")


def uint_len(c: Column) -> Column:
    """Bytes of an unsigned integer held as two's complement (negative: the upper half of the range)."""
    return F.when(c < 0, 8).otherwise(_least_width(c, [(1 << (8 * w)) - 1 for w in range(1, 8)], 8)).cast("int")


def element_header_len(element_id: Column, size: Column) -> Column:
    return (element_id_len(element_id) + data_size_len(size)).cast("int")


def vint_len(c: Column) -> Column:
    """Bytes of a variable-length number in a lacing header."""
    return F.when(c < 0, 8).otherwise(_least_width(c, [(1 << (7 * w)) - 2 for w in range(1, 8)], 8)).cast("int")


def signed_vint_len(c: Column) -> Column:
    out = F.when((c >= -(1 << 6)) & (c < 1 << 6), 1)
    for w in range(2, 8):
        half = 1 << (7 * w - 1)
        out = out.when((c >= -half) & (c < half), w)
    return F.when(c.isNotNull(), out.otherwise(8)).cast("int")


def lacing_header_len(kind: Column, sizes: Column) -> Column:
    """Bytes of the frame sizes in a lacing header: xiph, fixed or ebml; other kinds, and no frames, have none."""
    firsts = F.when(F.size(sizes) > 0, F.slice(sizes, 1, F.greatest(F.size(sizes) - 1, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    xiph = F.aggregate(firsts, F.lit(0).cast("bigint"), lambda acc, x: acc + F.floor(x / 255).cast("bigint") + 1)
    deltas = F.transform(firsts, lambda x, i: F.when(i == 0, vint_len(x)).otherwise(signed_vint_len(x - F.element_at(firsts, i.cast("int")))).cast("bigint"))
    ebml = F.aggregate(deltas, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return F.when(kind == "xiph", xiph).when(kind == "ebml", ebml).otherwise(F.lit(0)).cast("bigint")


def encode_uint(c: Column) -> Column:
    """Big-endian bytes of least width."""
    return F.unhex(F.lpad(F.hex(c), uint_len(c) * 2, "0"))


def hex_uint(c: Column) -> Column:
    """Hex digits of least width, two at least; those of a decimal(38,0) may be more than 64 bits hold, of a negative one there are none."""
    piece = F.lit(1 << 60)
    upper = lambda n: ((n - n % piece) / piece).cast("decimal(38,0)")
    lower = lambda n: F.lpad(F.hex((n % piece).cast("bigint")), 15, "0")
    digits = F.when(F.typeof(c) == "bigint", F.hex(c.try_cast("bigint"))).when(c >= 0, F.concat(lower(upper(upper(c))), lower(upper(c)), lower(c)))
    short = F.regexp_replace(F.lower(digits), "^0+(?=.)", "")
    return F.when(F.length(short) == 1, F.concat(F.lit("0"), short)).otherwise(short)


def encode_element_id(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c), element_id_len(c) * 2, "0"))


def encode_data_size(c: Column) -> Column:
    """Size field with its width marker; negative is the unknown size."""
    width = data_size_len(c)
    marker = F.element_at(F.array(*[F.lit(1 << (7 * w)).cast("bigint") for w in range(1, 9)]), width)
    return F.when(c < 0, F.unhex(F.lit("01FFFFFFFFFFFFFF"))).otherwise(F.unhex(F.lpad(F.hex(c.cast("bigint") + marker), width * 2, "0")))


def decode_uint(c: Column) -> Column:
    """Unsigned big-endian integer as decimal(20,0); no bytes are 0, more than eight null."""
    digits = F.conv(F.when(F.length(c) == 0, "0").otherwise(F.hex(c)), 16, 10)
    return F.when(F.length(c) <= 8, digits.cast("decimal(20,0)"))


def timecode_ms(value: Column, scale: Column) -> Column:
    """Ticks to milliseconds, truncated toward zero; null where the product overflows."""
    return F.try_divide(F.try_multiply(value.cast("bigint"), scale.cast("bigint")).cast("decimal(20,0)"), F.lit(1_000_000).cast("decimal(20,0)")).cast("bigint")


def duration_ms(duration: Column, scale: Column) -> Column:
    """Duration in ticks to whole milliseconds; 0 unless both are positive."""
    return F.when((duration > 0) & (scale > 0), (duration * scale / 1e6).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def date_from_ns(ns: Column) -> Column:
    """Nanoseconds since 2001-01-01 to a timestamp."""
    return F.timestamp_micros(F.lit(978_307_200_000_000) + F.floor(ns / 1000).cast("bigint"))


def ns_from_date(ts: Column) -> Column:
    """Whole seconds of a timestamp, as nanoseconds since 2001-01-01."""
    return (F.unix_seconds(ts) - F.lit(978_307_200)) * F.lit(1_000_000_000)


def _quotient(n: Column, by: int, more: Column | int = 0) -> Column:
    """Digits of n / by, cut to a whole number, + more; n is a bigint or decimal(38,0). Never a double, which is wrong from 2^53 on."""
    narrow = F.call_function("div", n.try_cast("bigint"), F.lit(by).cast("bigint")) + more
    wide = ((n - n % by) / F.lit(by)).cast("decimal(38,0)") + more
    return F.when(F.typeof(n) == "bigint", narrow.cast("string")).otherwise(wide.cast("decimal(38,0)").cast("string"))


def _hours(ms: Column, width: int) -> Column:
    whole = _quotient(ms, MS_HOUR)
    return F.when(F.length(whole) < width, F.lpad(whole, width, "0")).otherwise(whole)


def _part(ms: Column, unit: int, wrap: int) -> Column:
    return F.call_function("div", (ms % (unit * wrap)).cast("bigint"), F.lit(unit).cast("bigint"))


def srt_time(ms: Column) -> Column:
    return _time("%s:%02d:%02d,%03d", ms, _hours(ms, 2), _part(ms, MS_MINUTE, 60), _part(ms, 1000, 60), _part(ms, 1, 1000))


def ass_time(ms: Column) -> Column:
    """Centiseconds, truncated."""
    return _time("%s:%02d:%02d.%02d", ms, _hours(ms, 1), _part(ms, MS_MINUTE, 60), _part(ms, 1000, 60), _part(ms, 10, 100))


def clock_time(ms: Column) -> Column:
    return _time("%s:%02d:%02d", ms, _hours(ms, 2), _part(ms, MS_MINUTE, 60), _part(ms, 1000, 60))


def _time(form: str, ms: Column, *parts: Column) -> Column:
    return F.when(ms.isNotNull(), F.format_string(form, *parts))


def _once(value: Column, then) -> Column:
    """then(value), with value evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _parse_time(s: Column, separator: str, last_unit: int) -> Column:
    pattern = rf"^\s*([+-]?\d{{1,13}}):([+-]?\d{{1,9}}):([+-]?\d{{1,9}}){separator}([+-]?\d{{1,9}})"
    part = lambda p, i: F.get(p, F.lit(i)).try_cast("bigint")
    total = lambda *terms: reduce(F.try_add, [F.try_multiply(n, F.lit(unit).cast("bigint")) for n, unit in terms])
    return _once(F.split(F.trim(F.regexp_extract(s, pattern, 0)), "[:,.]"), lambda p: total((part(p, 0), MS_HOUR), (part(p, 1), MS_MINUTE), (part(p, 2), 1000), (part(p, 3), last_unit)))


def parse_srt_time(s: Column) -> Column:
    """hh:mm:ss,ms to milliseconds; the last part is a plain number, what follows it is ignored; null if malformed or beyond 64 bits."""
    return _parse_time(s, "[,:]", 1)


def parse_ass_time(s: Column) -> Column:
    """h:mm:ss.cc to milliseconds; null if malformed or beyond 64 bits."""
    return _parse_time(s, "[.:]", 10)


def parse_srt_time_line(s: Column) -> Column:
    """struct(start_ms, end_ms) of a line with exactly one arrow and two times, else null."""
    times = lambda p: F.struct(parse_srt_time(F.trim(F.get(p, F.lit(0)))).alias("start_ms"), parse_srt_time(F.trim(F.get(p, F.lit(1)))).alias("end_ms"))
    whole = lambda t: F.when(t.start_ms.isNotNull() & t.end_ms.isNotNull(), t)
    return _once(F.split(s, "-->"), lambda p: F.when(F.size(p) == 2, _once(times(p), whole)))


def is_digits_only(s: Column) -> Column:
    return s.rlike(r"^[0-9]+\z")


def parse_dialogue(line: Column) -> Column:
    """struct(start_ms, end_ms, fields) of a Dialogue line; null with under ten parts or a malformed time."""
    read = lambda p: F.struct(parse_ass_time(F.trim(F.get(p, F.lit(1)))).alias("start_ms"), parse_ass_time(F.trim(F.get(p, F.lit(2)))).alias("end_ms"), F.array_join(F.slice(p, 4, 7), ",").alias("fields"))
    whole = lambda t: F.when(t.start_ms.isNotNull() & t.end_ms.isNotNull(), t)
    parts = F.when(line.startswith("Dialogue:"), F.split(F.regexp_replace(line, r"^Dialogue:\s*", ""), ",", 10))
    return _once(parts, lambda p: F.when(F.size(p) == 10, _once(read(p), whole)))


def trim_nulls(data: Column) -> Column:
    """Text of a payload without trailing zero bytes."""
    return F.regexp_replace(data.cast("string"), r"\x00+\z", "")


def safe_path(name: Column) -> Column:
    """The relative name with '.' and inner '..' resolved; null for absolute names and those that leave the folder."""
    parts = F.filter(F.split(name, "/"), lambda p: (p != "") & (p != "."))
    # Fold: a '..' takes the folder before it away, or marks an escape.
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    clean = F.when(F.size(folded) == 0, ".").otherwise(F.array_join(folded, "/"))
    return F.when(~name.startswith("/") & ~clean.startswith(".."), clean)


def sanitize_codec(c: Column) -> Column:
    """A codec as part of a file name."""
    out = reduce(lambda acc, bad: F.replace(acc, F.lit(bad), F.lit("_")), ["/", "\\", ".."], c)
    return F.when(out == "", "raw").otherwise(out)


def format_bytes(b: Column) -> Column:
    """A size with one decimal; of a decimal(38,0) exactly, of a bigint what a double holds of it, as printf has it."""
    held = F.when(F.typeof(b) == "bigint", F.coalesce(b.cast("double").try_cast("bigint"), b)).otherwise(b)

    def shown(unit: int, name: str) -> Column:
        # In whole numbers, since a double's shortest digits may look like a tie that it isn't. Ties go to the even digit.
        div = lambda n, by: F.call_function("div", n, F.lit(by).cast("bigint"))
        rest = (held % unit).cast("bigint") * 10
        tenth, over = div(rest, unit), rest % unit * 2
        up = F.when((over > unit) | ((over == unit) & (tenth % 2 == 1)), 1).otherwise(0)
        tenths = tenth + up
        return F.concat(_quotient(held, unit, div(tenths, 10)), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {name}"))

    g, m, k = 1 << 30, 1 << 20, 1 << 10
    return F.when(b >= g, shown(g, "GB")).when(b >= m, shown(m, "MB")).when(b >= k, shown(k, "KB")).when(b.isNotNull(), F.concat(b.cast("string"), F.lit(" B")))


def parse_track_ids(s: Column) -> Column:
    """Numbers of a comma-separated list; null where one is none."""
    ids = F.transform(F.split(s, ","), lambda x: F.trim(x).try_cast("bigint"))
    return F.when(~F.exists(ids, lambda x: x.isNull()), ids)


def parse_time_ranges(s: Column) -> Column:
    """array<struct<start_ms,end_ms>> of 'a-b,c-d'; null where a part is malformed."""
    ranges = F.transform(F.split(s, ","), lambda x: F.struct(F.regexp_extract(F.trim(x), r"^(\d+)-(\d+)$", 1).try_cast("bigint").alias("start_ms"), F.regexp_extract(F.trim(x), r"^(\d+)-(\d+)$", 2).try_cast("bigint").alias("end_ms")))
    return F.when(~F.exists(ranges, lambda r: r.start_ms.isNull() | r.end_ms.isNull()), ranges)


def source_spec(s: Column) -> Column:
    """struct(path, track_id) of 'file:track', split at the last colon so that URIs stay whole."""
    return F.struct(F.regexp_extract(s, r"^(.*):(\d+)$", 1).alias("path"), F.regexp_extract(s, r"^(.*):(\d+)$", 2).try_cast("bigint").alias("track_id"))


def subtitle_format(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.endswith(".ass") | low.endswith(".ssa"), "ass").when(path.isNotNull(), "srt")


def default_subtitle_end(start_ms: Column) -> Column:
    return start_ms + DEFAULT_SUBTITLE_MS


def quoted(c: Column) -> Column:
    """A string in double quotes with backslash, quote and line breaks escaped."""
    out = reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")], F.coalesce(c, F.lit("")))
    return F.concat(F.lit('"'), out, F.lit('"'))


def progress_percent(done: Column, total: Column) -> Column:
    """Whole percents, 100 at most; -1 where the total is unknown."""
    return F.when(total > 0, F.least(F.floor(done * 100 / total), F.lit(100))).otherwise(F.lit(-1)).cast("int")
