"""The product of three keys of blocks, within 64 bits and beyond them."""

import pytest

import __spark_entry__ as entry

#: block_seq, timecode_ms, track_number; the products go past 2^53, 2^63 and 2^64.
ROWS = [(1, 0, 1), (150_000, 3_746_549, 2), (1_500_000_000_007, 377_285, 2), (2_000_000_015_000, 377_285, 2), (3_000_000_015_000, 377_285, 2), (8_000_000_000_000_001, 4_746_549, 12), (9_223_372_036_854_775_806, 0, -6), (9_223_372_036_854_775_807, 1, -6), (10**12, 10**12 + 12_345, 10**12 + 3)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("big"))
    rows = [("/a.mkv", s, n, t, True, b"x") for s, t, n in ROWS]
    spark.createDataFrame(rows, "path string, block_seq long, track_number long, timecode_ms long, keyframe boolean, data binary").write.parquet(f"{d}/blocks.parquet")
    return d


def results(spark, d, name):
    """(product, its row) of each block."""
    rows = entry.queries()[name](spark, d).collect()
    assert len(rows) == len(ROWS)
    return [(s * (t + 1) * (n + 7), next(r for r in rows if r["block_seq"] == s)) for s, t, n in ROWS]


def test_byte_formats(spark, folder):
    def text(v):
        for shift, unit in ((30, "GB"), (20, "MB"), (10, "KB")):
            if v >= 1 << shift:
                held = int(float(v)) if v < 1 << 63 and int(float(v)) < 1 << 63 else v
                tenths, rest = divmod(held * 10, 1 << shift)
                tenths += rest * 2 > 1 << shift or (rest * 2 == 1 << shift and tenths % 2)
                return f"{tenths // 10}.{tenths % 10} {unit}"
        return f"{v} B"

    for v, row in results(spark, folder, "byte_formats"):
        assert row["size"] == text(v)


def test_size_lengths(spark, folder):
    width = lambda v, limit: next((w for w in range(1, 8) if v <= limit(w)), 8)
    for v, row in results(spark, folder, "size_lengths"):
        size = width(v, lambda w: (1 << 7 * w) - 2)
        assert (row["data_size_len"], row["vint_len"], row["uint_len"], row["element_id_len"], row["hexed"]) == (size, size, width(v, lambda w: (1 << 8 * w) - 1), 4 if v >= 1 << 28 else 1, f"{v:02x}")


def test_time_formats(spark, folder):
    for v, row in results(spark, folder, "time_formats"):
        h, m, s = v // 3_600_000, v // 60_000 % 60, v // 1000 % 60
        back = (v, v // 10 * 10) if v < 1 << 63 else (None, None)
        want = (f"{h:02}:{m:02}:{s:02},{v % 1000:03}", f"{h}:{m:02}:{s:02}.{v // 10 % 100:02}", f"{h:02}:{m:02}:{s:02}", *back)
        assert (row["srt"], row["ass"], row["clock"], row["srt_back"], row["ass_back"]) == want
