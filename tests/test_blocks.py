"""Order-dependent block operators against a line-by-line reading of the stream."""

import random

import pytest
from pyspark.sql import functions as F

from cuewright.operators import blocks as B
from cuewright.operators import containers as C
from cuewright.operators.ordered import carried, ranked

SCHEMA = "path string, block_seq long, track_number long, timecode_ms long, keyframe boolean, data binary"


def stream(seed, n=120, ordered=False):
    rnd = random.Random(seed)
    rows = []
    for path in ("a", "b"):
        t = 0
        for seq in sorted(rnd.sample(range(1, 4 * n), n)):
            t = max(0, t + rnd.choice([0, 40, 90, 400, 1200, -30, -1500])) if not ordered else t + rnd.choice([0, 40, 400, 1200])
            rows.append((path, seq, rnd.randrange(1, 4), t, rnd.random() < 0.15, bytes([seq % 256]) * rnd.randrange(4)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def by_path(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_carried_folds(spark, seed):
    rows = stream(seed)
    got = carried(frame(spark, rows), ["path"], "block_seq", {"n": ("count", F.lit(1)), "s": ("sum", F.col("track_number")), "hi": ("max", F.col("timecode_ms")), "lo": ("min", F.col("timecode_ms")), "last": ("last", F.when(F.col("keyframe"), F.col("block_seq")))}, chunk=17)
    got = {(r["path"], r["block_seq"]): (r["n"], r["s"], r["hi"], r["lo"], r["last"]) for r in got.collect()}
    for path, own in by_path(rows).items():
        for i, r in enumerate(own):
            before = own[:i]
            keys = [x[1] for x in before if x[4]]
            assert got[path, r[1]] == (i, sum(x[2] for x in before), max((x[3] for x in before), default=None), min((x[3] for x in before), default=None), keys[-1] if keys else None)


def plain_clusters(own, width):
    out, c = [], None
    for r in own:
        if c is None or r[3] - c >= width:
            c = r[3]
        out.append((r[0], r[1], c))
    return out


@pytest.mark.parametrize("chunk", [3, 11, 64, 65536])
def test_greedy_clusters_and_cues(spark, chunk):
    rows = stream(chunk)
    clustered = B.greedy_clusters(frame(spark, rows), chunk=chunk)
    want = [x for own in by_path(rows).values() for x in plain_clusters(own, 1000)]
    assert sorted((r["path"], r["block_seq"], r["cluster_ms"]) for r in clustered.collect()) == want
    cues = set()
    for path, own in by_path(rows).items():
        last, groups = -501, {}
        for r, (_, _, c) in zip(own, plain_clusters(own, 1000)):
            groups.setdefault(c, []).append(r)
        for c, members in groups.items():
            pick = next((m for m in members if m[4]), None)
            if pick is None and members[0][3] - last >= 500:
                pick = members[0]
            if pick:
                last = pick[3]
                cues.add((path, c, pick[3], pick[2]))
    assert {tuple(r) for r in B.cues(clustered).collect()} == cues
    sizes = {(r["path"], r["cluster_ms"]): (r["n_blocks"], r["n_bytes"]) for r in B.cluster_summary(clustered).collect()}
    assert sum(n for n, _ in sizes.values()) == len(rows) and sum(b for _, b in sizes.values()) == sum(len(r[5]) for r in rows)


def plain_cut(own, s, e, tracks):
    out, started = [], False
    for r in own:
        if s > 0 and r[3] < s:
            continue
        if s > 0 and not started and not r[4]:
            continue
        if e > 0 and r[3] >= e:
            if not r[4]:
                continue
            break
        if r[2] not in tracks:
            continue
        started = True
        out.append((r[1], r[3] - s))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_keyframe_cuts_against_a_line_by_line_reading(spark, seed):
    rows = stream(seed, ordered=seed % 2 == 0)
    ranges = [(1, 0, 5000), (2, 5000, 12000), (3, 3000, 0), (4, 0, 0), (5, 20000, 20001)]
    tracks = spark.createDataFrame([(p, t) for p in "ab" for t in (1, 2)], "path string, track_id long")
    got = B.split_at_keyframes(frame(spark, rows), spark.createDataFrame(ranges, "range_id int, start_ms long, end_ms long"), tracks).collect()
    for path, own in by_path(rows).items():
        for rid, s, e in ranges:
            mine = sorted((r["block_seq"], r["timecode_ms"]) for r in got if r["path"] == path and r["range_id"] == rid)
            assert mine == plain_cut(own, s, e, {1, 2})


@pytest.mark.parametrize("seed", range(3))
def test_subtitles_before_the_first_block_that_reached_them(spark, seed):
    rows = stream(seed, n=60)
    rnd = random.Random(seed)
    subs = [(p, i, rnd.randrange(0, 30_000)) for p in ("a", "b", "c") for i in range(40)]
    got = {(r["path"], r["seq"]): r["before_seq"] for r in B.inject_subtitles(frame(spark, rows), spark.createDataFrame(subs, "path string, seq int, start_ms long")).collect()}
    want = {(p, i): None for p, i, _ in subs}
    for path, own in by_path(rows).items():
        queue = [(i, t) for p, i, t in subs if p == path]
        for r in own:
            while queue and queue[0][1] <= r[3]:
                want[path, queue.pop(0)[0]] = r[1]
    assert got == want


def test_validation_messages(spark):
    seg = spark.createDataFrame([("a", 0, None, 0, "", None), ("b", 1_000_000, 5.0, 5, "m", "w"), ("c", 1_000_000, 5.0, 5, "m", "w")], "path string, timecode_scale long, duration double, duration_ms long, muxing_app string, writing_app string")
    tracks = spark.createDataFrame([("a", 0, 1, "video", "", "", None, None, None, None), ("a", 1, 1, "audio", "aac", "eng", None, None, None, None), ("b", 0, 2, "subtitle", "srt", "eng", None, None, None, None)], "path string, track_index int, track_id long, type string, codec string, language string, width long, height long, codec_private binary, sample_rate double")
    blocks = frame(spark, [("a", 1, 1, 5000, True, b""), ("a", 2, 1, 0, False, b""), ("b", 1, 1, 0, None, b"")])
    got = {(r["path"], r["check_id"], r["message"]) for r in C.validate(seg, tracks, blocks).collect()}
    assert {c for p, c, _ in got if p == "a"} == {"V01", "V02", "V03", "V04", "V06", "V07", "V08", "V09", "V10", "V11", "V15"}
    assert {c for p, c, _ in got if p == "b"} == {"V12", "V17", "V18"} and {c for p, c, _ in got if p == "c"} == {"V05", "V12", "V16"}
    assert ("a", "V15", "timecode went backwards: 5000ms → 0ms at block 2") in got and ("b", "V18", "track 2 (subtitle): no blocks") in got


def test_missing_mux_input_raises(spark):
    tracks = spark.createDataFrame([("a", 0, 1, "video", "h264", "eng", None)], "path string, track_index int, track_id long, type string, codec string, language string, name string")
    inputs = spark.createDataFrame([("d", 1, "a", 9, None, None, True)], "dst string, ord long, path string, track_id long, language string, name string, is_default boolean")
    with pytest.raises(Exception, match="track 9 not found in a"):
        C.mux_tracks(inputs, tracks).collect()


def test_chapter_ranges(spark):
    rows = [("a", 0, i, s, e) for i, (s, e) in enumerate([(0, None), (5000, 0), (10000, 0)])] + [("b", 0, 0, 0, 100), ("b", 0, 1, 100, 200), ("b", 1, 0, 5, 6)]
    got = C.chapter_ranges(spark.createDataFrame(rows, "path string, depth int, ordinal int, start_ms long, end_ms long")).orderBy("path", "range_id").collect()
    assert [tuple(r)[2:] for r in got] == [(0, 5000), (5000, 10000), (10000, 0), (0, 100), (100, 200)]


def test_parts_of_keyframe_cuts_are_disjoint_and_cover(spark):
    rows = [("a", i, 1, 500 * i, i % 4 == 0, b"") for i in range(40)]
    cuts = [(1, 0, 6000), (2, 6000, 12000), (3, 12000, 0)]
    got = B.split_at_keyframes(frame(spark, rows), spark.createDataFrame(cuts, "range_id int, start_ms long, end_ms long")).select("block_seq").collect()
    assert sorted(r[0] for r in got) == list(range(40))


def test_many_ranges_meet_in_buckets(spark, monkeypatch):
    rows = stream(9, n=80)
    ranges = [(i, i * 7000 % 90_000, [0, 50_000, 100, i * 7000 % 90_000 + 9000][i % 4]) for i in range(40)]
    df = spark.createDataFrame(ranges, "range_id int, start_ms long, end_ms long")
    few = sorted(tuple(r)[:5] for r in B.split_by_ranges(frame(spark, rows), df).collect())
    monkeypatch.setattr(B, "MOST_RANGES", 3)
    assert sorted(tuple(r)[:5] for r in B.split_by_ranges(frame(spark, rows), df).collect()) == few and few
    parts = lambda df: sorted(tuple(r)[:5] for r in df.collect())
    many = parts(B.split_at_keyframes(frame(spark, rows), df))
    monkeypatch.setattr(B, "MOST_RANGES", 64)
    assert parts(B.split_at_keyframes(frame(spark, rows), df)) == many and many


def plain_keyframe_cut(own, ranges):
    """By the set definition, a range at a time over the sorted stream."""
    out = []
    for rid, s, e in ranges:
        stop = min((q for q, t, key in own if e > 0 and key and t >= max(s, e)), default=None)
        inside = [(q, t, key) for q, t, key in own if t >= s and (e == 0 or t < e)]
        start = min((q for q, _, key in inside if key), default=None)
        out += [(rid, q) for q, _, _ in inside if (s == 0 or (start is not None and q >= start)) and (stop is None or q < stop)]
    return sorted(out)


def test_twenty_thousand_keyframe_cuts(spark):
    rnd = random.Random(11)
    own = [(q, max(0, q * 9 + rnd.randrange(-400, 400)), rnd.random() < 0.3) for q in range(1200)]
    ranges = [(i, s, 0 if i % 4000 == 0 else max(1, s + rnd.choice([-50, 5, 20, 60]))) for i, s in enumerate(rnd.randrange(0, 12_000) for _ in range(20_000))]
    df = spark.createDataFrame([("a", q, 1, t, key, b"") for q, t, key in own], SCHEMA)
    got = B.split_at_keyframes(df, spark.createDataFrame(ranges, "range_id int, start_ms long, end_ms long")).select("range_id", "block_seq").collect()
    assert sorted(map(tuple, got)) == plain_keyframe_cut(own, ranges)


def test_ranked_numbers(spark):
    rows = [(k, rnd_, i) for i, (k, rnd_) in enumerate((f"k{i % 3 if i % 7 else 0}", (i * 7919) % 1000 / 10) for i in range(2000))]
    got = ranked(spark.createDataFrame(rows, "k string, v double, i int").repartition(7), ["k"], ["v", "i"], "n").collect()
    want = {}
    for k, v, i in sorted(rows):
        want.setdefault(k, []).append(i)
    assert sorted((r["k"], r["n"], r["i"]) for r in got) == sorted((k, n, i) for k, own in want.items() for n, i in enumerate(own, 1))


def test_filters_reach_the_scan_and_scans_are_shared(spark, sf):
    from cuewright.plans.container_queries import QUERIES

    plan = lambda q: QUERIES[q](spark, sf)._jdf.queryExecution().toString()
    for q in ("time_range", "time_shift"):
        assert "GreaterThanOrEqual(timecode_ms,2000)" in plan(q)
    physical = QUERIES["validate_issues"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("blocks.parquet") <= 3 and "NestedLoop" not in QUERIES["split_keyframes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert QUERIES["ass_parse"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 4
