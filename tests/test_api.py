"""Operations on files, written and read back."""

import os

import pytest
from pyspark.sql import functions as F

from cuewright import api
from cuewright.sources.container_sink import write_containers
from cuewright.sources.container_source import Container


@pytest.fixture(scope="module")
def media(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("media"))
    seg = [(n, n, 1_000_000, 200.0) for n in ("a.mkv", "b.mkv")]
    segments = spark.createDataFrame(seg, "path string, title string, timecode_scale long, duration double")
    tracks = spark.createDataFrame([(n, i, i + 1, t, c, "eng") for n, _, _, _ in seg for i, (t, c) in enumerate([("video", "h264"), ("audio", "aac")])], "path string, track_index int, track_id long, type string, codec string, language string")
    blocks = spark.createDataFrame([(n, s, 1 + s % 2, 50 * s, s in (0, 2), f"{n}{s}".encode()) for n, _, _, _ in seg for s in range(4)], "path string, block_seq long, track_number long, timecode_ms long, keyframe boolean, data binary")
    chapters = spark.createDataFrame([("a.mkv", 0, -1, 0, 0, "One", 0, 100), ("a.mkv", 1, -1, 0, 1, "Two", 100, 200)], "path string, node int, parent_node int, depth int, ordinal int, title string, start_ms long, end_ms long")
    att = spark.createDataFrame([("a.mkv", 0, "c.png", "image/png", b"png")], "path string, att_index int, name string, mime_type string, data binary").withColumn("id", F.lit(7).cast("decimal(20,0)"))
    write_containers(folder, segments, tracks, blocks, chapters, att)
    return folder


def blocks_of(path):
    return [(b[5], b[6], b[8]) for b in Container(path).blocks()]


def test_mux_merge_join_split(spark, media, tmp_path):
    a, b, out = f"{media}/a.mkv", f"{media}/b.mkv", str(tmp_path)
    api.mux(spark, [api.TrackInput(a, 1, name="Main", is_default=True), api.TrackInput(b, 2, language="deu")], f"{out}/m.mkv")
    assert blocks_of(f"{out}/m.mkv") == [(1, 0, b"a.mkv0"), (2, 50, b"b.mkv1"), (1, 100, b"a.mkv2"), (2, 150, b"b.mkv3")]
    tracks = list(Container(f"{out}/m.mkv").tracks())
    assert [(t[2], t[4], t[5], t[6], t[7]) for t in tracks] == [(1, "h264", "eng", "Main", True), (2, "aac", "deu", "", False)]
    api.merge(spark, [a, b], f"{out}/all.mkv")
    got = blocks_of(f"{out}/all.mkv")
    assert len(got) == 8 and [g[1] for g in got] == sorted(g[1] for g in got) and len(list(Container(f"{out}/all.mkv").chapters())) == 2
    api.join(spark, [a, b], f"{out}/j.mkv")
    assert [g[1] for g in blocks_of(f"{out}/j.mkv")] == [0, 50, 100, 150, 200, 250, 300, 350]
    api.split(spark, a, f"{out}/parts")
    assert [blocks_of(f"{out}/parts/part_00{n}.mkv") for n in (1, 2)] == [[(1, 0, b"a.mkv0"), (2, 50, b"a.mkv1")], [(1, 0, b"a.mkv2"), (2, 50, b"a.mkv3")]]
    api.split(spark, a, f"{out}/segs", [(0, 100), (100, 0)], "seg_%02d.mkv")
    assert sorted(os.listdir(f"{out}/segs")) == ["seg_01.mkv", "seg_02.mkv"]
    api.remove_track(spark, a, f"{out}/r.mkv", [1])
    assert blocks_of(f"{out}/r.mkv") == [(1, 50, b"a.mkv1"), (1, 150, b"a.mkv3")]
    with pytest.raises(ValueError, match="track"):
        api.join(spark, [a, f"{out}/r.mkv"], f"{out}/bad.mkv")


def test_rest(spark, media, tmp_path):
    a, b, out = f"{media}/a.mkv", f"{media}/b.mkv", str(tmp_path)
    api.add_track(spark, a, api.TrackInput(b, 2, name="Extra"), f"{out}/add.mkv")
    assert [g[0] for g in blocks_of(f"{out}/add.mkv")] == [1, 2, 3, 1, 2, 3] and len(list(Container(f"{out}/add.mkv").tracks())) == 3
    api.demux(spark, a, out, [2])
    assert (tmp_path / "2.aac").read_bytes() == b"a.mkv1a.mkv3"
    assert api.extract_attachment(spark, a, 7, f"{out}/c.png") == 3 and (tmp_path / "c.png").read_bytes() == b"png"
    api.edit_metadata(spark, a, f"{out}/e.mkv", segments=lambda df: df.withColumn("title", F.lit("New")))
    assert next(iter(Container(f"{out}/e.mkv").segments()))[1] == "New" and blocks_of(f"{out}/e.mkv") == blocks_of(a)
    api.edit_in_place(spark, f"{out}/e.mkv", segments=lambda df: df.withColumn("title", F.lit("N")))
    assert next(iter(Container(f"{out}/e.mkv").segments()))[1] == "N"
    diffs = {(r["type"], r["section"]) for r in api.compare(spark, a, f"{out}/add.mkv").collect()}
    assert ("added", "track[3]") in diffs and len(diffs) == 1
    assert {r["check_id"] for r in api.validate(spark, a).collect()} >= {"V08", "V09", "V10"}
    (tmp_path / "s.srt").write_text("1\n00:00:00,040 --> 00:00:00,060\nHello\n\n2\n00:00:09,000 --> 00:00:10,000\nBye\n")
    api.merge_subtitle(spark, a, f"{out}/s.srt", f"{out}/sub.mkv", "eng")
    assert [g for g in blocks_of(f"{out}/sub.mkv") if g[0] == 3] == [(3, 40, b"Hello"), (3, 9000, b"Bye")] and blocks_of(f"{out}/sub.mkv")[1][0] == 3
    api.extract_subtitle(spark, f"{out}/sub.mkv", 3, f"{out}/back.srt")
    assert (tmp_path / "back.srt").read_text().startswith("1\n00:00:00,040 --> 00:00:03,040\nHello\n\n2\n")
    (tmp_path / "s.ass").write_text("[Script Info]\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\nDialogue: 0,0:00:00.01,0:00:04.00,Default,,0,0,0,,Hi, you\n")
    api.merge_subtitle(spark, a, f"{out}/s.ass", f"{out}/ass.mkv")
    api.extract_ass(spark, f"{out}/ass.mkv", 3, f"{out}/back.ass")
    assert "Dialogue: 0,0:00:00.01,0:00:03.01,Default,,0,0,0,,Hi, you" in (tmp_path / "back.ass").read_text() and (tmp_path / "back.ass").read_text().startswith("[Script Info]")
    for call in (lambda: api.demux(spark, a, out, [99]), lambda: api.extract_attachment(spark, a, 1, f"{out}/x"), lambda: api.extract_subtitle(spark, a, 1, f"{out}/x"), lambda: api.remove_track(spark, a, f"{out}/x.mkv", [1, 2])):
        with pytest.raises(ValueError):
            call()


def test_progress_and_the_folder_for_intermediate_data(spark, monkeypatch):
    import time

    from cuewright import runtime

    seen = []
    with runtime.task_progress(spark, lambda done, total: seen.append((done, total)), 0.02):
        spark.range(4, numPartitions=4).mapInArrow(lambda it: (time.sleep(0.3) or b for b in it), "id long").count()
    assert seen and all(0 <= d <= t for d, t in seen)
    with runtime.task_progress(spark, None):
        pass

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime._checkpoint_folder(Session())
