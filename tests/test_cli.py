import json

import pytest
from pyspark.sql import functions as F

from cuewright.cli import bar, main, numbers, parser, spans, track_input
from cuewright.sources.container_sink import write_containers
from cuewright.sources.container_source import Container


@pytest.fixture(scope="module")
def file(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("cli"))
    segments = spark.createDataFrame([("a.mkv", "Title", 1_000_000, 3_723_456.0)], "path string, title string, timecode_scale long, duration double")
    tracks = spark.createDataFrame([("a.mkv", 0, 1, "video", "h264", "eng", "V", 1920, 1080)], "path string, track_index int, track_id long, type string, codec string, language string, name string, width long, height long")
    blocks = spark.createDataFrame([("a.mkv", s, 1, 500 * s, s % 2 == 0, b"x") for s in range(6)], "path string, block_seq long, track_number long, timecode_ms long, keyframe boolean, data binary")
    tags = spark.createDataFrame([("a.mkv", 0, "")], "path string, tag_index int, target_type string").withColumn("target_id", F.lit(None).cast("decimal(20,0)"))
    simple = spark.createDataFrame([("a.mkv", 0, 0, -1, "A", "x", "")], "path string, tag_index int, node int, parent_node int, name string, value string, language string")
    write_containers(folder, segments, tracks, blocks, tags=tags, simple_tags=simple)
    return f"{folder}/a.mkv"


def test_arguments():
    assert numbers("1,2") == [1, 2] and spans("0-5,7-0") == [(0, 5), (7, 0)] and track_input("s3://b/x.mkv:3").track_id == 3
    assert len(parser()._subparsers._group_actions[0].choices) == 22
    for bad in (["split", "a", "b", "--ranges", "x"], ["mux", "o", "file"], ["demux", "a", "b", "--tracks", "q"], []):
        with pytest.raises(SystemExit):
            parser().parse_args(bad)


def test_listings(spark, file, capsys):
    assert main(["info", file]) == 0 and "Duration: 01:02:03" in capsys.readouterr().out
    main(["tracks", file])
    assert capsys.readouterr().out.strip() == "1: video h264 [eng] V 1920x1080 default"
    main(["-json", "tracks", file])
    assert json.loads(capsys.readouterr().out)[0]["codec"] == "h264"
    main(["tags", file])
    assert capsys.readouterr().out.strip() == "[global] A = x (und)"
    assert main(["probe", file]) == 0 and main(["chapters", file]) == 0 and main(["attachments", file]) == 0
    assert main(["validate", file]) == 0 and main(["compare", file, file]) == 0


def test_edits(spark, file, tmp_path, capsys):
    out = str(tmp_path / "o.mkv")
    assert main(["edit", file, out, json.dumps({"title": "N", "tracks": [{"id": 1, "language": "deu"}], "chapters": [{"title": "C", "start_ms": 5}], "tags": []})]) == 0
    c = Container(out)
    assert next(iter(c.segments()))[1] == "N" and next(iter(c.tracks()))[5] == "deu" and next(iter(c.chapters()))[6] == "C" and not list(c.tags())
    assert main(["edit-title", out, str(tmp_path / "p.mkv"), "Q"]) == 0 and main(["edit-track", out, str(tmp_path / "q.mkv"), "1", "--name", "Z", "--forced", "true"]) == 0
    assert next(iter(Container(str(tmp_path / "q.mkv")).tracks()))[6] == "Z"
    assert main(["edit-inplace", out, '{"title": "M"}']) == 0 and next(iter(Container(out).segments()))[1] == "M"
    assert main(["edit-track", out, str(tmp_path / "r.mkv"), "9"]) == 1 and main(["edit", out, "x", '{"nope": 1}']) == 1
    assert main(["split", file, str(tmp_path), "--ranges", "0-1000,1000-0"]) == 0 and main(["join", str(tmp_path / "j.mkv"), str(tmp_path / "part_001.mkv"), str(tmp_path / "part_002.mkv")]) == 0
    assert len(list(Container(str(tmp_path / "j.mkv")).blocks())) == 6
    assert main(["mux", str(tmp_path / "m.mkv"), f"{file}:1"]) == 0 and main(["merge", str(tmp_path / "n.mkv"), file, file]) == 0 and main(["demux", file, str(tmp_path)]) == 0
    assert (tmp_path / "1.h264").read_bytes() == b"x" * 6


def test_patch_keeps_ids_targets_and_trees(file, tmp_path, capsys):
    out = str(tmp_path / "o.mkv")
    patch = {"chapters": [{"id": 77, "title": "A", "start_ms": 0, "end_ms": 9, "sub_chapters": [{"id": 78, "title": "A1", "sub_chapters": [{"title": "A11"}]}, {"title": "A2"}]}, {"title": "B", "sub_chapters": None}], "tags": [{"target_id": 1, "target_type": "TRACK", "simple_tags": [{"name": "N", "value": "v", "sub_tags": [{"name": "S", "language": "deu"}]}]}, {}]}
    assert main(["edit", file, out, json.dumps(patch)]) == 0
    c = Container(out)
    assert [(r[1], r[2], r[3], r[6]) for r in c.chapters()] == [(0, -1, 0, "A"), (1, 0, 1, "A1"), (2, 1, 2, "A11"), (3, 0, 1, "A2"), (4, -1, 0, "B")]
    assert [int(r[5]) for r in c.chapters()][:2] == [77, 78]
    assert [(r[2], r[3] and int(r[3])) for r in c.tags()] == [("TRACK", 1), ("", None)]
    assert [(r[1], r[2], r[3], r[5], r[6], r[8]) for r in c.simple_tags()] == [(0, 0, -1, "N", "v", ""), (0, 1, 0, "S", "", "deu")]
    main(["-json", "probe", out])
    told = json.loads(capsys.readouterr().out)
    assert len(told["chapters"]) == 5 and told["simple_tags"][1]["parent_node"] == 0 and told["cues"] and told["tracks"][0]["width"] == 1920


def test_subtitle_formats_and_merges(file, tmp_path):
    text = tmp_path / "words.txt"
    text.write_text("[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\nDialogue: 0,0:00:00.50,0:00:01.00,Low,,0,0,0,,hi\n")
    out = str(tmp_path / "s.mkv")
    assert main(["merge-subtitle", file, str(text), out, "--format", "ass"]) == 0 and [r[4] for r in Container(out).tracks()] == ["h264", "ass"]
    assert main(["extract-subtitle", out, "2", str(tmp_path / "back.txt"), "--format", "ass"]) == 0 and "Dialogue: 0,0:00:00.50" in (tmp_path / "back.txt").read_text()
    srt = tmp_path / "w.srt"
    srt.write_text("1\n00:00:01,200 --> 00:00:02,000\nhello\n")
    both = str(tmp_path / "b.mkv")
    assert main(["merge-subtitle", file, str(srt), both, "--merge", out, "--language", "fra"]) == 0
    assert [r[3] for r in Container(both).tracks()] == ["video", "video", "subtitle", "subtitle"] and len(list(Container(both).blocks())) == 14
    assert sorted(x.name for x in tmp_path.iterdir() if "merged" in x.name) == []
    with pytest.raises(SystemExit):
        parser().parse_args(["merge-subtitle", "a", "b", "c", "--format", "pgs"])


def test_bar():
    assert bar(5, 0) == "5 done" and bar(1, 2, 10) == "[=====     ]  50.0% 1/2" and bar(9, 3, 4) == "[====] 100.0% 9/3"
