from cuewright.operators.subtitles import ass_header, extract_srt, parse_ass, parse_srt, render_srt

SRT = "7\n01:12:03,040 --> 01:12:06,500\n<i>The ferry left</i>\n\n8\n02:00:00,000 --> 02:00:01,999\nthree\nlines of\nwords, 12 of them\n"
ASS = "[Script Info]\nTitle: Harbour\n\n[V4+ Styles]\nFormat: Name, Fontsize\nStyle: Low,31\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\nDialogue: 2,1:12:03.04,1:12:06.50,Low,Ann,5,5,0,,{\\an8}The ferry, it left\nComment: 0,0:00:00.00,0:00:01.00,Low,,0,0,0,,no line\nDialogue: 0,2:00:00.00,2:00:01.99,Low,,0,0,0,fade,three\\Nlines\n"


def texts(spark, *values):
    return spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(values)], "path string, value string")


def test_srt(spark):
    got = [tuple(r) for r in parse_srt(texts(spark, SRT, "", "garbage\nmore", "﻿" + SRT[:SRT.index("8\n02")], SRT.replace("\n", "\r\n"), None)).orderBy("path", "seq").collect()]
    want = [(1, 4323040, 4326500, "<i>The ferry left</i>"), (2, 7200000, 7201999, "three\nlines of\nwords, 12 of them")]
    assert [g[1:] for g in got if g[0] == "f0"] == want and [g[1:] for g in got if g[0] == "f4"] == want
    assert [g[1:] for g in got if g[0] == "f3"] == [want[0]] and {g[0] for g in got} == {"f0", "f3", "f4"}


def test_srt_round_trip(spark):
    events = spark.createDataFrame([("a", 1, 62345, 70000, "x\ny"), ("a", 5, 80000, 90000, "z"), ("a", 6, 1, 2, ""), ("a", 7, None, 2, "q")], "path string, seq int, start_ms long, end_ms long, text string")
    cues = "".join(r["cue"] for r in render_srt(events).orderBy("number").collect())
    assert [tuple(r)[1:] for r in parse_srt(texts(spark, cues)).orderBy("seq").collect()] == [(1, 62345, 70000, "x\ny"), (2, 80000, 90000, "z")]
    blocks = spark.createDataFrame([("a", 3, 1000, "hi")], "path string, block_seq long, timecode_ms long, text string")
    assert extract_srt(blocks).first()["cue"] == "1\n00:00:01,000 --> 00:00:04,000\nhi\n\n"


def test_ass(spark):
    bad = ASS.replace("2:00:00.00", "later")
    comment = ASS.replace("[Events]\n", "[Events]\n; a comment\n")
    few = ASS.replace(",Ann,5,5,0,,{\\an8}The ferry, it left", "").replace(",,0,0,0,fade,three\\Nlines", "")
    got = [tuple(r) for r in parse_ass(texts(spark, ASS, bad, comment, few, "", None)).orderBy("path", "seq").collect()]
    assert [g for g in got if g[0] == "f0"] == [("f0", 1, 4323040, 4326500, "Low,Ann,5,5,0,,{\\an8}The ferry, it left"), ("f0", 2, 7200000, 7201990, "Low,,0,0,0,fade,three\\Nlines")]
    assert [g[0] for g in got] == ["f0", "f0", "f1", "f2", "f2"]
    df = texts(spark, ASS)
    head = df.select(ass_header(df["value"]).alias("h")).first()["h"]
    assert head.startswith("[Script Info]") and head.endswith("Effect, Text")
