"""The binary format: expected bytes, and files written and read back."""

import io
import os
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cuewright.sources import ebml as X
from cuewright.sources.container_sink import ContainerWriter, edit_in_place, metadata_parts, seek_head, write_containers, write_streams
from cuewright.sources.container_source import Container, decode_containers, read_container


def test_numbers():
    assert X.read_vint(b"\x81", keep_marker=True) == (0x81, 1) and X.read_vint(b"\x40\x01", keep_marker=True) == (0x4001, 2) and X.read_vint(b"\x20\0\x01", keep_marker=True) == (0x200001, 3)
    for bad in (b"\0", b"", b"\x40"):
        with pytest.raises(X.FormatError):
            X.read_vint(bad)
    assert X.read_vint(b"\xff") == (X.UNKNOWN, 1) and X.read_vint(X.size_bytes(-1)) == (X.UNKNOWN, 8)
    assert [X.lax_vint(bytes.fromhex(h)) for h in ("", "81", "ff", "4001", "10000001", "40")] == [(0, 0), (1, 1), (0x7F, 1), (1, 2), (1, 4), (0x40 & 0x3FFF, 1)]
    for size in (0, 1, 126, 127, 16382, 16383, 2097150, 2097151, 268435454, 268435455):
        assert X.read_vint(X.size_bytes(size)) == (size, X.size_width(size))
    assert [X.size_width(s) for s in (0, 126, 127, 16382, 16383, -1)] == [1, 1, 2, 2, 3, 8]
    assert [len(X.id_bytes(i)) for i in (0xEC, 0x4489, 0x2AD7B1, 0x18538067)] == [1, 2, 3, 4]
    assert [len(X.void(n)) for n in (0, 1, 2, 3, 100, 128, 129, 130, 20000)] == [0, 0, 2, 3, 100, 128, 129, 130, 20000]


def test_values():
    assert X.decode_value("u", b"") == 0 and X.decode_value("u", b"\xff" * 8) == 2**64 - 1 and X.decode_value("t", b"a\0\0") == "a"
    assert X.decode_value("f", struct.pack(">f", 1.5)) == 1.5
    for kind, body in (("u", b"\0" * 9), ("f", b""), ("f", b"abc")):
        with pytest.raises(X.FormatError):
            X.decode_value(kind, body)


def test_lacing():
    fixed = X.block_frames(bytes.fromhex("81000004" + "02" + "AABBCCDDEEFF"), True)
    assert fixed[3] == [b"\xaa\xbb", b"\xcc\xdd", b"\xee\xff"]
    xiph = X.block_frames(bytes.fromhex("81000002" + "01" + "FF2D") + b"\x11" * 300 + b"\x22" * 50, True)
    assert [len(f) for f in xiph[3]] == [300, 50]
    ebml = bytes.fromhex("81000006" + "02" + "E4C0") + b"\xaa" * 100 + b"\xbb" * 100 + b"\xcc" * 50
    assert [len(f) for f in X.block_frames(ebml, True)[3]] == [100, 100, 50] and [len(f) for f in X.block_frames(ebml, True, standard=True)[3]] == [100, 101, 49]
    assert X.block_frames(bytes.fromhex("81FFFF80AA"), True)[:3] == (1, -1, True) and X.block_frames(bytes.fromhex("81000080AA"), False)[2] is False
    for bad in ("8100", "81000004", "810000020105"):
        with pytest.raises(X.FormatError):
            X.block_frames(bytes.fromhex(bad), True)


def test_tag_depth():
    body = b""
    for _ in range(70):
        body = X.encode("simple_tag", body)
    with pytest.raises(X.FormatError, match="nesting"):
        X.decode_master(X.encode("tag", body))


def test_seek_head_points_at_the_parts():
    parts = metadata_parts({"title": "x" * 200}, [{"track_index": 0, "track_id": 1, "type": "video", "codec": "h264"}])
    head = seek_head(parts)
    node = X.decode_master(head).last("seek_head")
    joint = head + b"".join(parts)
    for s in node.all("seek"):
        at = s.last("seek_position")
        assert joint[at : at + len(s.last("seek_id"))] == s.last("seek_id")


def frames(spark):
    seg = [("/in/a.mkv", "Título", 1_000_000, 200.0, 0, b"\1" * 16), ("/in/b.mkv", "", 500_000, 9000.0, None, None)]
    segments = spark.createDataFrame(seg, "path string, title string, timecode_scale long, duration double, date_utc_ns long, segment_uid binary")
    tr = [("/in/a.mkv", 0, 1, "video", "h264", "eng", "V", True, False, b"\1", None, 1920, 1080, None, None, None), ("/in/a.mkv", 1, 2, "audio", "aac", "deu", "", False, True, None, b"\x0b", None, None, 2, 48000.0, 16), ("/in/b.mkv", 0, 7, "subtitle", "X_OTHER", None, None, None, None, None, None, None, None, None, None, None)]
    tracks = spark.createDataFrame(tr, "path string, track_index int, track_id long, type string, codec string, language string, name string, is_default boolean, is_forced boolean, codec_private binary, header_stripping binary, width long, height long, channels short, sample_rate double, bit_depth short")
    bl = [("/in/a.mkv", i, 1 + i % 2, i * 130, i % 5 == 0, bytes([i]) * (i % 4)) for i in range(60)] + [("/in/b.mkv", i, 7, i * 20_000, False, b"t%d" % i) for i in range(4)]
    blocks = spark.createDataFrame(bl, "path string, block_seq long, track_number long, timecode_ms long, keyframe boolean, data binary")
    ch = [("/in/a.mkv", 0, -1, 0, 0, "One", 0, 100), ("/in/a.mkv", 1, 0, 1, 0, "Sub", 0, 50), ("/in/a.mkv", 2, -1, 0, 1, None, 100, 0)]
    chapters = spark.createDataFrame(ch, "path string, node int, parent_node int, depth int, ordinal int, title string, start_ms long, end_ms long")
    att = spark.createDataFrame([("/in/a.mkv", 0, Decimal(5), "c.png", "image/png", b"png")], "path string, att_index int, id decimal(20,0), name string, mime_type string, data binary")
    tags = spark.createDataFrame([("/in/a.mkv", 0, "ALBUM", Decimal(2))], "path string, tag_index int, target_type string, target_id decimal(20,0)")
    simple = spark.createDataFrame([("/in/a.mkv", 0, 0, -1, "A", "x", "eng"), ("/in/a.mkv", 0, 1, 0, "B", "y", None)], "path string, tag_index int, node int, parent_node int, name string, value string, language string")
    return segments, tracks, blocks, chapters, att, tags, simple


def test_write_and_read_back(spark, tmp_path):
    segments, tracks, blocks, chapters, att, tags, simple = frames(spark)
    done = write_containers(str(tmp_path), segments, tracks, blocks, chapters, att, tags, simple)
    assert sorted((d[0], d[2]) for d in done) == [("/in/a.mkv", 60), ("/in/b.mkv", 4)] and all(os.path.getsize(d[1]) == d[3] for d in done)
    read = lambda table, **o: read_container(spark, str(tmp_path), table, **o).withColumn("path", F.concat(F.lit("/in/"), F.element_at(F.split("path", "/"), -1)))
    got = {r["path"]: r for r in read("segments").collect()}
    assert (got["/in/a.mkv"]["title"], got["/in/a.mkv"]["duration_ms"], got["/in/b.mkv"]["timecode_scale"], got["/in/b.mkv"]["duration_ms"]) == ("Título", 200, 500_000, 4500)
    t = {(r["path"], r["track_index"]): r for r in read("tracks").collect()}
    assert t["/in/a.mkv", 0]["codec"] == "h264" and t["/in/a.mkv", 1]["header_stripping"] == b"\x0b" and t["/in/a.mkv", 1]["is_forced"] and not t["/in/a.mkv", 1]["is_default"] and t["/in/a.mkv", 1]["sample_rate"] == 48000.0
    assert t["/in/b.mkv", 0]["codec"] == "X_OTHER" and t["/in/b.mkv", 0]["language"] == "eng" and t["/in/b.mkv", 0]["is_default"]
    for split in (1 << 30, 40):
        rows = read("blocks", splitBytes=split).orderBy("path", "block_seq").collect()
        want = [tuple(r)[2:] for r in blocks.orderBy("path", "block_seq").collect()]
        assert [(r["track_number"], r["timecode_ms"], r["keyframe"], r["data"]) for r in rows] == want
    assert [r["timecode_ms"] for r in read("blocks", startMs=1000, endMs=60_000).where("path = '/in/b.mkv'").orderBy("block_seq").collect()] == [20_000, 40_000]
    assert read("blocks", payload=False).where("data is not null").count() == 0
    assert [(r["node"], r["parent_node"], r["depth"], r["title"], r["end_ms"]) for r in read("chapters").orderBy("node").collect()] == [(0, -1, 0, "One", 100), (1, 0, 1, "Sub", 50), (2, -1, 0, "", 0)]
    a = read("attachments").first()
    assert (a["name"], a["mime_type"], a["size"], a["data"], a["id"]) == ("c.png", "image/png", 3, b"png", 5)
    assert read("tags").first()["target_type"] == "ALBUM" and [(r["node"], r["parent_node"], r["name"]) for r in read("simple_tags").orderBy("node").collect()] == [(0, -1, "A"), (1, 0, "B")]
    cues = read("cues").where("path = '/in/a.mkv'").orderBy("cue_index").collect()
    clusters = {r["offset"] for r in read("elements").where("path = '/in/a.mkv' and name = 'cluster'").collect()}
    seg = read("elements").where("path = '/in/a.mkv' and name = 'segment'").first()
    assert len(cues) == len(clusters) and {c["cluster_pos"] + seg["offset"] + seg["header_len"] for c in cues} == clusters
    assert read("errors").count() == 0


def test_broken_files(spark, tmp_path):
    segments, tracks, blocks, *_ = frames(spark)
    [(_, good, _, size)] = write_containers(str(tmp_path / "ok"), segments.where("title <> ''"), tracks, blocks)
    data = open(good, "rb").read()
    (tmp_path / "bad").mkdir()
    for i, cut in enumerate((b"", b"garbage", data[: size // 2], data[:40])):
        (tmp_path / "bad" / f"{i}.mkv").write_bytes(cut)
    (tmp_path / "bad" / "ok.mkv").write_bytes(data)
    where = str(tmp_path / "bad")
    assert read_container(spark, where, "tracks").select("path").distinct().count() == 2
    assert {r["path"][-5:] for r in read_container(spark, where, "errors").collect()} >= {"0.mkv", "1.mkv"}
    with pytest.raises(Exception, match=r"bad.\d.mkv"):
        read_container(spark, where, "tracks", mode="FAILFAST").collect()
    half = read_container(spark, where, "blocks").where("path like '%2.mkv'").count()
    assert 0 < half < 60


def test_unknown_size_cluster(tmp_path):
    head = X.id_bytes(X.SEGMENT_ID) + X.size_bytes(-1)
    cluster = X.id_bytes(X.CLUSTER_ID) + X.size_bytes(-1) + X.encode("timestamp", 5) + X.encode_block(1, 0, True, b"x")
    from cuewright.sources.container_sink import file_header

    path = tmp_path / "u.mkv"
    path.write_bytes(file_header() + head + metadata_parts({})[0] + cluster + cluster + X.encode("cues", b""))
    assert [(b[5], b[6], b[8]) for b in Container(str(path)).blocks()] == [(1, 5, b"x"), (1, 5, b"x")]


def test_cue_spacing(tmp_path):
    class Sink(list):
        def write(self, data):
            self.append(data)

    counts = []
    for times in ([0], [0, 100], [0, 100, 1600]):
        w = ContainerWriter(Sink())
        w.start(metadata_parts({}))
        for t in times:
            w.block(1, t, False, b"")
        w.finish()
        counts.append(len(w.cues))
    assert counts == [1, 1, 2]
    with pytest.raises(X.FormatError):
        X.encode_block(1, 40_000, False, b"")


def test_edit_in_place(spark, tmp_path):
    segments, tracks, blocks, *_ = frames(spark)
    [(_, path, _, size)] = write_containers(str(tmp_path), segments.where("title <> ''"), tracks, blocks)
    before = list(Container(path).blocks())
    rows = [r.asDict() for r in tracks.where("path = '/in/a.mkv'").collect()]
    edit_in_place(path, metadata_parts({"title": "T", "timecode_scale": 1_000_000}, rows))
    c = Container(path)
    assert next(iter(c.segments()))[1] == "T" and list(c.blocks()) == before and os.path.getsize(path) == size
    with pytest.raises(X.FormatError, match="fit"):
        edit_in_place(path, metadata_parts({"title": "x" * 5000}, rows))


def test_streams(spark, tmp_path):
    _, _, blocks, *_ = frames(spark)
    rows = blocks.where("path = '/in/a.mkv'").select(F.concat(F.lit("a/"), F.col("track_number").cast("string"), F.lit(".raw")).alias("file"), F.col("block_seq").alias("seq"), "data")
    done = dict((os.path.basename(f), n) for f, n in write_streams(str(tmp_path), rows))
    want = b"".join(bytes([i]) * (i % 4) for i in range(0, 60, 2))
    assert (tmp_path / "a" / "1.raw").read_bytes() == want and done["1.raw"] == len(want)
    with pytest.raises(Exception, match="leaves"):
        write_streams(str(tmp_path), rows.withColumn("file", F.lit("../evil")))


def big_file(path, n=4000, size=300, seek=True):
    with open(path, "wb") as f:
        w = ContainerWriter(f)
        w.start(metadata_parts({"title": "T"}, [{"track_index": 0, "track_id": 1, "type": "video", "codec": "h264"}]))
        for i in range(n):
            # Payloads hold the cluster's mark itself.
            w.block(1, 250 * i, i % 8 == 0, (X.id_bytes(X.CLUSTER_ID) + b"\x83\xe7\x81\x01" + bytes([i % 256])) * (size // 9))
        w.finish()


def test_what_a_split_reads_does_not_grow_with_its_place(tmp_path):
    path = str(tmp_path / "big.mkv")
    big_file(path)
    whole = [r[1] for r in Container(path).blocks()]
    step = os.path.getsize(path) // 20
    got, heads = [], []
    for k in range(20):
        c = Container(path)
        got += [r[1] for r in c.blocks(k * step, (k + 1) * step if k < 19 else None)]
        heads.append(c.heads_read)
    assert got == whole and len(whole) == 4000
    assert max(heads) <= 2 * min(heads[:-1]) + 10


def test_metadata_is_found_without_walking_the_clusters(tmp_path):
    path = str(tmp_path / "big.mkv")
    big_file(path, 2000)
    c = Container(path)
    assert len(list(c.tracks())) == 1 and len(list(c.segments())) == 1 and c.heads_read < 10
    assert len(list(c.seek_entries())) == 2 and all(r[4] for r in c.seek_entries())
    assert len(list(c.cues())) > 400  # not in the seek head, so the clusters are walked over


def test_attachment_sizes_come_from_headers(tmp_path):
    path = str(tmp_path / "a.mkv")
    with open(path, "wb") as f:
        w = ContainerWriter(f)
        w.start(metadata_parts({}, attachments=[{"att_index": 0, "id": 5, "name": "n", "mime_type": "m", "data": b"x" * 5_000_000}, {"att_index": 1, "id": 6, "name": "e", "mime_type": "m", "data": b""}]))
        w.finish()

    class Counting:
        def __init__(self, f):
            self.f, self.n = f, 0

        def read(self, k):
            out = self.f.read(k)
            self.n += len(out)
            return out

        def seek(self, *a):
            return self.f.seek(*a)

    f = Counting(open(path, "rb"))
    rows = list(Container(path, f=f).attachments(False))
    assert [(int(r[2]), r[5], r[6]) for r in rows] == [(5, 5_000_000, None), (6, 0, None)] and f.n < 2000
    assert [len(r[6]) for r in Container(path).attachments()] == [5_000_000, 0]


def test_laces_are_encoded_and_read_back():
    import random

    rnd = random.Random(3)
    for n in (1, 2, 3, 17, 256):
        frames = [bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 1, 64, 255, 256, 700]))) for _ in range(n)]
        for kind in (1, 3):
            for standard in (False, True):
                block = X.size_bytes(3) + b"\xff\xfe" + bytes([kind << 1]) + X.encode_lace(kind, frames, standard)
                assert X.block_frames(block, True, standard) == (3, -2, False, frames)
        same = [b"ab"] * n
        assert X.block_frames(b"\x81\0\0\x04" + X.encode_lace(2, same), True)[3] == same
    for bad in ([], [b""] * 257):
        with pytest.raises(X.FormatError):
            X.encode_lace(1, bad)
    with pytest.raises(X.FormatError):
        X.encode_lace(2, [b"a", b"bb"])


def test_contents_in_a_column(spark, tmp_path):
    path = str(tmp_path / "c.mkv")
    big_file(path, 40, 18)
    files = spark.read.format("binaryFile").load(path).select(F.lit("p").alias("path"), "content").unionByName(spark.createDataFrame([("none", None), ("bad", b"x"), ("empty", b"")], "path string, content binary"))
    assert decode_containers(files, "blocks").count() == 40 and decode_containers(files, "tracks").count() == 1
    assert {r["path"] for r in decode_containers(files, "errors").collect()} == {"bad", "empty"}
    with pytest.raises(Exception, match="bad|empty"):
        decode_containers(files, "blocks", failfast=True).collect()
    assert decode_containers(files.limit(0), "blocks").count() == 0


def test_a_broken_cluster_is_told_with_its_block(spark, tmp_path):
    from cuewright import api

    path = str(tmp_path / "d.mkv")
    big_file(path, 12, 18)
    data = open(path, "rb").read()
    rows = list(Container(path).blocks())
    cut = str(tmp_path / "e.mkv")
    with open(cut, "wb") as f:
        f.write(data[: rows[9][1] + 6])
    found = {r["check_id"]: r["message"] for r in api.validate(spark, cut).collect()}
    assert found["V14"].startswith("cluster read error at block 9: ")


def test_other_file_systems(tmp_path):
    from pyarrow import fs as pafs

    from cuewright.sources.container_source import register_filesystem

    class Elsewhere(pafs.SubTreeFileSystem):
        """Not a local file system by its type."""

    register_filesystem("else", lambda: Elsewhere(str(tmp_path), pafs.LocalFileSystem()))
    big_file(str(tmp_path / "f.mkv"), 12, 18)
    before = list(Container("else://f.mkv").blocks())
    edit_in_place("else://f.mkv", metadata_parts({"title": "U"}, [{"track_index": 0, "track_id": 1, "type": "video", "codec": "h264"}]))
    c = Container("else://f.mkv")
    assert next(iter(c.segments()))[1] == "U" and [r[1:] for r in c.blocks()] == [r[1:] for r in before] and sorted(x.name for x in tmp_path.iterdir()) == ["f.mkv"]


def test_repeated_blocks_are_written_once(spark, tmp_path):
    segments, tracks, blocks, *_ = frames(spark)
    odd = spark.createDataFrame([("/in/a.mkv", 60, 1, 7800, None, b"n"), ("/in/a.mkv", 60, 1, 7800, False, b"n"), ("/in/a.mkv", 61, 1, 7900, True, None), ("/in/none.mkv", 0, 1, 0, True, b"no segment")], blocks.schema)
    given = blocks.unionByName(odd)
    done = write_containers(str(tmp_path), segments, tracks, given.unionByName(given).repartition(7), repeated=True)
    assert sorted((d[0], d[2]) for d in done) == [("/in/a.mkv", 63), ("/in/b.mkv", 4)] and all(os.path.getsize(d[1]) == d[3] for d in done)
    got = [r[5:9] for r in Container(str(tmp_path / "in" / "a.mkv")).blocks()]
    want = [(r["track_number"], r["timecode_ms"], bool(r["keyframe"]), bytes(r["data"] or b"")) for r in given.where("path = '/in/a.mkv'").orderBy("block_seq").collect()]
    assert got == want


def test_blocks_in_bulk_are_cut_into_the_same_clusters():
    import random

    rnd = random.Random(5)
    for scale in (1_000_000, 1, 7, 3_000, 999_983, 40_000_000_000):
        rows, at = [], 0
        for _ in range(400):
            at = max(0, at + rnd.choice([0, 1, 40, 999, 1000, 33, -1, -40, -1200]))
            rows.append((rnd.choice([1, 126, 127, 300]), at, rnd.random() < 0.1, bytes(rnd.choice([0, 1, 122, 123, 200]))))
        # As the format has it: a cluster ends a second after its first block, or where a time doesn't fit 16 bits.
        cuts, first = [], None
        for i, (_, ms, *_) in enumerate(rows):
            if first is None or ms - first >= 1000 or not -32768 <= ms * 1_000_000 // scale - first * 1_000_000 // scale <= 32767:
                cuts, first = [*cuts, i], ms
        bulk, single = ContainerWriter(io.BytesIO(), scale), ContainerWriter(io.BytesIO(), scale)
        for w in (bulk, single):
            w.start(metadata_parts({"timecode_scale": scale}))
        bulk.blocks(rows[:150])
        bulk.blocks(rows[150:])
        for r in rows:
            single.block(*r)
        assert bulk.finish() == single.finish() and bulk.out.getvalue() == single.out.getvalue()
        c = Container("x", f=io.BytesIO(bulk.out.getvalue()))
        starts = [r[3] for r in c.blocks()]
        assert [i for i, s in enumerate(starts) if i == 0 or s != starts[i - 1]] == cuts
        assert [(r[5], r[7], r[8]) for r in c.blocks()] == [(t, k, d) for t, _, k, d in rows]


def test_structs_are_taken_apart_as_to_pylist_does():
    import pyarrow as pa

    from cuewright.sources.container_sink import _plain

    item = pa.struct([("i", pa.int32()), ("s", pa.string()), ("b", pa.binary()), ("k", pa.bool_()), ("f", pa.float64()), ("d", pa.decimal128(20, 0))])
    rows = [None, [], [{"i": 1, "s": "x", "b": b"y", "k": True, "f": 0.5, "d": Decimal(3)}, {"i": None, "s": None, "b": None, "k": None, "f": None, "d": None}], [{"i": 2**31 - 1, "s": "", "b": b"", "k": False, "f": -1.0, "d": Decimal(10**19)}]]
    whole = pa.array(rows * 3, pa.list_(item))
    for a in (whole, whole.slice(2, 5), whole.slice(3), pa.array([None, 2**60 + 1], pa.int64()), pa.array([True, None]), pa.array([[1, None], None, [2**60 + 1]])):
        assert _plain(a) == a.to_pylist()


def test_many_files_make_few_tasks(monkeypatch):
    """Starting a task costs as much as reading some hundred small files."""
    from cuewright.sources import container_source as R

    for n, least, most in ((700, 2, 2), (20_000, 40, 41), (160_000, 60, 70), (600_000, 146, 160)):
        monkeypatch.setattr(R, "list_files", lambda path, n=n: [(f"{path}/{i}", 2000) for i in range(n)])
        parts = R.ContainerReader(None, {"path": "/x", "table": "tracks"}).partitions()
        assert least <= len(parts) <= most and [p[0] for x in parts for p in x.pieces] == [f"/x/{i}" for i in range(n)]


@pytest.mark.parametrize("table", ["seeks", "tags", "blocks", "segments", "simple_tags", "tracks"])
def test_small_files_share_a_task(spark, tmp_path, table):
    """One task a file takes longer to start than to read it; a broken file among them takes only its own rows away."""
    n = 700
    info = metadata_parts({"title": "t"}, [{"track_index": 0, "track_id": 1, "type": "video", "codec": "h264", "track_uid": 5}], tags=[{"tag_index": 0, "target_type": "TRACK"}], simple_tags=[{"tag_index": 0, "node": 0, "name": "A", "value": "x"}])
    for i in range(n):
        with open(tmp_path / f"{i:03}.mkv", "wb") as f:
            w = ContainerWriter(f)
            w.start(info)
            w.block(1, 0, True, b"x")
            w.finish()
    (tmp_path / "100.mkv").write_bytes(b"nothing of the kind")
    df = read_container(spark, str(tmp_path), table)
    assert df.rdd.getNumPartitions() == 2
    rows = df.groupBy(F.element_at(F.split("path", "/"), -1).alias("file")).count().collect()
    assert {r["file"] for r in rows} == {f"{i:03}.mkv" for i in range(n) if i != 100} and {r["count"] for r in rows} == {3 if table == "seeks" else 1}
