import random

from cuewright.operators.blocks import backward_timecodes, cues, greedy_clusters
from cuewright.streaming.clusters import cluster_stream, cue_stream, on_progress, windowed_counts

SCHEMA = "path string, block_seq long, track_number long, timecode_ms long, keyframe boolean"


def rows():
    rnd, out = random.Random(4), []
    for path in ("a", "b"):
        t = 0
        for i in range(1, 161):
            t = max(0, t + rnd.choice([0, 60, 300, 700, -1200]))
            out.append((path, i, 1 + i % 2, t, rnd.random() < 0.1))
    return out


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    data = rows()
    for k in range(4):
        part = [r for r in data if 40 * k < r[1] <= 40 * (k + 1)]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    files = str(tmp_path / "in" / "p*")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(files)
    seen = []
    listener = on_progress(spark, lambda n, total: seen.append(n))
    got = run(cluster_stream(stream), "clusters")
    spark.streams.removeListener(listener)
    batch = spark.createDataFrame(data, SCHEMA)
    clustered = greedy_clusters(batch)
    assert {(r["path"], r["block_seq"], r["cluster_ms"]) for r in got} == {(r["path"], r["block_seq"], r["cluster_ms"]) for r in clustered.collect()}
    assert {(r["path"], r["block_seq"]) for r in got if r["went_backwards"]} == {(r["path"], r["block_seq"]) for r in backward_timecodes(batch).collect()}
    # The stage of cues in a query of its own, as a stream of the clusters.
    spark.createDataFrame(got).coalesce(1).write.parquet(str(tmp_path / "clustered"))
    c = spark.readStream.schema(spark.read.parquet(str(tmp_path / "clustered")).schema).parquet(str(tmp_path / "clustered"))
    found = {tuple(r) for r in run(cue_stream(c), "cues")}
    want = {tuple(r) for r in cues(clustered).collect()}
    last = {p: max(r["cluster_ms"] for r in got if r["path"] == p) for p in "ab"}
    assert found <= want and all(w in found or w[1] == last[w[0]] for w in want)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_windows(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 59), ("a", 2, 61), ("a", 1, 300)], "path string, track_number long, s long").selectExpr("path", "track_number", "timestamp_seconds(s) as ts")
    df.coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "w"))
    got = run(windowed_counts(stream, "ts"), "windows")
    assert {(r["start"].minute, r["track_number"], r["n_blocks"]) for r in got} >= {(0, 1, 2), (1, 2, 1)}


def test_idle_paths_are_forgotten(spark, tmp_path):
    import time

    schema = "path string, block_seq long, track_number long, timecode_ms long, keyframe boolean"
    source = str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    put([("a", 1, 1, 5000, True)])
    # With timeouts Spark runs batches without data for ever, and waiting for the last of them never ends.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = cluster_stream(spark.readStream.schema(schema).parquet(source), idle_ms=300).writeStream.format("memory").queryName("idle").outputMode("append").start()
    q.processAllAvailable()
    time.sleep(0.8)
    put([("b", 1, 1, 0, True)])  # a batch in which the idle path times out
    q.processAllAvailable()
    time.sleep(0.5)
    put([("a", 2, 1, 5100, True), ("b", 2, 1, 100, False)])
    q.processAllAvailable()
    q.stop()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = {(r["path"], r["block_seq"]): (r["cluster_ms"], r["went_backwards"]) for r in spark.sql("select * from idle").collect()}
    assert got[("a", 1)][0] == 5000 and got[("a", 2)][0] == 5100
