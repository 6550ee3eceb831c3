"""Every registered query runs on the smallest tables and agrees with its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = {name: f for m in entry._CORE for name, f in m.QUERIES.items()}
CORE_SQL = {name: s for m in entry._CORE for name, s in m.SQL.items()}


def canonical(v):
    if v is None or v != v:
        return "~"
    return repr(round(v, 6)) if isinstance(v, float) else v.hex() if isinstance(v, (bytes, bytearray)) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    df = CORE[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name in CORE_SQL:
        res = duck.execute(CORE_SQL[name])
        columns = [c[0] for c in res.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(columns, res.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"path", "check_id", "severity", "message"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_attachments_are_written_for_their_queries_alone(spark, tmp_path):
    os.symlink(SF, tmp_path / "d")
    d, sc = str(tmp_path / "d"), spark.sparkContext
    CORE["file_tags"](spark, d).collect()
    assert not os.path.exists(sc._cuewright_files[d] + "-attached") and d not in getattr(sc, "_cuewright_attached", {})
    assert CORE["file_attachments"](spark, d).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_tags_of_files_come_from_one_pass_over_the_tracks(spark):
    from cuewright.plans import file_queries as Q

    tags, simple = Q._tag_frames(Q._tracks(spark, SF))
    plan = simple._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation") == 1
    assert simple.count() == 2 * tags.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_blocks_of_small_files_are_scanned_once(spark, monkeypatch):
    from cuewright.plans import file_queries as Q

    given, read = [], Q.read_container
    monkeypatch.setattr(Q, "read_container", lambda *a, **options: given.append(options) or read(*a, **options))
    whole = CORE["file_blocks"](spark, SF)
    assert [o.get("minBytes", 0) > 1 << 20 for o in given] == [False, True]
    # Numbers carried over many chunks are those of one.
    cut = Q._numbered_in_files(lambda **options: Q._scan(spark, SF, "blocks", **options), chunk=300).select("path", "n", "track_number", "timecode_ms")
    assert rows_of(cut.columns, cut.collect()) == rows_of(cut.columns, whole.select(*cut.columns).collect()) != []
