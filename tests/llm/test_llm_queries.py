"""Every registered text query runs on the smallest tables; distinct rows, stable columns, SQL where there is any."""

import glob
import os

import duckdb
import pytest

from cuewright.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["source", "path", "first_seq", "last_seq"],
    "p3_found": ["source", "record_id", "lang_code"],
    "p5_found": ["source", "path", "pos"],
    "p6_found": ["source", "path", "seq"],
    "p8_ids": ["doc_id", "ids"],
    "p10_found": ["doc_id"],
}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


def canonical(v):
    return "~" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(canonical(v) for v in r) for r in df.collect()]
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(rows) == len(set(rows))
    if name in SQL:
        con = duckdb.connect()
        for f in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        res = con.execute(SQL[name])
        order = [[c[0] for c in res.description].index(c) for c in df.columns]
        assert sorted(rows) == sorted(tuple(canonical(r[i]) for i in order) for r in res.fetchall())
