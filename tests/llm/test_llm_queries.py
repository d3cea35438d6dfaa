"""Every query of the subpackage on the smallest tables."""

import glob
import os

import duckdb
import pytest

from inkstream.llm.catalog import QUERIES, SQL

FOUND = {
    "p1_found": ["page_id", "field_name", "para_md5"],
    "p2_found": ["record_kind", "record_key", "para_no", "lang"],
    "p3_found": ["original_id", "article_id"],
    "p4_found": ["page_id", "line_no"],
    "p5_found": ["article_id_a", "article_id_b"],
    "p6_found": ["article_id", "field_name"],
    "p8_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id", "category"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    got = QUERIES[name](spark, data)
    if name in FOUND:
        assert got.columns == FOUND[name]
    rows = [tuple(r) for r in got.collect()]
    if name in FOUND:
        assert len(rows) == len(set(rows))
    if name in SQL:
        c = duckdb.connect()
        for p in glob.glob(f"{data}/*.parquet"):
            c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        want = c.execute(SQL[name])
        names = [x[0] for x in want.description]
        order = [names.index(x) for x in got.columns]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
