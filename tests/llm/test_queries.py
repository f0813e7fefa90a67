import os

import pytest

from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["memory_id", "defect"], "p2_found": ["memory_id", "field", "pii_type", "pii_text"], "p3_found": ["tool", "native_id", "msg_index", "speaker", "memory_id"], "p4_found": ["memory_id", "field"],
    "p5_found": ["session_id_a", "session_id_b"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "subject"],
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    # ten labelled documents are too few for subjects
    assert (rows or name == "p8_found") and len(rows) == len({str(r) for r in rows})


def test_conversations_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("memories", "sessions", "filtered_turns"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES["p3_found"])
    names = [x[0] for x in cur.description]
    want = sorted(tuple(r) for r in cur.fetchall())
    assert sorted(tuple(r) for r in QUERIES["p3_found"](spark, SF).select(*names).collect()) == want


@pytest.mark.parametrize("name", ["p4_found", "p4_shares", "p4_clusters"])
def test_shared_spans_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view filtered_turns as select * from '{SF}/filtered_turns.parquet'")
    cur = con.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    want = sorted(tuple(r) for r in cur.fetchall())
    assert want and sorted(tuple(r) for r in QUERIES[name](spark, SF).select(*names).collect()) == want
