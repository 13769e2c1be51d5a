"""Every core query that SQL can express, against DuckDB on the smallest data."""

import glob
import os

import duckdb
import pytest

from tarnfall.plans import catalogue

DATA = "/root/testdata/sf0.001"
MODULES = catalogue.modules()
PAIRS = [(m, n) for m in MODULES for n in m.QUERIES]


#: Queries that SQL can't give, and where their operators are tested.
ELSEWHERE = {
    "p2_found": "test_problems", "p2_node_types": "test_problems", "p2_tool_calls": "test_problems", "t2_folded_names": "test_cases", "t3_edit_distance": "test_whole", "t14_thinking_found": "test_whole", "t17_middle_cut": "test_cases", "r18_citations": "test_cases",
    "t16_folded_lines": "test_cases", "t19_title_keywords": "test_cases", "t22_slug": "test_whole", "n3_compact": "test_cases", "n4_tables": "test_cases", "n5_snake_keys": "test_cases", "n7_canonical": "test_cases",
    "t12_first_object": "test_problems", "r1_chunks": "test_cases", "a8_all_terms": "test_whole", "a8_term_documents": "test_whole", "g1_limited": "test_cases", "m4_chosen_hops": "test_cases", "m6_limited": "test_cases",
    "m7_trace": "test_queries", "m9_closed_hyperedges": "test_whole", "m11_activated_events": "test_cases", "j14_topic_matches": "test_cases", "t13_cited_names": "test_cases", "r13_histograms": "test_cases",
    "r14_byte_vectors": "test_cases", "t10_mentions": "test_cases", "i1_extracted_events": "test_cases", "t11_answers": "test_cases",
}


def norm(x):
    if isinstance(x, float):
        return f"{x:.6g}"
    if isinstance(x, (list, tuple)):
        return [norm(y) for y in x]
    return x.isoformat()[:19] if hasattr(x, "isoformat") else str(x)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(DATA + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("module,name", PAIRS, ids=[n for _, n in PAIRS])
def test_query(spark, db, module, name):
    df = module.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [[r[c] for c in columns] for r in df.collect()]
    assert (name in module.ORACLE) != (name in ELSEWHERE)
    if name == "m7_trace":
        assert [r[0][:2] for r in rows] == [f"{k} " for k in range(1, 9)]
    if name in module.ORACLE:
        rel = db.sql(module.ORACLE[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert sorted(repr(norm(r)) for r in rows) == sorted(repr(norm([r[k] for k in at])) for r in rel.fetchall())
