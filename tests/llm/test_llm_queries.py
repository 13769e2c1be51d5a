"""The registered queries on training text, on the smallest data: against SQL where there is some, else by what must hold."""

import glob
import os

import duckdb
import pytest

from tarnfall.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(DATA + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _norm(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [{c: r[c] for c in columns} for r in df.collect()]
    if name in queries.ORACLE:
        rel = db.sql(queries.ORACLE[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert sorted([_norm(r[c]) for c in columns] for r in rows) == sorted([_norm(r[k]) for k in at] for r in rel.fetchall())
        return
    pairs = [(r[columns[0]], r[columns[1]]) for r in rows] if name in ("p1_found", "p10_found") else []
    assert all(a < b for a, b in pairs) and len(set(pairs)) == len(pairs)
    count = lambda sql: db.sql(sql).fetchall()[0][0]
    if name in ("p10_texts", "p8_clean", "p10_classes"):
        assert len(rows) == count("SELECT count(*) FROM documents" + (" WHERE text IS NOT NULL" if name == "p10_classes" else ""))
    if name == "p6_pieces":
        assert rows and all(len(r[c]) <= 2000 for r in rows for c in columns if c in ("text", "content", "piece"))
        assert len({r["event_id"] for r in rows}) == count("SELECT count(DISTINCT id) FROM knowledge_event WHERE length(content) > 2000")
    if name == "p9_shares":
        assert abs(sum(r["actual_share"] for r in rows) - 1) < 1e-4 and all((r["most_repeats"] or 0) <= r["max_repeats"] for r in rows)
