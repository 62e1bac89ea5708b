import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple("null" if v[i] is None else f"{float(v[i]):.6g}" if isinstance(v[i], (int, float)) and not isinstance(v[i], bool) else str(v[i]) for i in order) for v in values])


def test_every_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("events", "documents", "embeddings", "labels", "conversations"):
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert sql.keys() <= queries.keys()
    differ = []
    for name, text in sql.items():
        df = queries[name](spark, DATA)
        found = db.execute(text)
        columns = [c[0] for c in found.description]
        if sorted(df.columns) != sorted(columns) or rows(df.columns, df.collect()) != rows(columns, found.fetchall()):
            differ.append(name)
    assert not differ


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
