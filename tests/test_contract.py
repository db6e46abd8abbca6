import duckdb
import pytest

import __spark_entry__ as E


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["latest_ratios", "related_documents", "category_argmax", "vector_neighbours", "table_row_chunks", "trend_by_company"])
def test_sql_agrees(spark, small, name):
    import os

    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"create view {f[:-8]} as select * from '{small}/{f}'")
    df = E.queries()[name](spark, small)
    cols = sorted(df.columns)
    rel = con.sql(E.oracle_sql()[name])
    assert cols == sorted(rel.columns)
    key = lambda v: None if v is None else round(v, 4) if isinstance(v, float) else str(v)
    a = sorted([tuple(key(r[c]) for c in cols) for r in df.collect()], key=repr)
    b = sorted([tuple(key(x[rel.columns.index(c)]) for c in cols) for x in rel.fetchall()], key=repr)
    assert a == b


def test_core_does_not_need_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['ledgerlens.llm'] = None\nimport __spark_entry__ as e\nassert e.llm_queries is None and 'p2_found' in e.queries() and 'p1_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=E.__file__.rsplit("/", 1)[0])
