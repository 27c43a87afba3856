from pathlib import Path

import pytest

from .oracle import compare, views

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_queries_agree_with_their_sql(spark):
    import __spark_entry__ as e

    con, sql = views(DATA), e.oracle_sql()
    assert e.entry(spark).columns == ["table_path", "id", "gender", "age", "_commit_version"]
    assert set(sql) <= set(e.queries())
    bad = {n: r for n, q in e.queries().items() if "MISMATCH" in (r := compare(spark, con, n, q, sql.get(n), DATA))}
    assert not bad
