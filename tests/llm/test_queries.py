"""Registered queries at the smallest scale against their SQL."""

import os

import duckdb
import pytest

from larkspur.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted(str([r[i] for i in at]) for r in cur.fetchall())
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == want


def test_every_operator_is_registered():
    assert {int(k[2:].split("_")[0]) for k in queries.queries()} == set(range(1, 11))
