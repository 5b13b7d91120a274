"""Every registered core query against its SQL on the smallest tables, where they are there."""

import os

import pytest

from ctxloom.queries import core

DIR = "/root/testdata/sf0.001"
REG = core()


def rows(df):
    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or str(v) in ("NaT", "<NA>", "nan"):
            return "-"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(REG.sql))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    got, want = REG.plans[name](spark, DIR).toPandas(), con.execute(REG.sql[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert rows(got) == rows(want)


def test_names_are_unique_and_sql_has_plans():
    assert set(REG.sql) <= set(REG.plans)
