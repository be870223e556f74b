"""Every registered query beside its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(cols, values):
    at = [cols.index(c) for c in sorted(cols)]
    return sorted((tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in values), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_and_sql(spark, sf_dir, duck, name):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    cur = duck.execute(__spark_entry__.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, cur.fetchall())


def test_entry(spark):
    if not os.path.isdir(__spark_entry__.SMOKE_DIR):
        pytest.skip("no test tables")
    assert __spark_entry__.entry(spark).columns


def test_importance_pipeline_fits_its_budget(spark, sf_dir):
    got = __spark_entry__.queries()["importance_pipeline"](spark, sf_dir).collect()
    assert got and sum(r.token_estimate for r in got) <= 4096 and sorted(r.place for r in got) == list(range(1, len(got) + 1))
