"""Every query against its SQL twin on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from kelda.plans.all import catalogs

QUERIES = {n: f for c in catalogs for n, f in c.queries.items()}
SQL = {n: s for c in catalogs for n, s in c.sql.items()}


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(name, spark, data, con):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    out = con.execute(SQL[name])
    there = [x[0] for x in out.description]
    assert sorted(there) == columns
    want = sorted(tuple(plain(r[there.index(c)]) for c in columns) for r in out.fetchall())
    assert got == want


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_chunks_run(spark, data):
    assert QUERIES["document_chunks"](spark, data).count() > 0


def test_mask_reads_every_notation(spark, data):
    """Versions whose days are not in ISO form are masked like others, not dropped."""
    rows = spark.read.parquet(f"{data}/registration_versions.parquet")
    odd = rows.where("NOT effective_date RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' AND posted_date <= '2018-01-01'")
    ids = {r.reg_id for r in odd.collect()}
    assert ids and ids <= {r.reg_id for r in QUERIES["availability_mask_all"](spark, data).collect()}


def test_fifty_splits(spark, data):
    assert QUERIES["split_half_fifty"](spark, data).count() == 50
