import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from billweave.plans import ORACLE, QUERIES


def canon(value):
    return None if isinstance(value, float) and math.isnan(value) else round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    result = con.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    want = sorted((tuple(canon(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(map(canon, r)) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows and any(v is not None for r in rows for v in r[1:])


def test_cells_one_a_line_come_back(spark, sf):
    """Every sound line of the delivered files is found again after it was written as one cell a text line."""
    from pyspark.sql import functions as F

    from billweave.operators import extraction as X
    from billweave.plans.core import _raw_cells

    lines = X.rows_to_lines(_raw_cells(spark, sf, "header", "line", "totals"), "source_name", "row_no", "cells")
    lines = lines.filter("quantity is not null and unit_price is not null and total is not null")
    name = F.regexp_replace("description", "[^A-Za-z ]", "x")
    want = lines.select("source_name", F.trim(F.regexp_replace(name, " +", " ")).alias("description"), *[F.col(c).cast("string").alias(c) for c in ("quantity", "unit_price", "total")])
    got = QUERIES["text_vertical_tables"](spark, sf)
    assert want.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_entry(spark, sf):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
