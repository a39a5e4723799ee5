"""Every query against its SQL on the smallest tables, and the plans that matter."""

import numbers
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from sheetwright.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, (numbers.Number, Decimal)) and not isinstance(v, (bool, np.bool_)) else str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(cell(v) for v in row) for row in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, db, small, name):
    got, want = catalogue.QUERIES[name](spark, small).toPandas(), db.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_others_run(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_plans(spark, small):
    narrow = plan(catalogue.normalize_account(spark, small))
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in narrow
    assert "PushedFilters: [" in plan(catalogue.record_selector(spark, small)) and "GreaterThanOrEqual(o_orderkey" in plan(catalogue.record_selector(spark, small))
    rollup = plan(catalogue.decision_rollup(spark, small))
    assert "CartesianProduct" not in rollup and "Python" not in rollup
    # Name similarity sees name rows only: the filter stands below the Python node.
    assert "ArrowEvalPython" in plan(catalogue.name_similarity(spark, small))
