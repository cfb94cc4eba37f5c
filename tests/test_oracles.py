"""Every registered query with an oracle gives DuckDB's rows on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "null"
    return f"{float(v):.8g}" if isinstance(v, (float, np.floating)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf_dir, duck, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(ORACLES[name]).df())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["lang", "route", "n_docs"] and out.count() > 0


@pytest.mark.parametrize("name", ["r1_detect_candidates", "r3_adjust_confidence", "r5_reject_false_numbers", "r6_resolve_overlaps", "r7_reconcile_repeats"])
def test_redaction_steps_run(spark, sf_dir, name):
    assert "entity_type" in QUERIES[name](spark, sf_dir).columns
