"""A sample of registered queries against their SQL answers; tools/check.py runs all of them."""
import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["FEA-9", "FEA-21", "FEA-24", "FEA-37", "WIN-9", "LBL-1", "REG-2", "AGG-11", "BT-6", "BT-9", "VAL-9", "DQ-5", "JN-3b", "JN-9", "TOP-5", "STAT-3", "RSK-8", "ML-5b", "STF-8"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("key", SAMPLE)
def test_query_matches_sql(spark, sf, con, key):
    got = entry.queries()[key](spark, sf).toPandas()
    want = con.sql(entry.oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    order = [c for c in cols if not pd.api.types.is_float_dtype(got[c])] or cols
    a = got[cols].sort_values(order, kind="stable").reset_index(drop=True)
    b = want[cols].sort_values(order, kind="stable").reset_index(drop=True)
    for c in cols:
        if pd.api.types.is_numeric_dtype(a[c]) and not pd.api.types.is_bool_dtype(a[c]):
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-6, atol=1e-6, equal_nan=True), c
        else:
            assert a[c].astype(str).replace("None", "nan").tolist() == b[c].astype(str).replace("None", "nan").tolist(), c
