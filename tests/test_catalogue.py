"""Every registered query against its DuckDB SQL on the same tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from furlong.plans.catalogue_pipeline import QUERIES, SQL

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple("null" if pd.isna(v) else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool | np.bool_) else str(v)[:10] if hasattr(v, "year") else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = con.execute(SQL[name]).df()
    (a, x), (b, y) = rows(got), rows(want)
    assert a == b and len(x) == len(y)
    assert x == y, next((p, q) for p, q in zip(x, y, strict=True) if p != q)
