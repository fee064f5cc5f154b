"""Every query of the engine against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from eventloom.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, (list, np.ndarray)):
        return repr(list(v))
    if pd.isna(v):
        return "null"
    if hasattr(v, "year"):
        return str(v)[:10]
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) else str(v)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def test_every_query_has_its_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, D).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_fitted_persistence_equals_least_squares(spark):
    from eventloom.functions.signals import DIMENSIONS
    from eventloom.plans.strategy import attributions

    rows = attributions(spark, D).where("fwd_5d is not null and return_pct <> 0").toPandas()
    x, y = rows[[f"w_{k}" for k in DIMENSIONS]].to_numpy(float), (np.sign(rows["return_pct"]) * rows["fwd_5d"]).to_numpy(float)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    got = {r.dimension: r.persistence for r in catalog.queries()["E18_persistence"](spark, D).collect()}
    assert np.allclose([got[k] for k in DIMENSIONS], np.clip(beta / np.abs(beta).max(), -1, 1), atol=1e-6)
