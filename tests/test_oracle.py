"""Layer 1: every registered query against its DuckDB twin on the same Parquet tables."""

import math

import pytest

import __spark_entry__ as se
from tidepool.plans import registry
from tests.conftest import SF_SMALL

QUERIES = {k: v for k, v in se.queries().items() if k in registry.QUERIES}  # tests/llm has those of tidepool.llm
ORACLE = {k: v for k, v in se.oracle_sql().items() if k in registry.QUERIES}


def _norm(v):
    import pandas as pd
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        v = int(v)
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_every_inventory_key_registered():
    assert len(QUERIES) >= 74
    missing = set(QUERIES) - set(ORACLE)
    assert missing == set()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLE[name]).df()
    c1, r1 = _rows(got)
    c2, r2 = _rows(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


@pytest.mark.parametrize("name", ["train_surrogate"])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.columns == ["id", "task", "score"]
    assert df.count() == 10
