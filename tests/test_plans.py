"""Plan-shape guards: properties that must hold at any scale, checked on every registered query.

Plans of eager checkpoints inside a query are seen as well as the plan that is returned.
"""

import contextlib
import io
import re

import pytest

import __spark_entry__ as se
from tests.conftest import SF_SMALL
from tidepool import session
from tidepool.plans import registry

QUERIES = {k: v for k, v in se.queries().items() if k in registry.QUERIES}


def _formatted(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def plans_of(spark, name):
    seen = []
    session.CHECKPOINT_OBSERVERS.append(lambda df: seen.append(_formatted(df)))
    try:
        last = _formatted(QUERIES[name](spark, SF_SMALL))
    finally:
        session.CHECKPOINT_OBSERVERS.pop()
    return seen + [last]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_joins_and_pruned_scans(spark, name):
    for plan in plans_of(spark, name):
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan
        # every scan reads fewer columns than the widest driver table has (column pruning reached the scan)
        for cols in re.findall(r"ReadSchema: struct<(.*)>", plan):
            assert len(re.findall(r"[a-z_0-9]+:", cols)) <= 6, cols


def _scans(plans, table):
    return sum(len(re.findall(rf"Location: .*{table}\.parquet", p)) for p in plans)


def test_rows_are_exchanged_once_for_a_split(spark):
    plan = plans_of(spark, "split_random")[-1]
    keys = re.findall(r"Arguments: hashpartitioning\(([^)]*)\)", plan)
    # the rows and their block counts meet on (key, block); nothing else moves rows
    assert all("_bkt" in k or k.startswith("_key") for k in keys), keys
    assert sum("_bkt" in k for k in keys) <= 3


def test_roles_and_class_sums_are_computed_once(spark):
    assert _scans(plans_of(spark, "shrink_pool"), "embeddings") <= 12
