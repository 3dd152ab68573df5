"""Stratified and multilabel splits on sparse labels: brute force, shares, balance, skew."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidepool.operators import ranking as rk
from tidepool.operators import split as sp

TASKS = [f"t{i:02d}" for i in range(12)]


def h52(seed, key):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:13], 16)


@pytest.fixture(scope="module")
def sparse(spark):
    """8,000 rows, 12 tasks, 20 % gaps; 7 % positives on the whole, from 1 % to 13 % by task."""
    rnd = random.Random(11)
    rows = []
    for i in range(8000):
        ys = [None if rnd.random() < .2 else float(rnd.random() < .01 * (t + 1)) for t in range(12)]
        rows.append((i, *ys))
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{t} double" for t in TASKS)).repartition(6)
    return rows, df


def positives(rows):
    return {t: [r[0] for r in rows if r[i + 1] == 1] for i, t in enumerate(TASKS)}


def strata_key(row, order):
    cols = {t: row[i + 1] for i, t in enumerate(TASKS)}
    return ("".join("0" if cols[t] == 1 else "1" for t in order) + "|" + "".join("1" if cols[t] is None else "0" for t in order))


@pytest.mark.parametrize("frac", [0.8, 0.85])
def test_sparse_split_keeps_its_share_and_equals_brute_force(sparse, frac):
    rows, df = sparse
    pos = positives(rows)
    order = sorted(TASKS, key=lambda t: (len(pos[t]), t))
    assert sp.label_order(df, TASKS) == order
    got = {r["id"]: r["role"] for r in sp.split_multilabel(df, TASKS, frac, 7).select("id", "role").collect()}
    ordered = sorted(rows, key=lambda r: (strata_key(r, order), h52(7, r[0]), r[0]))
    want = {r[0]: "train" if int(frac * (g + 1)) > int(frac * g) else "test" for g, r in enumerate(ordered)}
    assert got == want
    train = {i for i, role in got.items() if role == "train"}
    assert len(train) == int(frac * len(rows))
    for t in TASKS:  # every task's positives keep the share too
        assert abs(len(train & set(pos[t])) - frac * len(pos[t])) <= 5, t


def test_every_stratum_gives_its_share_within_one_row(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "b", None, "c"] + ["hot"] * 6), rnd.randrange(3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, s string, u int")
    out = sp.split_stratified(df, ["s", "u"], 0.85, 3, roles=("pool", "val"))
    n = Counter((r["s"], r["u"]) for r in out.collect())
    took = Counter((r["s"], r["u"]) for r in out.where("role = 'pool'").collect())
    assert all(abs(took[k] - 0.85 * n[k]) < 1 for k in n)
    assert sum(took.values()) == int(0.85 * 3000)
    again = sp.split_stratified(df.repartition(5), ["s", "u"], 0.85, 3, roles=("pool", "val"))
    assert {r["id"]: r["role"] for r in again.collect()} == {r["id"]: r["role"] for r in out.collect()}


def brute_folds(rows, k, seed):
    pos = positives(rows)
    order = sorted(TASKS, key=lambda t: (len(pos[t]), t))
    has = {r[0]: [t for t in order if r[TASKS.index(t) + 1] == 1] for r in rows}
    sizes, have, fold = [0] * k, defaultdict(lambda: [0] * k), {}
    for t in [*order, None]:
        own = [r for r in rows if (has[r[0]][0] if has[r[0]] else None) == t]
        own.sort(key=lambda r: (strata_key(r, order), h52(seed, r[0]), r[0]))
        first = sorted(range(k), key=lambda f: ((have[t] if t else sizes)[f], sizes[f], f))  # order of the round
        count = list(have[t] if t else sizes)
        for r in own:
            f = min(first, key=lambda f: (count[f], first.index(f)))
            count[f] += 1
            fold[r[0]] = f
            for x in has[r[0]]:
                have[x][f] += 1
        for r in own:
            sizes[fold[r[0]]] += 1
    return fold


@pytest.mark.parametrize("k", [2, 5])
def test_iterative_folds_equal_brute_force_and_differ_by_one(sparse, k):
    rows, df = sparse
    got = {r["id"]: r["fold"] for r in sp.kfold_multilabel(df, TASKS, k, 42).select("id", "fold").collect()}
    assert got == brute_folds(rows, k, 42)
    for t, ids in positives(rows).items():
        per_fold = Counter(got[i] for i in ids)
        assert max(per_fold.values()) - min(per_fold.get(f, 0) for f in range(k)) <= 1, t
    sizes = Counter(got.values())
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_fill_order_evens_out():
    rnd = random.Random(1)
    for _ in range(200):
        k = rnd.randrange(1, 7)
        have = [rnd.randrange(6) for _ in range(k)]
        sizes = [rnd.randrange(20) for _ in range(k)]
        n = rnd.randrange(40)
        count, start = list(have), 0
        order = sorted(range(k), key=lambda f: (have[f], sizes[f], f))
        for upto, folds in sp.fill_order(have, sizes, n):
            for i in range(start, upto):
                f = folds[(i - start) % len(folds)]
                assert f == min(order, key=lambda g: (count[g], order.index(g)))
                count[f] += 1
            start = upto
        assert start == n and sum(count) == sum(have) + n


def test_folds_without_rows_or_positives(spark):
    empty = spark.createDataFrame([], "id long, a double, b double")
    assert sp.kfold_multilabel(empty, ["a", "b"], 3).count() == 0
    assert sp.split_multilabel(empty, ["a", "b"]).count() == 0
    flat = spark.createDataFrame([(i, None, 0.0) for i in range(10)], "id long, a double, b double")
    sizes = Counter(r["fold"] for r in sp.kfold_multilabel(flat, ["a", "b"], 3).collect())
    assert sorted(sizes.values()) == [3, 3, 4]


def test_ordered_rank_spreads_a_hot_prefix(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("s"))
    out = rk.ordered_rank(df, ["s", "id"], blocks=8)
    want = {r[0]: i + 1 for i, r in enumerate(sorted(((r["id"], r["s"]) for r in df.collect()), key=lambda r: (r[1], r[0])))}
    assert {r["id"]: r["_rn"] for r in out.collect()} == want
    per_task = out.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert per_task < 5000 / 4


def test_existing_split_rejects_an_id_on_both_sides(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(3,), (2,)], "id long")
    with pytest.raises(sp.OverlapError, match="2"):
        sp.split_existing(a, b)
    assert sp.split_existing(a, b.where("id = 3")).count() == 3
