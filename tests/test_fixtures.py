"""Layer 2: hand-made frames with the edge cases listed in FIXTURES.md section 3."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import acquisition as acq
from tidepool.operators import metrics as mt
from tidepool.operators import reshape as rs
from tidepool.operators import selection as sel
from tidepool.operators.split import greedy_group_fill, split_by_group
from tidepool.sources.io import normalize_missing


def test_cells_tiny_ingest_melt_and_dropna(spark):
    rows = [(1, 1.0, 0.0), (2, None, 1.0), (3, float("nan"), -1.0), (4, None, None)]
    wide = spark.createDataFrame(rows, "id long, a double, b double")
    clean = normalize_missing(wide, ["a", "b"], sentinels=(-1.0,))
    got = {r["id"]: (r["a"], r["b"]) for r in clean.collect()}
    assert got[3] == (None, None) and got[2] == (None, 1.0)
    long = rs.melt_labels(clean, ["a", "b"])
    assert sorted((r["id"], r["task"]) for r in long.collect()) == [(1, "a"), (1, "b"), (2, "b")]
    # mask: unlabelled cells never chosen, even with the best score
    scores = spark.createDataFrame([(3, "a", 9.0), (1, "a", 0.5), (2, "b", 0.1)], "id long, task string, score double")
    top = sel.topk_cells(sel.mask_unlabelled(scores, long), 1).collect()
    assert (top[0]["id"], top[0]["task"]) == (1, "a")
    q = spark.createDataFrame([(2, "b", 1.0)], "id long, task string, y double")
    kept_all = sel.shrink_pool_wide(clean, q, ["a", "b"], how="all")
    assert sorted(r["id"] for r in kept_all.collect()) == [1]
    kept_any = sel.shrink_pool_wide(clean, q, ["a", "b"], how="any")
    assert sorted(r["id"] for r in kept_any.collect()) == [1]


def test_dups_keep_first(spark):
    df = spark.createDataFrame([("k", 2, 1.0), ("k", 1, 0.0), ("j", 5, 1.0)], "key string, ord int, y double")
    out = {r["key"]: r["y"] for r in rs.dedup_keep_first(df, ["key"], ["ord"]).collect()}
    assert out == {"k": 0.0, "j": 1.0}


def _packed(spark, rows):
    return spark.createDataFrame(rows, "id long, task string, ps array<double>")


def test_preds_const(spark):
    p = _packed(spark, [(1, "a", [0.3] * 20), (2, "a", [0.9] * 20)])
    bald = {r["id"]: r["score"] for r in acq.bald(p).collect()}
    assert all(abs(v) < 1e-9 for v in bald.values())
    g = {r["id"]: r["score"] for r in acq.greedy(p).collect()}
    u = {r["id"]: r["score"] for r in acq.ucb(p).collect()}
    assert all(abs(g[i] - u[i]) < 1e-12 for i in g)


def test_bald_nonnegative_on_random_preds(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "a", [float(x) for x in rng.uniform(0, 1, 20)]) for i in range(50)]
    vals = [r["score"] for r in acq.bald(_packed(spark, rows)).collect()]
    assert min(vals) >= -1e-9


def _epig_brute(P, Q):
    K = P.shape[1]
    out = []
    for a in P:
        s = 0.0
        for t in Q:
            J = (a * t).sum() / K
            I = a.mean() * t.mean()
            s += J * (math.log(J) - math.log(I)) if J > 0 else 0.0
        out.append(s / len(Q))
    return np.array(out)


def test_epig_paths_agree_and_can_be_negative(spark):
    K = 8
    base = np.linspace(0.1, 0.9, K)
    pool = [(1, "a", base.tolist()), (2, "a", base[::-1].tolist()), (3, "b", [0.5] * K)]
    targ = [(10, base.tolist()), (11, np.full(K, 0.4).tolist())]
    P = _packed(spark, pool)
    T = spark.createDataFrame(targ, "id long, ps array<double>")
    want = _epig_brute(np.array([r[2] for r in pool]), np.array([r[1] for r in targ]))
    for kw in ({}, {"target_block": 1, "pool_group": 1}):
        got = {r["id"]: r["score"] for r in acq.epig(P, T, **kw).collect()}
        assert np.allclose([got[1], got[2], got[3]], want, atol=1e-12)
    assert want[1] < 0  # anti-correlated pool cell: negative EPIG (kept, reported by the range check)
    chk = acq.score_range_check(acq.epig(P, T)).collect()[0]
    assert chk["n_bad"] >= 1


def test_ties_topk_deterministic(spark):
    s = spark.createDataFrame([(i, t, 1.0) for i in (3, 1, 2) for t in ("b", "a")], "id long, task string, score double")
    top = [(r["id"], r["task"]) for r in sel.topk_cells(s.repartition(3), 3).collect()]
    assert top == [(1, "a"), (1, "b"), (2, "a")]


def test_one_class_gives_null_metrics(spark):
    df = spark.createDataFrame([("x", 1.0, 0.2), ("x", 1.0, 0.7), ("z", 0.0, 0.1), ("z", 0.0, 0.4)],
                               "task string, y double, p double")
    rep = {r["task"]: r for r in mt.metrics_table(mt.threshold_curve(df)).collect()}
    for t in ("x", "z"):
        assert rep[t]["roc_auc"] is None and rep[t]["balanced_acc"] is None


def test_ece_bin_edges_follow_numpy(spark):
    ps = [0, 0.1, 0.3, 0.30000000000000004, 0.6, 0.7, 1]
    edges = np.linspace(0, 1, 11)[1:-1]
    assert list(np.digitize(ps, edges)) == [0, 1, 2, 3, 5, 6, 9]
    df = spark.createDataFrame([(float(p),) for p in ps], "p double")
    got = [r["bin"] for r in df.select("p", mt._bin_index([F.lit(e) for e in mt.ECE_EDGES]).alias("bin"))
           .orderBy("p").collect()]
    assert got == [0, 1, 2, 3, 5, 6, 9]


def test_groups_greedy_fill(spark):
    sizes = [5, 3, 3, 2, 1, 1]
    take = greedy_group_fill([(5, 1), (3, 2), (2, 1), (1, 2)], 9)
    assert take == {5: 1, 3: 1, 2: 0, 1: 1}
    rows = [(f"g{i}", j) for i, s in enumerate(sizes) for j in range(s)]
    df = spark.createDataFrame(rows, "g string, j int").withColumn("id", F.monotonically_increasing_id())
    out = split_by_group(df, "g", 9 / 15, seed=1)
    train = out.where("role = 'train'").count()
    assert train == 9
    per_group = out.groupBy("g").agg(F.countDistinct("role").alias("r")).collect()
    assert all(r["r"] == 1 for r in per_group)


def _metrics_brute(y, p):
    order = np.argsort(-p, kind="stable")
    thr = np.unique(p)[::-1]
    P, N = y.sum(), (1 - y).sum()
    tps = np.array([(y[p >= t]).sum() for t in thr])
    fps = np.array([((1 - y)[p >= t]).sum() for t in thr])
    tpr = np.r_[0, tps / P]
    fpr = np.r_[0, fps / N]
    auc = np.trapezoid(tpr, fpr)
    bacc = (tpr + (1 - fpr)) / 2
    i = int(np.argmax(bacc))
    prec = tps / (tps + fps)
    rec = tps / P
    last = int(np.searchsorted(tps, tps[-1]))
    pr_p = np.r_[prec[:last + 1][::-1], 1]
    pr_r = np.r_[rec[:last + 1][::-1], 0]
    aupr = -np.trapezoid(pr_p, pr_r)
    ap = -np.sum(np.diff(pr_r) * pr_p[:-1])
    f1 = max(2 * tp / (tp + fp + P) for tp, fp in zip(tps[:last + 1], fps[:last + 1]))
    del order
    return dict(roc_auc=auc, balanced_acc=bacc[i], sensitivity=tpr[i], specificity=1 - fpr[i],
                AUPR=aupr, average_precision=ap, f1_score=f1)


def test_threshold_metrics_match_brute_force(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 300).astype(float)
    p = np.round(rng.uniform(0, 1, 300) * 0.6 + y * 0.3, 2)
    df = spark.createDataFrame([("t", float(a), float(b)) for a, b in zip(y, p)], "task string, y double, p double")
    got = mt.metrics_table(mt.threshold_curve(df, blocks=4)).collect()[0]
    want = _metrics_brute(y, p)
    for k, v in want.items():
        assert abs(got[k] - v) < 1e-9, k


def test_ace_edges_are_linear_percentiles(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.uniform(0, 1, 101), 3)
    y = (rng.uniform(0, 1, 101) < p).astype(float)
    df = spark.createDataFrame([("t", float(a), float(b)) for a, b in zip(y, p)], "task string, y double, p double")
    edges = mt.quantile_edges(mt.threshold_curve(df)).collect()[0]["edges"]
    assert np.allclose(edges, np.percentile(p, np.linspace(0, 100, 11))[1:-1], atol=1e-12)
    bins = np.digitize(p, np.percentile(p, np.linspace(0, 100, 11))[1:-1])
    ace = sum((bins == b).sum() / len(p) * abs(y[bins == b].mean() - p[bins == b].mean())
              for b in range(10) if (bins == b).any())
    got = mt.ace(mt.threshold_curve(df)).collect()[0]["ACE"]
    assert abs(got - ace) < 1e-9


def test_epig_blocked_many_blocks_matches_brute_force(spark):
    # regression: cogroup keys of different integer types silently misrouted target blocks
    rng = np.random.default_rng(11)
    K = 7
    pool = [(i, "a" if i % 2 else "b", rng.uniform(0.05, 0.95, K).tolist()) for i in range(120)]
    targ = [(1000 + i, rng.uniform(0.05, 0.95, K).tolist()) for i in range(90)]
    P = _packed(spark, pool)
    T = spark.createDataFrame(targ, "id long, ps array<double>")
    want = _epig_brute(np.array([r[2] for r in pool]), np.array([r[1] for r in targ]))
    got = {r["id"]: r["score"] for r in acq.epig(P, T, target_block=7, pool_group=13).collect()}
    assert np.allclose([got[i] for i in range(120)], want, atol=1e-12)


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12)), min_size=4, max_size=60))
def test_threshold_metrics_property(spark, pairs):
    y = np.array([float(a) for a, _ in pairs])
    p = np.array([b / 12 for _, b in pairs])  # few distinct scores: many ties
    df = spark.createDataFrame([("t", float(a), float(b)) for a, b in zip(y, p)], "task string, y double, p double")
    got = mt.threshold_metrics(mt.threshold_curve(df, blocks=3)).collect()
    if y.min() == y.max():
        assert got[0]["roc_auc"] is None or got[0]["balanced_acc"] is None
        return
    want = _metrics_brute(y, p)
    for k, v in want.items():
        assert abs(got[0][k] - v) < 1e-9, (k, got[0][k], v)
