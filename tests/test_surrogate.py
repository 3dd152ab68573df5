"""The joint logistic fit against a Newton solution in NumPy, and draws in one scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import sampling as smp
from tidepool.operators import scoring as sc
from tidepool.functions.hashing import hash52

REG = 0.01


def _data(n=400, width=12, seed=4):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, width)) * rng.uniform(0.2, 2.0, width)
    y = {}
    for t, (noise, share, gaps) in {"a": (1.0, 0.5, 0.0), "b": (0.05, 0.1, 0.5), "c": (3.0, 0.9, 0.9)}.items():
        z = X @ rng.normal(size=width) + noise * rng.normal(size=n)
        y[t] = np.where(rng.random(n) < gaps, np.nan, (z > np.quantile(z, 1 - share)).astype(float))
    return X, y


def _gradient(X, y, w, b):
    seen = ~np.isnan(y)
    X, y = X[seen], y[seen]
    c = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    p = 1 / (1 + np.exp(-(X @ w + b)))
    r = c * (p - y) / c.sum()
    return np.append(X.T @ r + REG * w, r.sum()), (X, c / c.sum(), p)


def _newton(X, y):
    v = np.zeros(X.shape[1] + 1)
    for _ in range(60):
        g, (Xs, c, p) = _gradient(X, y, v[:-1], v[-1])
        A = np.column_stack([Xs, np.ones(len(Xs))])
        H = A.T @ (A * (c * p * (1 - p))[:, None]) + REG * np.diag([1.0] * X.shape[1] + [0.0])
        step = np.linalg.solve(H, g)
        v -= step * min(1.0, 2 / np.linalg.norm(step))
    return v


def test_all_tasks_in_one_fit_equal_newton(spark):
    X, y = _data()
    feats = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, x array<double>").repartition(5)
    cells = [(i, t, None if np.isnan(v) else float(v)) for t in y for i, v in enumerate(y[t])]
    cells += [(i, "single", 1.0) for i in range(20)] + [(10_000, "a", 1.0)]   # one class; a key without features
    got = {r["task"]: r for r in sc.train_surrogate(spark.createDataFrame(cells, "id long, task string, y double"), feats, reg=REG).collect()}
    assert set(got) == {"a", "b", "c", "single"}
    assert got["single"]["bias"] == 0.0 and set(got["single"]["w"]) == {0.0}
    for t in y:
        w, b = np.array(got[t]["w"]), got[t]["bias"]
        g, _ = _gradient(X, y[t], w, b)
        assert np.linalg.norm(g) < 1e-6, t
        want = _newton(X, y[t])
        assert np.abs(np.append(w, b) - want).max() < 1e-4, t


def test_features_are_not_copied_per_task(spark):
    X, y = _data(50, 3)
    feats = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, x array<double>")
    cells = spark.createDataFrame([(i, t, float(v)) for t in "ab" for i, v in enumerate(y["a"])], "id long, task string, y double")
    assert sc.labelled_rows(cells, feats, ["a", "b"]).count() == 50


def test_a_fit_that_cannot_end_raises(spark):
    X, y = _data(80, 5)
    feats = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, x array<double>")
    cells = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(y["a"])], "id long, task string, y double")
    with pytest.raises(RuntimeError, match="converged"):
        sc.train_surrogate(cells, feats, max_iter=2)
    assert sc.train_surrogate(cells.limit(0), feats).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_lowest_per_class_equals_a_window(spark, parts):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")  # many batches a task
    rows = [(i, None if i % 11 == 0 else f"c{i % 3 % 2}", float(i % 2)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, c string, y double").withColumn("_h", F.pmod(hash52(1, "id"), F.lit(50)))
    got = smp.lowest_per_class(df.repartition(parts), ["c", "y"], "_h", "id", 9)
    from pyspark.sql import Window
    w = Window.partitionBy("c", "y")
    want = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy("_h", "id"))) \
        .where("r <= 9").drop("r")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # rows are not exchanged: only what the map tasks hand on
    assert "MapInArrow" in got._jdf.queryExecution().toString()


def test_draws_of_no_row_and_of_no_class(spark):
    c = spark.createDataFrame([(i, "a", float(i % 2)) for i in range(20)], "id long, task string, y double")
    assert smp.seed_set_balanced(c, "a", 0).count() == 0
    with pytest.raises(smp.SampleSizeError):
        smp.seed_set_balanced(c, "missing", 2)
    runs = spark.createDataFrame([(0, 1, "a"), (1, 1, "a"), (2, 2, "a")], "run_id long, seed long, task string")
    many = smp.seed_sets_for_runs(c, runs, 4)
    one = {(r["id"], r["y"]) for r in smp.seed_set_balanced(c, "a", 4, 1).collect()}
    for run in (0, 1):
        assert {(r["id"], r["y"]) for r in many.where(F.col("run_id") == run).collect()} == one
    with pytest.raises(smp.SampleSizeError):
        smp.seed_sets_for_runs(c, runs.unionByName(spark.createDataFrame([(3, 1, "zzz")], runs.schema)), 4)
