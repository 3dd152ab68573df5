"""Rows and tasks that must not vanish, damaged inputs, and keys of any type."""

import math
import os

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidepool.operators import cluster as clu
from tidepool.operators import metrics as mt
from tidepool.operators import split as sp
from tidepool.operators.scoring import keep_below, keep_mask, score_mc, train_surrogate
from tidepool.plans import loop as lp
from tidepool.plans import pipeline as pl
from tidepool.session import scratch_path
from tidepool.sources import io as sio


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"g{i % 3}") for i in range(30)], "id long, g string")
    out = sp.split_by_group(df, "g", 0.7).collect()
    assert len(out) == 30
    assert len({r["role"] for r in out if r["g"] is None}) == 1


def test_rows_without_fingerprint_get_a_role(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "id long")
    fps = spark.createDataFrame([(0, [1, 2]), (1, [1, 2]), (2, [9])], "id long, bits array<int>")
    out = {r["id"]: r for r in clu.split_by_cluster(df, fps, "id").collect()}
    assert len(out) == 5
    assert out[0]["cluster"] == out[1]["cluster"]


def test_undefined_metrics_are_null_not_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([("neg", 0.0, 0.2), ("neg", 0.0, 0.7), ("nan", 1.0, 0.9), ("nan", 0.0, nan),
                                ("ok", 1.0, 0.9), ("ok", 0.0, 0.1)], "task string, y double, p double")
    curve = mt.threshold_curve(df)
    for fn, c in ((mt.aupr, "AUPR"), (mt.average_precision, "average_precision"), (mt.best_f1, "f1_score"),
                  (mt.roc_auc, "roc_auc"), (mt.f1_at_threshold, "f1_at_threshold"), (mt.balanced_acc, "balanced_acc")):
        got = {r["task"]: r[c] for r in fn(curve).collect()}
        assert got == {"neg": None, "nan": None, "ok": 1.0}, c
    assert {r["task"]: r["ACE"] is None for r in mt.ace(curve).collect()} == {"neg": False, "nan": True, "ok": False}
    assert {r["task"]: r["ECE"] is None for r in mt.ece(mt.score_rows(df)).collect()} == {"neg": False, "nan": True, "ok": False}


def test_one_class_tasks_have_a_surrogate(spark):
    feats = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(8)], "id long, x array<double>")
    one = spark.createDataFrame([(i, "one", 1.0) for i in range(8)], "id long, task string, y double")
    assert [tuple(r) for r in train_surrogate(one, feats).collect()] == [("one", 0.0, [0.0, 0.0])]
    two = one.unionByName(feats.select("id", F.lit("two").alias("task"), (F.col("id") % 2).cast("double").alias("y")))
    assert {r["task"] for r in train_surrogate(two, feats).collect()} == {"one", "two"}


@pytest.mark.parametrize("rate", [0.2, 0.5, 0.8])
def test_dropout_keeps_its_share(rate):
    kept = np.mean([keep_mask(np.arange(400), k, 64, rate).mean() for k in range(10)])
    assert abs(kept - (1 - rate)) < 0.02
    assert keep_below(0.0) >= 1_000_003


def test_mean_logit_is_unbiased_for_any_rate_and_key(spark):
    feats = spark.createDataFrame([(f"key {i}", [1.0] * 64) for i in range(30)], "id string, x array<double>")
    w = spark.createDataFrame([("t", 0.0, [1.0 / 64] * 64)], "task string, bias double, w array<double>")
    for rate in (0.2, 0.5, 0.8):
        ps = [p for r in score_mc(feats, w, passes=20, dropout=rate).collect() for p in r["ps"]]
        assert abs(np.mean([math.log(p / (1 - p)) for p in ps]) - 1.0) < 0.05


def _step_tables(spark):
    ids = [f"k{i}" for i in range(60)]
    feats = spark.createDataFrame([(k, [float(i % 7), float(i % 5), 1.0]) for i, k in enumerate(ids)], "id string, x array<float>")
    cells = [(k, t, float((i + (t == "b")) % 2)) for i, k in enumerate(ids) for t in ("a", "b")]
    train = spark.createDataFrame(cells[:40], "id string, task string, y double")
    pool = spark.createDataFrame(cells[40:100], "id string, task string, y double")
    test = spark.createDataFrame(cells[100:], "id string, task string, y double")
    return feats, train, pool, test


@pytest.mark.parametrize("strategy,surrogate", [("BALD", "logistic"), ("greedy", "centroid"), ("EPIG_MT", "centroid")])
def test_full_run_on_string_keys(spark, strategy, surrogate):
    feats, train, pool, test = _step_tables(spark)
    cfg = lp.RunConfig(iterations=2, history_path=scratch_path(spark, "h"), metrics_path=scratch_path(spark, "m"),
                       surrogate=surrogate, step=lp.StepConfig(strategy, n_query=3, passes=4, dropout=0.2, main_task="a"))
    targets = feats.join(test.select("id").distinct(), "id", "left_semi")
    out = lp.al_run(train, pool, feats, cfg, test_cells=test, target_feats=targets)
    assert spark.read.parquet(cfg.history_path).count() == 6
    assert spark.read.parquet(cfg.metrics_path).count() == 6  # two tasks and the mean, twice
    assert out["pool"].count() == pool.count() - 6
    again = lp.al_run(train, pool, feats, cfg, test_cells=test, target_feats=targets)  # resumes after the end
    assert sorted(map(tuple, again["pool"].collect())) == sorted(map(tuple, out["pool"].collect()))


def test_empty_pool_ends_the_run(spark):
    feats, train, pool, _ = _step_tables(spark)
    cfg = lp.RunConfig(iterations=5, history_path=scratch_path(spark, "h"), step=lp.StepConfig("greedy", n_query=40, passes=2))
    out = lp.al_run(train, pool, feats, cfg)
    assert out["pool"].count() == 0
    assert lp.stored_iterations(spark, cfg.history_path, 0) == {0, 1}


def test_damaged_history_raises(spark, tmp_path):
    path = str(tmp_path / "history")
    df = spark.createDataFrame([(0, 0, 1, "a", 1.0)], "run_id long, iteration long, id long, task string, y double")
    assert lp.iteration_done(spark, path, 0, 0) is False
    sio.append_history(df, path)
    assert lp.iteration_done(spark, path, 0, 0) is True
    for root, _, files in os.walk(path):
        for f in files:
            if f.endswith(".parquet"):
                with open(os.path.join(root, f), "wb") as out:
                    out.write(b"not parquet")
            elif f.endswith(".crc"):
                os.unlink(os.path.join(root, f))
    with pytest.raises(Exception):
        lp.iteration_done(spark, path, 0, 0)
    with pytest.raises(Exception):
        sio.append_history(df, path)


def test_minus_one_labels_are_missing(spark, tmp_path):
    (tmp_path / "l.csv").write_text("id,y,x\na,-1,-1\nb,1,2\nc,NaN,3\n")
    rows = sio.read_table(spark, str(tmp_path / "l.csv"), label_cols=["y"]).orderBy("id").collect()
    assert [r["y"] for r in rows] == [None, 1.0, None]
    assert [r["x"] for r in rows] == [-1, 2, 3]


def _config(tmp_path, keys, **kw):
    labels = "X,t0,grp\n" + "".join(f"{k},{i % 2 if i % 11 else -1},g{i % 4}\n" for i, k in enumerate(keys))
    feats = "SMILES,f0,f1\n" + "".join(f"{k},{i % 3},{i % 2}\n" for i, k in enumerate(dict.fromkeys(keys)))
    (tmp_path / "labels.csv").write_text(labels)
    (tmp_path / "feats.csv").write_text(feats)
    return {"target_file": str(tmp_path / "labels.csv"), "BERT_features_file": str(tmp_path / "feats.csv"),
            "Compound_col": "X", "selected_tasks": "t0", "output_dir": str(tmp_path / "out"), **kw}


def test_repeated_keys_do_not_leak_over_the_group_split(spark, tmp_path):
    keys = [f"k{i % 40}" for i in range(60)]  # k0..k19 twice, in different groups
    cfg = _config(tmp_path, keys, splitter="ScaffoldSplitter", group_col="grp")
    cells, feats = pl.load_labelled(spark, cfg)
    assert {r["y"] for r in cells.collect()} <= {0.0, 1.0, None}
    roles = pl.split_train_test(cells, feats, cfg).collect()
    assert len(roles) == 40 and len({r["id"] for r in roles}) == 40


def test_pipeline_writes_its_initial_set(spark, tmp_path):
    cfg = _config(tmp_path, [f"k{i}" for i in range(80)], splitter="RandomSplitter", main_task_initial_set_samples=8,
                  num_forward_passes=3, num_iterations=1, n_query=2, dropout_p=0.2)
    pl.active_learning_run(spark, cfg)
    assert spark.read.parquet(f"{cfg['output_dir']}/initial_set").count() == 8
