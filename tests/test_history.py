"""Compaction of histories: bounded files, an atomic switch, nothing lost in a crash."""

import os

import pytest
from pyspark.sql import functions as F

from tidepool.plans import loop as lp
from tidepool.session import scratch_path
from tidepool.sources import history as hs

DDL = "run_id long, iteration long, id long, task string, y double"


def _append(spark, path, runs, iterations):
    """One partition per run and iteration, written in one go."""
    rows = [(r, i, 100 * i + k, "a", float(k)) for r in runs for i in iterations for k in range(2)]
    hs.append_history(spark.createDataFrame(rows, DDL), path)
    return rows


def _rows(df):
    return sorted(tuple(r) for r in df.select("iteration", "id", "task", "y").collect())


def _files(spark, path):
    names = hs.list_folder(spark, path)
    return [n for n in names if n.endswith(".parquet")] + [
        f for n in names if "=" in n or n == hs.MERGED for f in _files(spark, f"{path}/{n}")]


def test_two_thousand_iterations_leave_few_files(spark):
    path = scratch_path(spark, "hist")
    want = []
    for lo in range(0, 2000, 500):
        want += [r[1:] for r in _append(spark, path, [3], range(lo, lo + 500))]
        assert hs.compact_history(spark, path, 3) == lo + 499
    assert 2 <= len(_files(spark, path)) <= 3
    assert _rows(hs.read_run(spark, path, 3)) == sorted(want)
    assert lp.stored_iterations(spark, path, 3) == set(range(2000))
    assert lp.iteration_done(spark, path, 3, 5) and lp.iteration_done(spark, path, 3, 1999)
    assert not lp.iteration_done(spark, path, 3, 2000) and not lp.iteration_done(spark, path, 4, 5)


@pytest.mark.parametrize("stop", ["written", "marked"])
def test_a_crash_in_mid_compaction_loses_nothing(spark, stop):
    path = scratch_path(spark, "hist")
    want = sorted(r[1:] for r in _append(spark, path, [1], range(6)))
    other = sorted(r[1:] for r in _append(spark, path, [2], range(3)))
    with pytest.raises(RuntimeError):
        hs.compact_history(spark, path, 1, fail_at=stop)
    assert _rows(hs.read_run(spark, path, 1)) == want
    assert _rows(hs.read_history(spark, path).where("run_id = 1")) == want
    assert hs.compact_history(spark, path, 1) == 5      # the next attempt goes through
    assert _rows(hs.read_run(spark, path, 1)) == want
    assert _rows(hs.read_history(spark, path).where("run_id = 2")) == other
    assert len(hs.list_folder(spark, f"{path}/run_id=1")) == 1


def test_crash_between_switch_and_sweep_of_a_second_compaction(spark):
    path = scratch_path(spark, "hist")
    want = [r[1:] for r in _append(spark, path, [1], range(4))]
    hs.compact_history(spark, path, 1)
    want += [r[1:] for r in _append(spark, path, [1], range(4, 9))]
    with pytest.raises(RuntimeError):
        hs.compact_history(spark, path, 1, fail_at="marked")
    assert _rows(hs.read_run(spark, path, 1)) == sorted(want)
    hs.compact_history(spark, path, 1)                  # nothing to merge: sweeps up what was left
    assert hs.list_folder(spark, f"{path}/_merged/run_id=1") == ["upto=8"]
    assert _rows(hs.read_run(spark, path, 1)) == sorted(want)


def test_last_iteration_can_be_retried_and_merged_ones_cannot(spark):
    path = scratch_path(spark, "hist")
    _append(spark, path, [1], range(5))
    hs.compact_history(spark, path, 1)
    _append(spark, path, [1], [4])
    assert hs.read_run(spark, path, 1).count() == 10
    with pytest.raises(ValueError, match="merged"):
        _append(spark, path, [1], [2])
    with pytest.raises(hs.HistorySchemaError):
        hs.append_history(spark.createDataFrame([(1, 9, 1, "a", 1.0, 2)], DDL + ", extra int"), path)
    with pytest.raises(ValueError):
        hs.compact_history(spark, path, 1, keep=0)


def test_missing_history(spark):
    path = scratch_path(spark, "hist")
    assert hs.read_run(spark, path, 0) is None and hs.runs_of(spark, path) == []
    assert hs.compact_history(spark, path, 0) is None
    assert lp.iterations_done(spark, path, 0, [0, 1]).where("done = 1").count() == 0


def test_a_run_that_compacts_resumes_and_replays(spark):
    ids = list(range(60))
    feats = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in ids], "id long, x array<double>")
    cells = spark.createDataFrame([(i, "a", float(i % 2)) for i in ids], "id long, task string, y double")
    train, pool = cells.where("id < 6"), cells.where("id >= 6")

    def run(iterations, every):
        cfg = lp.RunConfig(iterations=iterations, history_path=paths[every], compact_every=every,
                           step=lp.StepConfig("greedy", n_query=2, passes=2))
        return lp.al_run(train, pool, feats, cfg)
    paths = {0: scratch_path(spark, "plain"), 2: scratch_path(spark, "merged")}
    whole = run(7, 0)
    run(4, 2)
    parts = run(7, 2)                                   # resumes after four iterations
    assert _rows(hs.read_run(spark, paths[0], 0)) == _rows(hs.read_run(spark, paths[2], 0))
    assert sorted(map(tuple, whole["pool"].collect())) == sorted(map(tuple, parts["pool"].collect()))
    assert len(hs.list_folder(spark, f"{paths[2]}/run_id=0")) <= 3
    replayed, _ = lp.replay_history(spark, paths[2], train, pool, 0)
    assert sorted(map(tuple, replayed.collect())) == sorted(map(tuple, whole["train"].collect()))


def test_loop_checkpoints_do_not_pile_up(spark):
    from tidepool.session import ensure_checkpoint_dir
    ids = list(range(40))
    feats = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in ids], "id long, x array<double>")
    cells = spark.createDataFrame([(i, "a", float(i % 2)) for i in ids], "id long, task string, y double")
    base = ensure_checkpoint_dir(spark).replace("file:", "")

    def folders():
        return sum(1 for _, dirs, _ in os.walk(base) for d in dirs if d.startswith("rdd-"))
    left = []
    for n in (1, 5):
        before = folders()
        lp.al_run(cells.where("id < 6"), cells.where("id >= 6"), feats,
                  lp.RunConfig(iterations=n, step=lp.StepConfig("uniform", n_query=1)))
        left.append(folders() - before)
    assert left[0] == left[1]
