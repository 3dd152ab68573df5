"""Many runs in one loop equal the runs one by one."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidepool.operators import sampling as smp
from tidepool.plans import loop as lp
from tidepool.plans import runs as mr
from tidepool.session import cut_lineage, scratch_path
from tidepool.sources import history as hs
from tidepool.sources import testdata as td

TASKS = ["t0", "t1", "t2"]


@pytest.fixture(scope="module")
def data(spark):
    feats = td.emb_features(spark, SF_SMALL).where("id < 160")
    cells = td.emb_cells(spark, SF_SMALL).where(F.col("id").between(0, 159) & F.col("task").isin(TASKS))
    return cut_lineage(feats), cut_lineage(cells.where("id % 5 != 0")), cut_lineage(cells.where("id % 5 = 0"))


SPECS = [mr.RunSpec(0, "BALD", 1, 2, "t0"), mr.RunSpec(1, "BALD", 2, 2, "t1"), mr.RunSpec(2, "greedy", 1, 3, "t0"),
         mr.RunSpec(3, "ucb", 2, 1, "t2"), mr.RunSpec(4, "uniform", 5, 4, "t0"), mr.RunSpec(12, "EPIG_MT", 1, 2, "t1")]


def _working_sets(cells, spec):
    seed = smp.seed_set_balanced(cells, spec.main_task, 6, spec.seed).select("id", "task", "y")
    return seed, smp.remainder_pool(cells, seed)


def _config(spark, iterations, **kw):
    return lp.RunConfig(iterations=iterations, history_path=scratch_path(spark, "h"), metrics_path=scratch_path(spark, "m"), **kw)


def _many(spark, data, cfg):
    feats, cells, test = data
    train = pool = None
    for s in SPECS:
        a, b = (d.withColumn("run_id", F.lit(s.run_id).cast("long")) for d in _working_sets(cells, s))
        train, pool = (a, b) if train is None else (train.unionByName(a), pool.unionByName(b))
    targets = feats.join(test.select("id").distinct(), "id", "left_semi")
    return mr.al_runs(train, pool, feats, SPECS, cfg, test_cells=test, target_feats=targets)


def test_six_runs_in_one_loop_equal_six_runs(spark, data):
    feats, cells, test = data
    step = lp.StepConfig(passes=4, dropout=0.3)
    cfg = _config(spark, 2, step=step)
    out = _many(spark, data, cfg)
    hist, metrics = hs.read_history(spark, cfg.history_path), spark.read.parquet(cfg.metrics_path)
    for s in SPECS:
        seed, pool = _working_sets(cells, s)
        own = _config(spark, 2, run_id=s.run_id, step=lp.StepConfig(s.strategy, s.n_query, 4, s.seed, main_task=s.main_task, dropout=0.3))
        targets = feats.join(test.select("id").distinct(), "id", "left_semi")
        one = lp.al_run(seed, pool, feats, own, test_cells=test, target_feats=targets)
        key = F.col("run_id") == s.run_id

        def rows(df, *cols):
            return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
        assert rows(hist.where(key), "iteration", "id", "task", "y") == \
            rows(hs.read_history(spark, own.history_path), "iteration", "id", "task", "y"), s
        for part in ("train", "pool"):
            assert rows(out[part].where(key), "id", "task", "y") == rows(one[part], "id", "task", "y"), s
        want = {(r["iteration"], r["Tasks"]): r for r in spark.read.parquet(own.metrics_path).collect()}
        got = {(r["iteration"], r["Tasks"]): r for r in metrics.where(key).collect()}
        assert want.keys() == got.keys()
        for k in want:
            for c in ("balanced_acc", "roc_auc", "AUPR", "ECE"):
                assert got[k][c] == pytest.approx(want[k][c], abs=1e-9), (s, k, c)


def test_runs_resume_each_after_its_own_iterations(spark, data):
    whole, parts = _config(spark, 3, step=lp.StepConfig(passes=2)), _config(spark, 1, step=lp.StepConfig(passes=2), compact_every=1)
    _many(spark, data, whole)
    _many(spark, data, parts)
    hs.remove_path(spark, f"{parts.history_path}/run_id=2/iteration=0")   # one run lost its iteration
    parts.iterations = 3
    out = _many(spark, data, parts)

    def rows(cfg):
        return sorted(tuple(r) for r in hs.read_history(spark, cfg.history_path).select("run_id", "iteration", "id", "task", "y").collect())
    assert rows(whole) == rows(parts)
    assert out["train"].count() > 0


def test_runs_end_when_their_pools_are_empty(spark, data):
    feats, cells, _ = data
    few = cells.where("id < 12 and task = 't0'")
    specs = [mr.RunSpec(0, "greedy", n_query=3), mr.RunSpec(1, "uniform", n_query=50)]
    cells2 = few.crossJoin(spark.createDataFrame([(0,), (1,)], "run_id long"))
    cfg = lp.RunConfig(iterations=9, history_path=scratch_path(spark, "h"), step=lp.StepConfig(passes=2))
    out = mr.al_runs(cells2.where("id < 6"), cells2.where("id >= 6"), feats, specs, cfg)
    assert out["pool"].where("y is not null").count() == 0
    with pytest.raises(ValueError, match="unknown"):
        mr.al_runs(cells2.where("id < 6"), cells2.where("id >= 6"), feats, [mr.RunSpec(0, "best")], lp.RunConfig(iterations=1))


def test_task_names_may_hold_the_separator(spark):
    df = spark.createDataFrame([(12, 1, "a|b", 1.0)], "run_id long, id long, task string, y double")
    assert mr.split_run(mr.by_run(df)).select("run_id", "id", "task", "y").first() == (12, 1, "a|b", 1.0)
