"""Many active-learning runs in one loop.

A grid of experiments (seeds, strategies, main tasks) shares its features and test set,
so its runs advance together: every table carries the run in its task key
``run|task``, one pass over the features scores all runs' models, the best
cells are taken per run, and one append stores the queries of all runs.  Each run's
queries are those of a run of its own (:func:`tidepool.plans.loop.al_run`).

Passes and dropout are shared by the runs of a loop; strategy, seed, main task and batch size are
per run.  The run table is configuration (one row per experiment) and is held by the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.hashing import hash52
from tidepool.operators import acquisition as acq
from tidepool.operators import metrics as mt
from tidepool.operators import selection as sel
from tidepool.operators.scoring import score_deterministic, score_mc
from tidepool.plans.loop import RunConfig, fit_surrogate
from tidepool.session import broadcast_scope, cut_lineage, release
from tidepool.sources.history import append_history, compact_history, read_run, tail_iterations

SEP = "|"


@dataclass(frozen=True)
class RunSpec:
    run_id: int
    strategy: str = "BALD"
    seed: int = 0
    n_query: int = 1
    main_task: str | None = None


def run_key(run: str = "run_id", task: str = "task") -> Column:
    return F.concat(F.col(run).cast("string"), F.lit(SEP), F.col(task))


def run_of(key: str = "task") -> Column:
    return F.substring_index(key, SEP, 1).cast("long")


def task_of(key: str = "task") -> Column:
    return F.substr(F.col(key), F.locate(SEP, F.col(key)) + 1)


def by_run(df: DataFrame) -> DataFrame:
    """Cells ``(run_id, id, task, y)`` keyed by ``run|task``."""
    return df.select("id", run_key().alias("task"), "y")


def split_run(df: DataFrame) -> DataFrame:
    """Back from ``run|task`` keys to ``run_id`` and ``task``."""
    return df.withColumn("run_id", run_of()).withColumn("task", task_of())


def specs_table(spark, runs: list[RunSpec]) -> DataFrame:
    return spark.createDataFrame([(r.run_id, r.strategy, r.seed, r.n_query) for r in runs],
                                 "run_id long, strategy string, seed long, n_query long")


def best_per_run(scored: DataFrame, specs: DataFrame, *order: Column) -> DataFrame:
    """The first ``n_query`` rows of each run in the given order, ties by id and task."""
    w = Window.partitionBy("run_id").orderBy(*order, "id", "task")
    most = specs.agg(F.max("n_query")).first()[0]
    ranked = scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)  # a limit per map task
    return ranked.join(F.broadcast(specs.select("run_id", "n_query")), "run_id").where("_rn <= n_query").select("id", "task")


def query_of_runs(pool: DataFrame, pool_feats: DataFrame | None, weights: DataFrame | None, runs: list[RunSpec],
                  cfg: RunConfig, iteration: int, target_feats: DataFrame | None) -> DataFrame:
    """Cells that the runs ask for in this iteration: ``(id, run|task, y)``."""
    spark = pool.sparkSession
    labelled = pool.where(F.col("y").isNotNull())
    chosen = []

    def of(names):
        return [r for r in runs if r.strategy in names]

    def weights_of(some, main=False):
        keys = run_of().isin([r.run_id for r in some])
        return weights.where(F.col("task").isin([f"{r.run_id}{SEP}{r.main_task}" for r in some]) if main else keys)

    if of(["uniform"]):
        specs = specs_table(spark, of(["uniform"]))
        cells = labelled.withColumn("run_id", run_of()).join(F.broadcast(specs.select("run_id", "seed")), "run_id")
        draw = hash52(F.concat(F.col("seed").cast("string"), F.lit(f"|{iteration}")), "id", task_of())
        chosen.append(best_per_run(cells.withColumn("_h", draw), specs, F.col("_h")))
    per_cell = of(list(acq.ACQUISITIONS))
    if per_cell:
        preds = score_mc(pool_feats, weights_of(per_cell), passes=cfg.step.passes, dropout=cfg.step.dropout)
        specs = specs_table(spark, per_cell)
        strategy = F.col("strategy")
        scores = preds.withColumn("run_id", run_of()).join(F.broadcast(specs.select("run_id", "strategy")), "run_id")
        scores = acq.score_by(scores, strategy, cfg.step.ucb_beta, ["run_id"])
        chosen.append(best_per_run(sel.mask_unlabelled(scores, pool), specs, F.col("score").desc()))
    for_epig = of(["EPIG_MT"])
    if for_epig:
        if target_feats is None or any(r.main_task is None for r in for_epig):
            raise ValueError("EPIG_MT needs target features and a main task per run")
        preds = score_mc(pool_feats, weights_of(for_epig), passes=cfg.step.passes, dropout=cfg.step.dropout)
        targets = score_mc(target_feats, weights_of(for_epig, main=True), passes=cfg.step.passes, dropout=cfg.step.dropout)
        raw = acq.epig(preds.withColumn("run_id", run_of()), targets.select("id", "ps", run_of().alias("run_id")), by="run_id")
        chosen.append(best_per_run(sel.mask_unlabelled(raw, pool), specs_table(spark, for_epig), F.col("score").desc()))
    unknown = set(r.strategy for r in runs) - {"uniform", "EPIG_MT", *acq.ACQUISITIONS}
    if unknown:
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    picked = chosen[0]
    for c in chosen[1:]:
        picked = picked.unionByName(c)
    return sel.reveal_cells(pool, picked)


def report_of_runs(test_cells: DataFrame, feats: DataFrame, weights: DataFrame, iteration: int) -> DataFrame:
    """Metrics per run and task, and each run's mean over its tasks."""
    tf = feats.join(test_cells.select("id").distinct(), "id", "left_semi")
    preds = score_deterministic(tf, weights).select("id", F.col("task").alias("key"), task_of().alias("task"), "p")
    cells = test_cells.join(preds, ["id", "task"]).drop("task").withColumnRenamed("key", "task")
    table = mt.metrics_table(mt.threshold_curve(cells)).withColumn("run_id", run_of()).withColumn("Tasks", task_of())
    rep = table.rollup("run_id", "Tasks").agg(*[F.avg(c).alias(c) for c in mt.METRIC_COLUMNS],
                                              F.grouping("run_id").alias("_r"), F.grouping("Tasks").alias("_g"))
    return rep.where("_r = 0").select(
        F.lit(iteration).cast("long").alias("iteration"), F.when(F.col("_g") == 1, "mean").otherwise(F.col("Tasks")).alias("Tasks"),
        *mt.METRIC_COLUMNS, "run_id")


def al_runs(train: DataFrame, pool: DataFrame, feats: DataFrame, runs: list[RunSpec], cfg: RunConfig,
            test_cells: DataFrame | None = None, target_feats: DataFrame | None = None) -> dict:
    """The loop for all ``runs`` at once; ``train`` and ``pool`` are ``(run_id, id, task, y)``.

    ``cfg`` gives what the runs share: iterations, passes, dropout, surrogate, history and metrics
    tables, compaction.  A run whose iterations are stored goes on after them; one whose pool holds
    no labelled cell any more drops out.  Returns the final working sets with ``run_id``.
    """
    spark = train.sparkSession
    train0, pool0 = cut_lineage(by_run(train)), cut_lineage(by_run(pool))
    first = {r.run_id: 0 for r in runs}
    queried = None
    if cfg.history_path:
        for r in runs:
            stored = read_run(spark, cfg.history_path, r.run_id)
            if stored is None:
                continue
            done = {int(x[0]) for x in stored.select("iteration").distinct().collect()}
            while first[r.run_id] in done and first[r.run_id] < cfg.iterations:
                first[r.run_id] += 1
            rows = stored.where(F.col("iteration") < first[r.run_id]) \
                .select("id", F.concat(F.lit(f"{r.run_id}{SEP}"), "task").alias("task"), "y")
            queried = rows if queried is None else queried.unionByName(rows)
        queried = cut_lineage(queried) if queried is not None else None
    pool_feats = None
    if any(r.strategy != "uniform" for r in runs):
        pool_feats = cut_lineage(feats.join(pool0.where(F.col("y").isNotNull()).select("id").distinct(), "id", "left_semi"))

    def working_sets() -> tuple[DataFrame, DataFrame]:
        if queried is None:
            return train0, pool0
        return sel.upsert_train(train0, queried), sel.shrink_pool(pool0, queried)

    for it in range(min(first.values(), default=cfg.iterations), cfg.iterations):
        train, pool = working_sets()
        alive = {r[0] for r in pool.where(F.col("y").isNotNull()).select(run_of().alias("r")).distinct().collect()}
        now = [r for r in runs if r.run_id in alive and first[r.run_id] <= it]
        if not now:
            if not alive:
                break
            continue
        mine = run_of().isin([r.run_id for r in now])
        train, pool = train.where(mine), pool.where(mine)
        with broadcast_scope():
            evaluate = bool(cfg.metrics_path and test_cells is not None)
            weights = None
            if evaluate or any(r.strategy != "uniform" for r in now):
                keys = sorted(r["task"] for r in train.select("task").union(pool.select("task")).distinct().collect())
                weights = cut_lineage(fit_surrogate(cfg.surrogate, train, feats, keys))
            if evaluate:
                append_history(report_of_runs(test_cells, feats, weights, it), cfg.metrics_path)
            query = cut_lineage(query_of_runs(pool, pool_feats, weights, now, cfg, it, target_feats))
            if cfg.step.check:
                sel.conservation_check(train, pool, query, sel.upsert_train(train, query), sel.shrink_pool(pool, query),
                                       by=run_of())
            if cfg.history_path:
                rows = split_run(query)
                append_history(rows.select("run_id", F.lit(it).cast("long").alias("iteration"), "id", "task", "y"), cfg.history_path)
                if cfg.compact_every:
                    for r in now:
                        if len(tail_iterations(spark, cfg.history_path, r.run_id, None)) > cfg.compact_every:
                            compact_history(spark, cfg.history_path, r.run_id)
            new = query.select("id", "task", "y")
            before, queried = queried, cut_lineage(new if queried is None else queried.unionByName(new))
        release(weights, query, before)
    train, pool = working_sets()
    return {"train": cut_lineage(split_run(train)), "pool": cut_lineage(split_run(pool))}
