"""The active-learning step and loop, resume/replay, and the experiment grid.

One iteration is a handful of DataFrame jobs: score the pool (K passes, no
shuffle), rank cells, take the global top-k (bounded by k per task), reveal,
update the training and pool cells with semi/anti joins, and verify cell
conservation.  Each iteration appends its query rows to a history table
partitioned by (run_id, iteration) and checkpoints the rows queried so far, so a
1000-iteration run never builds a 1000-deep lineage and a lost executor only
recomputes the current iteration.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.operators import acquisition as acq
from tidepool.operators import selection as sel
from tidepool.operators.scoring import (
    DEFAULT_DROPOUT, DEFAULT_PASSES, centroid_weights, score_deterministic, score_mc, train_surrogate,
)
from tidepool.session import broadcast_scope, cut_lineage, release
from tidepool.sources.history import append_history, compact_history, has_iteration, read_run, tail_iterations

STRATEGIES = ("BALD", "EPIG_MT", "greedy", "ucb", "uniform")


@dataclass
class StepConfig:
    strategy: str = "BALD"
    n_query: int = 1
    passes: int = DEFAULT_PASSES
    seed: int = 0
    ucb_beta: float = acq.UCB_BETA
    main_task: str | None = None
    dropout: float = DEFAULT_DROPOUT
    check: bool = True


@dataclass
class StepResult:
    query: DataFrame
    train: DataFrame
    pool: DataFrame
    counts: DataFrame | None = None
    extra: dict = field(default_factory=dict)


def acquisition_scores(pool_preds: DataFrame, cfg: StepConfig, target_preds: DataFrame | None = None) -> DataFrame:
    """Strategy name -> acquisition function."""
    if cfg.strategy == "BALD":
        return acq.bald(pool_preds)
    if cfg.strategy == "greedy":
        return acq.greedy(pool_preds)
    if cfg.strategy == "ucb":
        return acq.ucb(pool_preds, cfg.ucb_beta)
    if cfg.strategy == "EPIG_MT":
        if target_preds is None:
            raise ValueError("EPIG_MT needs target predictions")
        return acq.epig(pool_preds, target_preds)
    raise ValueError(f"unknown strategy {cfg.strategy!r}")


def al_step(train: DataFrame, pool: DataFrame, feats: DataFrame, weights: DataFrame, cfg: StepConfig,
            iteration: int = 0, target_feats: DataFrame | None = None,
            pool_feats: DataFrame | None = None) -> StepResult:
    """One iteration: score -> acquire -> mask -> top-k -> reveal -> update -> check.

    ``pool_feats``: features of (at least) the pool's rows, prepared by the caller; a loop
    then scores them without a shuffle, and the mask leaves the pool's cells.
    """
    if cfg.strategy == "uniform":
        query = acq.uniform(pool, cfg.n_query, cfg.seed, iteration).select("id", "task", "y")
    else:
        if pool_feats is None:
            pool_feats = feats.join(pool.where(F.col("y").isNotNull()).select("id").distinct(), "id", "left_semi")
        preds = score_mc(pool_feats, weights, passes=cfg.passes, dropout=cfg.dropout)
        targ = None
        if cfg.strategy == "EPIG_MT":
            tw = weights.where(F.col("task") == cfg.main_task)
            targ = score_mc(target_feats, tw, passes=cfg.passes, dropout=cfg.dropout).select("id", "ps")
        raw = acquisition_scores(preds, cfg, targ)
        if cfg.strategy == "EPIG_MT" and cfg.check:
            # EPIG can be negative (only the joint-positive term is summed): report it, keep going
            raw = cut_lineage(raw)
            acq.warn_on_bad_scores(raw, label="EPIG")
        scores = sel.mask_unlabelled(raw, pool)
        query = sel.reveal_cells(pool, sel.topk_cells(scores, cfg.n_query))
    query = cut_lineage(query)  # k rows; freezes the choice for every consumer below
    new_train = sel.upsert_train(train, query)
    new_pool = sel.shrink_pool(pool, query)
    counts = None
    if cfg.check:
        counts = sel.conservation_check(train, pool, query, new_train, new_pool)
    return StepResult(query, new_train, new_pool, counts)


@dataclass
class RunConfig:
    run_id: int = 0
    iterations: int = 3
    step: StepConfig = field(default_factory=StepConfig)
    history_path: str | None = None
    metrics_path: str | None = None
    surrogate: str = "centroid"  # or "logistic"
    compact_every: int = 64      # partitions a run may leave before its history is compacted; 0: never


def fit_surrogate(name: str, train: DataFrame, feats: DataFrame, tasks: list[str]) -> DataFrame:
    """Weights ``(task, bias, w)`` of the named surrogate, one row per task."""
    if name == "centroid":
        return centroid_weights(train, feats, tasks=tasks)
    if name == "logistic":
        return train_surrogate(train, feats)
    raise ValueError(f"unknown surrogate {name!r}")


def al_run(train: DataFrame, pool: DataFrame, feats: DataFrame, cfg: RunConfig,
           test_cells: DataFrame | None = None, target_feats: DataFrame | None = None,
           start_iteration: int = 0) -> dict:
    """The loop: fit surrogate, evaluate, acquire, update; history and metrics appended per iteration.

    Iterations already present in the history are replayed at once, and the loop goes on
    after them (resume).  It ends early when the pool holds no labelled cell.

    An iteration keeps its query rows only: the working sets are always the initial ones
    with all queries applied, so neither pool nor features are copied or shuffled per
    iteration, and lineage stays flat.
    """
    from tidepool.operators import metrics as mt

    spark = train.sparkSession
    train0, pool0 = cut_lineage(train), cut_lineage(pool)
    tasks = sorted(r["task"] for r in train0.select("task").union(pool0.select("task")).distinct().collect())
    last = start_iteration + cfg.iterations
    done = stored_iterations(spark, cfg.history_path, cfg.run_id) if cfg.history_path else set()
    first = start_iteration
    while first in done and first < last:
        first += 1
    queried = None  # rows queried so far: k per iteration
    if first > start_iteration:
        queried = cut_lineage(stored_queries(spark, cfg.history_path, cfg.run_id, upto=first - 1))
    pool_feats = None
    if cfg.step.strategy != "uniform" and first < last:
        pool_feats = cut_lineage(feats.join(pool0.where(F.col("y").isNotNull()).select("id").distinct(), "id", "left_semi"))

    def working_sets() -> tuple[DataFrame, DataFrame]:
        if queried is None:
            return train0, pool0
        return sel.upsert_train(train0, queried), sel.shrink_pool(pool0, queried)

    for it in range(first, last):
        train, pool = working_sets()
        if pool.where(F.col("y").isNotNull()).isEmpty():
            break
        with broadcast_scope():
            evaluate = bool(cfg.metrics_path and test_cells is not None)
            weights = None
            if cfg.step.strategy != "uniform" or evaluate:  # the uniform strategy needs no model
                weights = cut_lineage(fit_surrogate(cfg.surrogate, train, feats, tasks))
            if evaluate:
                tf = feats.join(test_cells.select("id").distinct(), "id", "left_semi")
                preds = score_deterministic(tf, weights).select("id", "task", "p")
                rep = mt.metrics_report(mt.threshold_curve(test_cells.join(preds, ["id", "task"])), iteration=it)
                append_history(rep.withColumn("run_id", F.lit(cfg.run_id).cast("long")), cfg.metrics_path)
            res = al_step(train, pool, feats, weights, cfg.step, iteration=it, target_feats=target_feats,
                          pool_feats=pool_feats)
            if cfg.history_path:
                append_history(res.query.select(F.lit(cfg.run_id).cast("long").alias("run_id"),
                                                F.lit(it).cast("long").alias("iteration"), "id", "task", "y"),
                               cfg.history_path)
                if cfg.compact_every and len(tail_iterations(spark, cfg.history_path, cfg.run_id, None)) > cfg.compact_every:
                    compact_history(spark, cfg.history_path, cfg.run_id)
            new = res.query.select("id", "task", "y")
            before, queried = queried, cut_lineage(new if queried is None else queried.unionByName(new))
        release(weights, res.query, before)  # files that only this iteration and the one before read
    train, pool = working_sets()
    return {"train": cut_lineage(train), "pool": cut_lineage(pool)}


def iteration_done(spark: SparkSession, history_path: str, run_id: int, iteration: int) -> bool:
    """Does the history hold rows for (run_id, iteration)?  Opens that one partition (or the run's merged set).

    No history means no; a damaged one raises.
    """
    return has_iteration(spark, history_path, run_id, iteration)


def stored_iterations(spark: SparkSession, history_path: str, run_id: int) -> set[int]:
    """Iterations of a run that the history holds (one number per iteration comes back)."""
    h = read_run(spark, history_path, run_id)
    if h is None:
        return set()
    return {int(r[0]) for r in h.select("iteration").distinct().collect()}


def iterations_done(spark: SparkSession, history_path: str, run_id: int, iterations: list[int]) -> DataFrame:
    """(iteration, done) for several iterations in one job over the run's partitions."""
    want = spark.createDataFrame([(int(i),) for i in iterations], "iteration long")
    h = read_run(spark, history_path, run_id)
    if h is None:
        return want.select("iteration", F.lit(0).alias("done"))
    return want.join(h.select("iteration").distinct().withColumn("done", F.lit(1)), "iteration", "left") \
        .select("iteration", F.coalesce("done", F.lit(0)).alias("done"))


def stored_queries(spark: SparkSession, history_path: str, run_id: int, upto: int | None = None) -> DataFrame:
    """Query rows (id, task, y) of a run's iterations, up to one of them."""
    h = read_run(spark, history_path, run_id)
    if h is None:
        raise ValueError(f"{history_path} holds nothing of run {run_id}")
    if upto is not None:
        h = h.where(F.col("iteration") <= upto)
    return h.select("id", "task", "y")


def replay_history(spark: SparkSession, history_path: str, train0: DataFrame, pool0: DataFrame, run_id: int,
                   upto: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rebuild training and pool cells from stored queries, all past iterations at once."""
    q = stored_queries(spark, history_path, run_id, upto)
    return sel.upsert_train(train0, q), sel.shrink_pool(pool0, q)


def experiment_grid(tasks: DataFrame, seeds: list[int], strategies: list[str],
                    feature_types: list[str] | None = None) -> DataFrame:
    """Runs = tasks x seeds x strategies (x feature types), mixed-radix ``run_id``.

    ``tasks``: one column ``task`` (derived from the data), or ``dataset`` and ``task`` where
    the grid spans data sets with tasks of their own.  Parameters are
    exploded per task row, so the grid is one narrow job; ``run_id`` then
    leads every key when runs share a job.
    """
    ft = feature_types or ["default"]
    axes = [c for c in ("dataset", "task") if c in tasks.columns]
    t = tasks.select(*axes).distinct()
    t = t.withColumn("ti", F.dense_rank().over(Window.orderBy(*axes)) - 1)
    g = (t.select(*axes, "ti", F.posexplode(F.array(*[F.lit(s) for s in seeds])).alias("si", "seed"))
         .select("*", F.posexplode(F.array(*[F.lit(s) for s in strategies])).alias("gi", "strategy"))
         .select("*", F.posexplode(F.array(*[F.lit(f) for f in ft])).alias("fi", "feature_type")))
    run_id = ((F.col("ti") * len(seeds) + F.col("si")) * len(strategies) + F.col("gi")) * len(ft) + F.col("fi")
    return g.select(run_id.cast("long").alias("run_id"), *axes, F.col("seed").cast("long"), "strategy",
                    "feature_type")
