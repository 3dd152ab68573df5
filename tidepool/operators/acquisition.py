"""Acquisition functions over packed predictions ``(id, task, ps array<double>)``.

Per-cell scores (BALD, greedy, UCB) are array expressions on the packed row:
all K passes of a cell sit in one row, so no shuffle is needed.  EPIG compares
every pool cell with every target cell; it is computed blockwise (a matrix
product per batch) and never materialises pool x target rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.hashing import hash52

BALD_EPS = 1e-10
UCB_BETA = 2.0
CHECK_EPS = 1e-6
EPIG_TARGET_BLOCK = 4096                 # targets per cogroup block, at least
EPIG_BLOCK_CELLS = 4_000_000             # targets x passes per cogroup block (32 MB)
EPIG_POOL_GROUP = 262_144                # pool cells per cogroup group
EPIG_POOL_TILE = 256                     # pool rows per in-task tile
EPIG_TARGET_TILE = 2048                  # targets per in-task tile


def _mean(ps="ps"):
    return F.aggregate(ps, F.lit(0.0), lambda a, p: a + p) / F.size(ps)


def _bald(m, eps: float = BALD_EPS):
    eh = F.aggregate("ps", F.lit(0.0), lambda a, p: a + (-p * F.log(p + F.lit(eps)))) / F.size("ps")
    return (-m * F.log(m + F.lit(eps))) - eh


def _ucb(m, beta: float):
    var = F.aggregate("ps", F.lit(0.0), lambda a, p: a + (p - m) * (p - m)) / F.size("ps")
    return m + F.lit(beta) * F.sqrt(var)


def bald(preds: DataFrame, eps: float = BALD_EPS) -> DataFrame:
    """Mutual information, positive-class term only: H(mean p) - mean H(p), H(p) = -p ln(p+eps)."""
    return preds.withColumn("_m", _mean()).select("id", "task", _bald(F.col("_m"), eps).alias("score"))


def greedy(preds: DataFrame) -> DataFrame:
    return preds.select("id", "task", _mean().alias("score"))


def ucb(preds: DataFrame, beta: float = UCB_BETA) -> DataFrame:
    """mean + beta * population std over passes."""
    return preds.withColumn("_m", _mean()).select("id", "task", _ucb(F.col("_m"), beta).alias("score"))


def score_by(preds: DataFrame, strategy, beta: float = UCB_BETA, keep: list[str] | None = None) -> DataFrame:
    """Scores of rows that follow different per-cell strategies (``strategy``: a column of their names)."""
    m = F.col("_m")
    score = F.when(strategy == "BALD", _bald(m)).when(strategy == "greedy", m).when(strategy == "ucb", _ucb(m, beta))
    return preds.withColumn("_m", _mean()).select("id", "task", *(keep or []), score.alias("score"))


def _epig_block(P: np.ndarray, mp: np.ndarray, Q: np.ndarray, mq: np.ndarray) -> np.ndarray:
    """Sum over targets of J ln(J/I) (0 where J = 0) for pool rows P (n,K) vs targets Q (m,K)."""
    K = P.shape[1]
    J = (P @ Q.T) / K
    I = mp[:, None] * mq[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        S = np.where(J > 0, J * (np.log(np.where(J > 0, J, 1.0)) - np.log(I)), 0.0)
    return S.sum(axis=1)


def _epig_sums(P: np.ndarray, Q: np.ndarray) -> np.ndarray:
    """:func:`_epig_block` of pool rows P against all targets Q, in tiles of both sides: memory does not grow with either."""
    mp, mq = P.mean(axis=1), Q.mean(axis=1)
    s = np.zeros(len(P))
    for r in range(0, len(P), EPIG_POOL_TILE):
        rs = slice(r, r + EPIG_POOL_TILE)
        for c in range(0, len(Q), EPIG_TARGET_TILE):
            cs = slice(c, c + EPIG_TARGET_TILE)
            s[rs] += _epig_block(P[rs], mp[rs], Q[cs], mq[cs])
    return s


def _to_matrix(col: pa.Array, n: int) -> np.ndarray:
    vals = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return vals.reshape(n, -1)


def epig(pool: DataFrame, targets: DataFrame, target_block: int | None = None,
         pool_group: int = EPIG_POOL_GROUP, by: str | None = None) -> DataFrame:
    """Expected predictive information gain of each pool cell about a target set.

    ``pool``: ``(id, task, ps)``; ``targets``: ``(id, ps)`` (one task, e.g. the
    main task on the test inputs).  Score = mean over targets t of
    ``J ln(J / (m_a m_t))`` with ``J = mean_k p_ak p_tk`` (0 where J = 0).

    Pool groups of about ``pool_group`` cells are cogrouped with target blocks of about
    ``target_block`` targets (each side replicated across the other's blocks, never
    forming pairs as rows), and the partial sums are added up.  A task compares tiles of
    both sides, so it holds its two sides and one tile's products.

    ``by``: a column of both sides (such as the run); pool cells meet the targets of their own
    value only.  Every value has as many targets.
    """
    own = [by] if by else []
    sizes = targets.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("ps")).alias("k"))
    n_t, fewest, k_passes, values = sizes.agg(F.max("n"), F.min("n"), F.max("k"), F.count(F.lit(1))).first()
    if not n_t:
        raise ValueError("EPIG needs a non-empty target set")
    if fewest != n_t:
        raise ValueError(f"EPIG targets differ in number by {by}: {fewest} to {n_t}")
    block = target_block or max(EPIG_TARGET_BLOCK, EPIG_BLOCK_CELLS // max(1, k_passes))
    return _epig_blocked(pool, targets, n_t, block, pool_group, own, values)


def _epig_blocked(pool: DataFrame, targets: DataFrame, n_t: int, target_block: int, pool_group: int,
                  own: list[str], values: int) -> DataFrame:
    n_p = pool.count() // values
    nb = max(1, math.ceil(n_t / target_block))
    ng = max(1, math.ceil(n_p / pool_group))
    # cogroup keys must have identical types on both sides (int vs long would
    # hash to different partitions), so both are cast to long explicitly
    p = pool.select("id", "task", "ps", *own,
                    F.pmod(hash52("epig-g", "id", "task"), F.lit(ng)).cast("long").alias("g"),
                    F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))).alias("b"))
    t = targets.select(F.col("ps").alias("qs"), *own,
                       F.pmod(hash52("epig-b", "id"), F.lit(nb)).cast("long").alias("b"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ng - 1).cast("long"))).alias("g"))
    import pandas as pd

    def block(pdf: pd.DataFrame, tdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({"id": pdf["id"], "task": pdf["task"], **{c: pdf[c] for c in own}, "s": []})
        P = np.stack(pdf["ps"].to_numpy()).astype(np.float64)
        s = np.zeros(len(pdf))
        if not tdf.empty:
            Q = np.stack(tdf["qs"].to_numpy()).astype(np.float64)
            s = _epig_sums(P, Q)
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "task": pdf["task"].to_numpy(),
                             **{c: pdf[c].to_numpy() for c in own}, "s": s})

    schema = T.StructType([pool.schema["id"], pool.schema["task"], *[pool.schema[c] for c in own], T.StructField("s", T.DoubleType())])
    parts = p.groupBy(*own, "g", "b").cogroup(t.groupBy(*own, "g", "b")).applyInPandas(block, schema)
    return parts.groupBy("id", "task", *own).agg((F.sum("s") / F.lit(float(n_t))).alias("score"))


def uniform(pool_cells: DataFrame, n: int, seed: int = 0, iteration: int = 0) -> DataFrame:
    """n observed pool cells chosen uniformly (hash order of seed, iteration, id, task); all if fewer."""
    obs = pool_cells.where(F.col("y").isNotNull())
    h = hash52(f"{seed}|{iteration}", "id", "task")
    return obs.withColumn("_h", h).orderBy("_h", "id", "task").limit(n).drop("_h")


def random_index(pool_rows: DataFrame, tasks: list[str], n: int, seed: int = 0, iteration: int = 0) -> DataFrame:
    """n distinct rows by hash order; each gets a task drawn independently (with replacement)."""
    h = hash52(f"{seed}|{iteration}", "id")
    task_arr = F.array(*[F.lit(t) for t in tasks])
    pick = F.pmod(hash52(f"{seed}|{iteration}|task", "id"), F.lit(len(tasks))) + 1
    return (pool_rows.select("id").distinct().withColumn("_h", h).orderBy("_h", "id").limit(n)
            .select("id", F.element_at(task_arr, pick.cast("int")).alias("task")))


def score_range_check(scores: DataFrame, max_value: float = float("inf"), eps: float = CHECK_EPS,
                      group_cols: list[str] | None = None) -> DataFrame:
    """Count scores that are NaN, below -eps or above max_value + eps; report min and max."""
    s = F.col("score")
    bad = F.isnan(s) | (s + F.lit(eps) < 0)
    if math.isfinite(max_value):
        bad = bad | (s - F.lit(eps) > F.lit(max_value))
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(bad.cast("long")).alias("n_bad"),
            F.min(s).alias("min_score"), F.max(s).alias("max_score")]
    return scores.groupBy(*(group_cols or [])).agg(*aggs)


def warn_on_bad_scores(scores: DataFrame, max_value: float = float("inf"), eps: float = CHECK_EPS,
                       label: str = "") -> dict:
    """Run the range check (one aggregate row) and warn if any score is out of range."""
    import warnings
    row = score_range_check(scores, max_value, eps).first().asDict()
    if row["n_bad"]:
        warnings.warn(f"{row['n_bad']} of {row['n']} {label} scores are out of range; they span "
                      f"{row['min_score']} to {row['max_score']}", stacklevel=2)
    return row


ACQUISITIONS = {
    "BALD": bald,
    "greedy": greedy,
    "ucb": ucb,
}
