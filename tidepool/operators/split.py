"""Splits and folds, all in hash order.

A row's draw is ``md5(seed | key)`` (see :mod:`tidepool.functions.hashing`), so a
split is a pure function of (seed, key): stable under repartitioning, retries
and executor loss.  Exact-size splits rank rows by that hash with the
block-wise :func:`~tidepool.operators.ranking.hash_rank` (no single-task sort).

Library algorithms are replaced by documented rules.  Stratified splits carry
rounding from stratum to stratum: with strata in order and ``C_s`` rows up to and with
stratum ``s``, a stratum gives ``floor(frac * C_s) - floor(frac * C_(s-1))`` rows to train, so
the whole keeps its share however small the strata are (NULL is its own
stratum).  The multilabel k-fold is iterative stratification: the rarest label
first, each fold filled up to its quota of positives.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.hashing import hash52
from tidepool.operators.ranking import hash_rank, join_null_safe, ordered_rank


def _with_rank(df: DataFrame, key: str, seed, strata: list[str]) -> DataFrame:
    return hash_rank(df.withColumn("_h", hash52(seed, key)), strata, "_h", [key])


def split_random(df: DataFrame, frac_train: float = 0.8, seed=42, key: str = "id",
                 exact: bool = True) -> DataFrame:
    """Adds ``role`` in {train, test}.

    ``exact``: exactly ``floor(frac * n)`` train rows (lowest hashes).
    Otherwise a Bernoulli draw per row (hash below frac), no shuffle at all.
    """
    if not exact:
        h = hash52(seed, key)
        return df.withColumn("role", F.when(h < F.lit(int(frac_train * 2 ** 52)), "train").otherwise("test"))
    r = _with_rank(df, key, seed, [])
    return r.withColumn("role", F.when(F.col("_rn") <= F.floor(F.lit(frac_train) * F.col("_n")), "train")
                        .otherwise("test")).drop("_h", "_rn", "_n")


def _taken(rank, frac: float):
    """Does the row at this place take one of the rises of ``floor(frac * place)``?"""
    return F.floor(F.lit(frac) * rank) > F.floor(F.lit(frac) * (rank - 1))


def split_stratified(df: DataFrame, strata_cols: list[str], frac_train: float = 0.8, seed=42,
                     key: str = "id", roles: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Adds ``role``: a share ``frac_train`` of every stratum, and of the whole, gets ``roles[0]``.

    Rows stand in order of (strata, hash); the row at place ``g`` is taken where
    ``floor(frac * g)`` rises.  So a stratum gives the rise of the floor over its rows
    (within one row of ``frac * n_s``), and neighbouring small strata share their rounding:
    exactly ``floor(frac * n)`` rows are taken.  One range exchange on the whole order, so a
    hot stratum is no hot task.
    """
    r = ordered_rank(df.withColumn("_h", hash52(seed, key)), [*strata_cols, "_h", key])
    return r.withColumn("role", F.when(_taken(F.col("_rn"), frac_train), roles[0]).otherwise(roles[1])).drop("_h", "_rn")


def label_order(df: DataFrame, tasks: list[str]) -> list[str]:
    """Tasks from the fewest positives to the most (ties by name): the order in which they can be balanced."""
    n = df.agg(*[F.coalesce(F.sum((F.col(t) == 1).cast("long")), F.lit(0)).alias(t) for t in tasks]).first()
    return sorted(tasks, key=lambda t: (n[t], t))


def label_strata(tasks: list[str]):
    """Stratum of a row: its positives, then its observed labels, with the rarest task leading.

    Rows that share their rarest positives are neighbours in this order, so a split
    along it spreads every task's positives.
    """
    pos = F.concat(*[F.when(F.col(t) == 1, "0").otherwise("1") for t in tasks])
    seen = F.concat(*[F.when(F.col(t).isNull(), "1").otherwise("0") for t in tasks])
    return F.concat_ws("|", pos, seen)


def split_multilabel(df: DataFrame, tasks: list[str], frac_train: float = 0.8, seed=42, key: str = "id",
                     roles: tuple[str, str] = ("train", "test")) -> DataFrame:
    """:func:`split_stratified` over the label patterns of several sparse tasks, rarest task first."""
    d = df.withColumn("_sig", label_strata(label_order(df, tasks)))
    return split_stratified(d, ["_sig"], frac_train, seed, key, roles).drop("_sig")


def greedy_group_fill(histogram: list[tuple[int, int]], cutoff: float) -> dict[int, int]:
    """Biggest-first greedy fill decided on distinct sizes.

    ``histogram``: (group size s, number of groups m).  Going through groups from
    the largest, a group joins train when it still fits under ``cutoff``; among
    the m groups of size s exactly ``min(m, floor((cutoff - filled) / s))`` fit,
    which is what the group-by-group loop yields.  Returns size -> groups taken.
    """
    filled = 0
    take = {}
    for s, m in sorted(histogram, key=lambda t: -t[0]):
        room = cutoff - filled
        t = max(0, min(m, math.floor(room / s))) if room >= s else 0
        take[s] = t
        filled += t * s
    return take


def split_by_group(df: DataFrame, group_col: str, frac_train: float = 0.8, seed=42) -> DataFrame:
    """Whole groups stay together; biggest groups go to train first until full, the rest to test.

    Ties among equal-size groups are broken by hash order of the group key.
    Only the size histogram (at most sqrt(2N) distinct sizes) reaches the driver.
    """
    spark = df.sparkSession
    sizes = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_size"))
    hist_rows = sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("_m")).collect()
    total = sum(r["_size"] * r["_m"] for r in hist_rows)
    take = greedy_group_fill([(r["_size"], r["_m"]) for r in hist_rows], frac_train * total)
    decision = spark.createDataFrame([(int(s), int(t)) for s, t in take.items()] or [(0, 0)],
                                     "_size long, _take long")
    ranked = hash_rank(sizes.withColumn("_h", hash52(seed, group_col)), ["_size"], "_h", [group_col],
                       size_col=None)
    groups = ranked.join(F.broadcast(decision), "_size") \
        .select(group_col, F.when(F.col("_rn") <= F.col("_take"), "train").otherwise("test").alias("role"))
    return join_null_safe(df, groups, [group_col])  # rows without a group are a group of their own


def kfold_stratified(df: DataFrame, label_col: str, k: int = 5, seed=42, key: str = "id") -> DataFrame:
    """k shuffled stratified folds for one task; a NULL label counts as 0. Adds ``fold``."""
    d = df.withColumn("_stratum", F.coalesce(F.col(label_col), F.lit(0)))
    r = _with_rank(d, key, seed, ["_stratum"])
    return r.withColumn("fold", F.pmod(F.col("_rn") - 1, F.lit(k))).drop("_h", "_rn", "_n", "_stratum")


def fill_order(have: list[int], sizes: list[int], n: int) -> list[tuple[int, list[int]]]:
    """Deal ``n`` further positives to the folds that have the fewest: ``[(up to row, folds in turn)]``.

    Folds join in order of what they have, so afterwards the counts differ by no more than
    one, or no fold below the highest could have been given more.  Among equals the fold with the
    fewest rows comes first.
    """
    order = sorted(range(len(have)), key=lambda f: (have[f], sizes[f], f))
    out, dealt = [], 0
    for j in range(1, len(order) + 1):
        if dealt >= n:
            break
        # the j lowest folds take turns until they reach the next one
        level = have[order[j - 1]]
        rise = n if j == len(order) else min(n - dealt, j * (have[order[j]] - level))
        if rise > 0:
            dealt = n if j == len(order) else dealt + rise
            out.append((dealt, order[:j]))
    return out


def _in_turn(rank, segments: list[tuple[int, list[int]]]):
    """Fold of the row at ``rank`` (1-based) under :func:`fill_order`'s segments."""
    fold, start = None, 0
    for upto, folds in segments:
        turn = F.element_at(F.array(*[F.lit(f) for f in folds]), (F.pmod(rank - 1 - start, F.lit(len(folds))) + 1).cast("int"))
        fold = F.when(rank <= upto, turn) if fold is None else fold.when(rank <= upto, turn)
        start = upto
    return fold if fold is not None else F.lit(None).cast("int")


def kfold_multilabel(df: DataFrame, tasks: list[str], k: int = 5, seed=42, key: str = "id") -> DataFrame:
    """Iterative stratification: adds ``fold`` so that every task's positives are spread evenly over the folds.

    A row belongs to its rarest positive task.  Tasks are dealt rarest first: the rows
    of a task, in order of (remaining labels, hash), go in turn to the folds that
    have the fewest positives of it so far, counting those that came with rarer tasks.  Rows without a positive
    even out the folds' sizes in the same way.  A NULL label counts as 0.

    Rows are ranked once; a task costs one aggregate over its own rows, and only
    ``k`` counts per task reach the driver.
    """
    order = label_order(df, tasks)
    owner = F.coalesce(*[F.when(F.col(t) == 1, F.lit(i)) for i, t in enumerate(order)], F.lit(len(order)))
    d = df.withColumn("_own", owner).withColumn("_sig", label_strata(order)).withColumn("_h", hash52(seed, key))
    d = ordered_rank(d, ["_own", "_sig", "_h", key])
    sizes_of = {r["_own"]: (r["lo"], r["n"]) for r in
                d.groupBy("_own").agg(F.min("_rn").alias("lo"), F.count(F.lit(1)).alias("n")).collect()}
    have = {t: [0] * k for t in order}
    sizes, fold = [0] * k, None
    for i in range(len(order) + 1):
        if i not in sizes_of:
            continue
        lo, n = sizes_of[i]
        counts = have[order[i]] if i < len(order) else sizes
        turn = _in_turn(F.col("_rn") - (lo - 1), fill_order(counts, sizes, n))
        fold = F.when(F.col("_own") == i, turn) if fold is None else fold.when(F.col("_own") == i, turn)
        if i < len(order):
            dealt = d.where(F.col("_own") == i).groupBy(turn.alias("f")).agg(
                F.count(F.lit(1)).alias("_n"), *[F.sum((F.col(t) == 1).cast("long")).alias(t) for t in order[i:]]).collect()
            for r in dealt:
                sizes[r["f"]] += r["_n"]
                for t in order[i:]:
                    have[t][r["f"]] += r[t] or 0
    return d.withColumn("fold", fold if fold is not None else F.lit(None).cast("int")).drop("_own", "_sig", "_h", "_rn")


class FoldError(ValueError):
    pass


def fold_guard(folds_long: DataFrame, k: int, raise_on_error: bool = True) -> DataFrame:
    """Positives per (fold, task) in the validation folds; raise if one has none.

    ``folds_long``: ``(id, fold, task, y)``.
    """
    g = folds_long.groupBy("fold", "task").agg(F.coalesce(F.sum("y"), F.lit(0)).alias("n_pos"))
    if raise_on_error:
        bad = g.where(F.col("n_pos") < 1).limit(1).collect()
        if bad:
            raise FoldError(f"fold {bad[0]['fold']} has no positive for task {bad[0]['task']}")
    return g


class OverlapError(ValueError):
    pass


def split_existing(train: DataFrame, test: DataFrame, key: str = "id") -> DataFrame:
    """Train and test come from separate inputs: tag and union (columns by name).

    A key that both inputs hold raises: its row would be in both roles.
    """
    both = train.select(key).join(test.select(key), key, "left_semi").limit(1).collect()
    if both:
        raise OverlapError(f"{key} {both[0][0]!r} is in the train and in the test input")
    return train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test")))
