"""Label weights and losses as aggregations over ``(task, z logit, y)``.

Each loss is a row expression (written in the numerically stable form of
BCE-with-logits) followed by an average over labelled cells; per task and an
overall row come from one ``rollup`` on task.  A missing label is NULL (or -1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOCAL_CLAMP = 1e-8


class WeightError(ValueError):
    pass


def target_weights(cells: DataFrame, check: bool = True) -> DataFrame:
    """(task, w): negatives / positives per task, divided by their mean over tasks."""
    lab = cells.where(F.col("y").isin(0, 1))
    ratio = lab.groupBy("task").agg(
        F.try_divide(F.sum((F.col("y") == 0).cast("double")), F.sum((F.col("y") == 1).cast("double"))).alias("r"))
    # the mean over tasks is a window over the (tasks-row) ratio table
    out = ratio.select("task", F.try_divide(F.col("r"), F.avg("r").over(Window.partitionBy(F.lit(0)))).alias("w"))
    if check:
        bad = out.where(F.col("w").isNull() | (F.col("w") < 0)).limit(1).collect()
        if bad:
            raise WeightError(f"target weight of task {bad[0]['task']} is undefined or negative")
    return out


def blend_weights(weights: DataFrame, tasks: DataFrame, factor: float, check: bool = True,
                  single_task_one: bool = False) -> DataFrame:
    """(task, w): ``factor * w + (1 - factor)`` for each wanted task; a missing weight raises.

    ``tasks``: one column ``task``.  With ``single_task_one`` and one task the weight is 1.0
    (the class-weight rule).
    """
    j = tasks.select("task").distinct().join(weights, "task", "left")
    out = j.select("task", (F.lit(factor) * F.col("w") + F.lit(1.0 - factor)).alias("w"))
    if single_task_one:
        n = tasks.select("task").distinct().count()
        if n == 1:
            return out.select("task", F.lit(1.0).alias("w"))
    if check:
        bad = out.where(F.col("w").isNull()).limit(1).collect()
        if bad:
            raise WeightError(f"no weight for task {bad[0]['task']}")
    return out


def pos_weights(weights: DataFrame, tasks: DataFrame, alpha: float, check: bool = True) -> DataFrame:
    return blend_weights(weights, tasks, alpha, check)


def class_weights(weights: DataFrame, tasks: DataFrame, beta: float, check: bool = True) -> DataFrame:
    return blend_weights(weights, tasks, beta, check, single_task_one=True)


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce_with_logits(z: Column, y: Column, pos_weight: Column | None = None) -> Column:
    """-(pw y ln s(z) + (1-y) ln(1-s(z))) = pw y softplus(-z) + (1-y) softplus(z)."""
    pw = pos_weight if pos_weight is not None else F.lit(1.0)
    return pw * y * softplus(-z) + (F.lit(1.0) - y) * softplus(z)


def _labelled(df: DataFrame) -> DataFrame:
    return df.where(F.col("y").isin(0, 1))


def _per_task(df: DataFrame, num: Column, name: str, den: Column | None = None) -> DataFrame:
    """Per task and overall ('all') ratio of sums over labelled cells."""
    den = den if den is not None else F.lit(1.0)
    r = df.rollup("task").agg(F.try_divide(F.sum(num), F.sum(den)).alias(name), F.grouping("task").alias("_g"))
    return r.select(F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col("task")).alias("task"), name)


def masked_bce(df: DataFrame) -> DataFrame:
    d = _labelled(df)
    return _per_task(d, bce_with_logits(F.col("z"), F.col("y")), "bce")


def weighted_bce(df: DataFrame, pos_w: DataFrame, class_w: DataFrame) -> DataFrame:
    """Weighted BCE summed over labelled cells, divided by their count."""
    d = _labelled(df).join(F.broadcast(pos_w.withColumnRenamed("w", "pw")), "task") \
        .join(F.broadcast(class_w.withColumnRenamed("w", "cw")), "task")
    loss = F.col("cw") * bce_with_logits(F.col("z"), F.col("y"), F.col("pw"))
    return _per_task(d, loss, "weighted_bce")


def focal_loss(df: DataFrame, pos_w: DataFrame, gamma: float = 2.0) -> DataFrame:
    """-w_p (1-p)^g y ln p - p^g (1-y) ln(1-p), logs clamped at 1e-8."""
    d = _labelled(df).join(F.broadcast(pos_w.withColumnRenamed("w", "pw")), "task")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z")))
    y = F.col("y")
    g = F.lit(gamma)
    loss = (-F.col("pw") * F.pow(F.lit(1.0) - p, g) * y * F.log(F.greatest(p, F.lit(FOCAL_CLAMP)))
            - F.pow(p, g) * (F.lit(1.0) - y) * F.log(F.greatest(F.lit(1.0) - p, F.lit(FOCAL_CLAMP))))
    return _per_task(d, loss, "focal_loss")


def focal_loss_v2(df: DataFrame, gamma: float = 2.0, alpha: float = -1.0) -> DataFrame:
    """BCE * (1 - p_t)^gamma, times alpha_t when alpha >= 0."""
    d = _labelled(df)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z")))
    y = F.col("y")
    p_t = p * y + (F.lit(1.0) - p) * (F.lit(1.0) - y)
    loss = bce_with_logits(F.col("z"), y) * F.pow(F.lit(1.0) - p_t, F.lit(gamma))
    if alpha >= 0:
        loss = (F.lit(alpha) * y + F.lit(1.0 - alpha) * (F.lit(1.0) - y)) * loss
    return _per_task(d, loss, "focal_loss_v2")


def pos_neg_loss(df: DataFrame) -> DataFrame:
    """Mean BCE over positives, over negatives, and their geometric mean."""
    d = _labelled(df)
    bce = bce_with_logits(F.col("z"), F.col("y"))
    r = d.rollup("task").agg(
        F.try_divide(F.sum(F.when(F.col("y") == 1, bce)), F.sum((F.col("y") == 1).cast("double"))).alias("pos_loss"),
        F.try_divide(F.sum(F.when(F.col("y") == 0, bce)), F.sum((F.col("y") == 0).cast("double"))).alias("neg_loss"),
        F.grouping("task").alias("_g"))
    return r.select(F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col("task")).alias("task"),
                    "pos_loss", "neg_loss", F.sqrt(F.col("pos_loss") * F.col("neg_loss")).alias("gm_loss"))
