"""Ranking, threshold and calibration metrics per task, as aggregations.

All threshold metrics come from one base relation: rows are grouped by
(task, score) into positive/negative counts per distinct score, and running
sums in descending score order give the confusion counts at every threshold
(:func:`~tidepool.operators.ranking.prefix_sums`, block-wise so a task with
billions of distinct scores is not sorted in one task).  The curve points'
predecessors are recovered from the same row (running sum minus own count),
so no ``lag`` window is needed.

Conventions (matching the library curves the metrics are defined on):
ROC starts at (0, 0) (threshold +inf, reported as NULL); the precision-recall
curve stops at the first full-recall threshold and ends at (recall 0,
precision 1); balanced accuracy is the maximum over ROC points, ties going to
the highest threshold; ``p >= t`` counts as positive.  A task with one class
only gets NULL threshold metrics.  Rows with y NULL or -1 are unlabelled.  A NaN
score on a labelled row leaves its task's metrics undefined: all of them NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators.ranking import prefix_sums
from tidepool.session import cut_lineage

# Equal-width calibration edges as NumPy's linspace(0, 1, 11) yields them.
ECE_EDGES = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]
ACE_QUANTILES = [i / 10 for i in range(1, 10)]
METRIC_COLUMNS = ["balanced_acc", "f1_score", "specificity", "sensitivity", "roc_auc", "AUPR",
                  "average_precision", "ECE", "ACE"]


def _div(a, b):
    return F.try_divide(a.cast("double"), b.cast("double"))


def labelled(df: DataFrame) -> DataFrame:
    return df.where(F.col("y").isin(0, 1) & F.col("p").isNotNull())


def score_counts(df: DataFrame) -> DataFrame:
    """(task, p, n_pos, n_neg): one row per distinct score (NaN is one); map-side combined."""
    return labelled(df).groupBy("task", "p").agg(
        F.sum((F.col("y") == 1).cast("long")).alias("n_pos"),
        F.sum((F.col("y") == 0).cast("long")).alias("n_neg"))


def threshold_curve(df: DataFrame, blocks: int | None = None) -> DataFrame:
    """(task, p, n_pos, n_neg, cum_n_pos, cum_n_neg, tot_pos, tot_neg) in descending p.

    A task with a NaN score has one row, all NULL but the task.
    """
    base = score_counts(df).withColumn("nan", F.isnan("p").cast("long"))
    cum = prefix_sums(base, ["task"], "p", ["n_pos", "n_neg", "nan"], descending=True, blocks=blocks, total_prefix="tot_")
    undefined = F.col("tot_nan") > 0
    cum = cum.where(~undefined | F.isnan("p"))
    numbers = ["p", "n_pos", "n_neg", "cum_n_pos", "cum_n_neg"]
    cum = cum.select("task", *[F.when(~undefined, F.col(c)).alias(c) for c in numbers],
                     *[F.when(~undefined, F.col(f"tot_n_{c}")).alias(f"tot_{c}") for c in ("pos", "neg")])
    # every metric reads this relation: materialise it once (one row per distinct score)
    return cut_lineage(cum)


def _points(curve: DataFrame) -> DataFrame:
    tp, fp = F.col("cum_n_pos"), F.col("cum_n_neg")
    prev_tp, prev_fp = tp - F.col("n_pos"), fp - F.col("n_neg")
    return curve.select(
        "*",
        _div(tp, F.col("tot_pos")).alias("tpr"), _div(fp, F.col("tot_neg")).alias("fpr"),
        _div(prev_tp, F.col("tot_pos")).alias("tpr_prev"), _div(prev_fp, F.col("tot_neg")).alias("fpr_prev"),
        _div(tp, tp + fp).alias("precision"),
        F.when(prev_tp + prev_fp == 0, F.lit(1.0)).otherwise(_div(prev_tp, prev_tp + prev_fp)).alias("precision_prev"),
        _div(tp, F.col("tot_pos")).alias("recall"), _div(prev_tp, F.col("tot_pos")).alias("recall_prev"))


def roc_curve(curve: DataFrame) -> DataFrame:
    """(task, threshold, fpr, tpr) for every distinct score, plus the (0, 0) start."""
    pts = _points(curve).select("task", F.col("p").alias("threshold"), "fpr", "tpr")
    start = curve.select("task", "tot_pos", "tot_neg").distinct().select(
        "task", F.lit(None).cast("double").alias("threshold"),
        F.when(F.col("tot_neg") > 0, F.lit(0.0)).alias("fpr"), F.when(F.col("tot_pos") > 0, F.lit(0.0)).alias("tpr"))
    return pts.unionByName(start)


def roc_auc(curve: DataFrame) -> DataFrame:
    area = (F.col("fpr") - F.col("fpr_prev")) * (F.col("tpr") + F.col("tpr_prev")) / 2
    return _points(curve).groupBy("task").agg(F.sum(area).alias("roc_auc"))


def sens_spec(curve: DataFrame) -> DataFrame:
    """(task, balanced_acc, sensitivity, specificity, threshold) at the best ROC point."""
    pts = _points(curve).withColumn("bacc", (F.col("tpr") + (F.lit(1.0) - F.col("fpr"))) / 2)
    best = pts.groupBy("task").agg(
        F.max_by(F.struct("bacc", "tpr", "fpr", "p"), F.struct("bacc", "p")).alias("b"))
    start_wins = ~(F.col("b.bacc") > 0.5)
    return best.select(
        "task",
        F.when(F.col("b.bacc").isNull(), None).when(start_wins, F.lit(0.5)).otherwise(F.col("b.bacc"))
        .alias("balanced_acc"),
        F.when(F.col("b.bacc").isNull(), None).when(start_wins, F.lit(0.0)).otherwise(F.col("b.tpr"))
        .alias("sensitivity"),
        F.when(F.col("b.bacc").isNull(), None).when(start_wins, F.lit(1.0)).otherwise(F.lit(1.0) - F.col("b.fpr"))
        .alias("specificity"),
        F.when(~start_wins, F.col("b.p")).alias("threshold"))


def balanced_acc(curve: DataFrame) -> DataFrame:
    return sens_spec(curve).select("task", "balanced_acc")


def _on_pr():
    # The curve stops at the first threshold that reaches full recall.
    return F.col("cum_n_pos") - F.col("n_pos") < F.col("tot_pos")


def pr_curve(curve: DataFrame) -> DataFrame:
    """(task, threshold, precision, recall) down to full recall, plus the (recall 0, precision 1) end."""
    pts = _points(curve).where(_on_pr()).select("task", F.col("p").alias("threshold"), "precision", "recall")
    end = curve.where(F.col("tot_pos") > 0).select("task").distinct().select(
        "task", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def aupr(curve: DataFrame) -> DataFrame:
    area = (F.col("recall") - F.col("recall_prev")) * (F.col("precision") + F.col("precision_prev")) / 2
    return _points(curve).groupBy("task").agg(F.sum(F.when(_on_pr(), area)).alias("AUPR"))


def average_precision(curve: DataFrame) -> DataFrame:
    term = (F.col("recall") - F.col("recall_prev")) * F.col("precision")
    return _points(curve).groupBy("task").agg(F.sum(F.when(_on_pr(), term)).alias("average_precision"))


def best_f1(curve: DataFrame) -> DataFrame:
    """Maximum F1 over the precision-recall thresholds (one scan, not one pass per threshold)."""
    f1 = _div(2 * F.col("cum_n_pos"), F.col("cum_n_pos") + F.col("cum_n_neg") + F.col("tot_pos"))
    return _points(curve).groupBy("task").agg(F.max(F.when(_on_pr(), f1)).alias("f1_score"))


def f1_at_threshold(curve: DataFrame) -> DataFrame:
    """F1 at the balanced-accuracy threshold (in-training metric); 0 when that is the +inf start."""
    ss = sens_spec(curve).select("task", F.col("threshold").alias("thr"))
    tot = curve.select("task", "tot_pos").distinct()
    at = curve.join(F.broadcast(ss), "task").where(F.col("p") == F.col("thr")) \
        .select("task", _div(2 * F.col("cum_n_pos"), F.col("cum_n_pos") + F.col("cum_n_neg") + F.col("tot_pos")).alias("f1"))
    return tot.join(at, "task", "left").select(
        "task", F.when(F.col("tot_pos") > 0, F.coalesce(F.col("f1"), F.lit(0.0))).alias("f1_at_threshold"))


def _bin_index(edges) -> "F.Column":
    idx = F.lit(0)
    for e in edges:
        idx = idx + (F.col("p") >= e).cast("int")
    return idx


def _calibration(binned: DataFrame, name: str) -> DataFrame:
    n_b = F.col("n_pos") + F.col("n_neg")
    per_bin = binned.groupBy("task", "bin").agg(
        F.sum(n_b).alias("nb"), F.sum("n_pos").alias("pos"), F.sum(F.col("p") * n_b).alias("psum"))
    # sum over bins of nb / n * |pos / nb - psum / nb|, n being the sum of nb
    error = F.sum(F.abs(F.col("pos") - F.col("psum"))) / F.sum("nb")
    return per_bin.groupBy("task").agg(F.when(~F.isnan(error), error).alias(name))


def ece(counts: DataFrame) -> DataFrame:
    """Expected calibration error, 10 equal-width bins (bin = number of edges <= p).

    Reads (task, p, n_pos, n_neg) rows, or :func:`score_rows`: binning comes first, so at
    most ten partial rows per task and map task are exchanged.
    """
    return _calibration(counts.withColumn("bin", _bin_index([F.lit(e) for e in ECE_EDGES])), "ECE")


def score_rows(df: DataFrame) -> DataFrame:
    """Labelled rows as (task, p, n_pos, n_neg), not combined by score."""
    return labelled(df).select("task", "p", (F.col("y") == 1).cast("long").alias("n_pos"),
                               (F.col("y") == 0).cast("long").alias("n_neg"))


def quantile_edges(curve: DataFrame, quantiles=ACE_QUANTILES) -> DataFrame:
    """(task, edges array) : linear-interpolation percentiles of p (NumPy's default method).

    Exact order statistics come from the running counts: the value at
    ascending rank r is the score whose count range covers r.  The lookup
    joins every curve row with the (task x 9 x 2) ranks on task, then a
    range filter; the rank side is tiny.
    """
    n_tot = curve.select("task", (F.col("tot_pos") + F.col("tot_neg")).alias("n")).distinct()
    pos = n_tot.select("task", "n", F.posexplode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("qi", "q"))
    pos = pos.withColumn("pos", (F.col("n") - 1).cast("double") * F.col("q")) \
        .withColumn("lo", F.floor("pos").cast("long")).withColumn("hi", F.ceil("pos").cast("long")) \
        .withColumn("d", F.col("pos") - F.col("lo"))
    ranks = pos.select("task", "qi", "d", F.col("lo").alias("r"), F.lit("lo").alias("side")).unionByName(
        pos.select("task", "qi", "d", F.col("hi").alias("r"), F.lit("hi").alias("side")))
    cnt = F.col("n_pos") + F.col("n_neg")
    rows = curve.select("task", "p", (F.col("tot_pos") + F.col("tot_neg") - F.col("cum_n_pos") - F.col("cum_n_neg")).alias("asc0"),
                        cnt.alias("c"))
    hit = rows.join(F.broadcast(ranks), "task") \
        .where((F.col("r") >= F.col("asc0")) & (F.col("r") < F.col("asc0") + F.col("c")))
    vals = hit.groupBy("task", "qi", "d").agg(
        F.max(F.when(F.col("side") == "lo", F.col("p"))).alias("vlo"),
        F.max(F.when(F.col("side") == "hi", F.col("p"))).alias("vhi"))
    diff = F.col("vhi") - F.col("vlo")
    edge = F.when(F.col("d") >= 0.5, F.col("vhi") - diff * (F.lit(1.0) - F.col("d"))) \
        .otherwise(F.col("vlo") + diff * F.col("d"))
    return vals.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("qi", edge.alias("e")))).alias("_es")) \
        .select("task", F.transform("_es", lambda s: s["e"]).alias("edges"))


def ace(curve: DataFrame) -> DataFrame:
    """Adaptive calibration error: bins at the deciles of p."""
    edges = quantile_edges(curve)
    counts = curve.select("task", "p", "n_pos", "n_neg").join(F.broadcast(edges), "task", "left")  # one row per task (label columns)
    binned = counts.withColumn("bin", _bin_index([F.col("edges")[i] for i in range(len(ACE_QUANTILES))]))
    return _calibration(binned, "ACE")


def threshold_metrics(curve: DataFrame) -> DataFrame:
    """All threshold metrics in one aggregation pass over the curve:
    balanced_acc, sensitivity, specificity, f1_score, roc_auc, AUPR, average_precision."""
    pts = _points(curve).withColumn("bacc", (F.col("tpr") + (F.lit(1.0) - F.col("fpr"))) / 2)
    on_pr = _on_pr()
    roc_area = (F.col("fpr") - F.col("fpr_prev")) * (F.col("tpr") + F.col("tpr_prev")) / 2
    pr_area = (F.col("recall") - F.col("recall_prev")) * (F.col("precision") + F.col("precision_prev")) / 2
    ap_term = (F.col("recall") - F.col("recall_prev")) * F.col("precision")
    f1 = _div(2 * F.col("cum_n_pos"), F.col("cum_n_pos") + F.col("cum_n_neg") + F.col("tot_pos"))
    agg = pts.groupBy("task").agg(
        F.max_by(F.struct("bacc", "tpr", "fpr"), F.struct("bacc", "p")).alias("b"),
        F.max(F.when(on_pr, f1)).alias("f1_score"),
        F.sum(roc_area).alias("roc_auc"),
        F.sum(F.when(on_pr, pr_area)).alias("AUPR"),
        F.sum(F.when(on_pr, ap_term)).alias("average_precision"))
    start_wins = ~(F.col("b.bacc") > 0.5)
    undefined = F.col("b.bacc").isNull()
    return agg.select(
        "task",
        F.when(undefined, None).when(start_wins, F.lit(0.5)).otherwise(F.col("b.bacc")).alias("balanced_acc"),
        "f1_score",
        F.when(undefined, None).when(start_wins, F.lit(1.0)).otherwise(F.lit(1.0) - F.col("b.fpr"))
        .alias("specificity"),
        F.when(undefined, None).when(start_wins, F.lit(0.0)).otherwise(F.col("b.tpr")).alias("sensitivity"),
        "roc_auc", "AUPR", "average_precision")


def metrics_table(curve: DataFrame) -> DataFrame:
    """Nine metrics per task in the report's column order (three aggregation passes)."""
    counts = curve.select("task", "p", "n_pos", "n_neg")
    out = threshold_metrics(curve).join(ece(counts), "task", "full_outer").join(ace(curve), "task", "full_outer")
    return out.select("task", *METRIC_COLUMNS)


def metrics_report(curve: DataFrame, iteration: int | None = None) -> DataFrame:
    """Per-task rows plus a ``mean`` row (NULL-skipping average over tasks) via rollup."""
    per_task = metrics_table(curve)
    rep = per_task.rollup("task").agg(*[F.avg(c).alias(c) for c in METRIC_COLUMNS],
                                      F.grouping("task").alias("_g"))
    rep = rep.select(F.when(F.col("_g") == 1, F.lit("mean")).otherwise(F.col("task")).alias("Tasks"),
                     *METRIC_COLUMNS)
    if iteration is not None:
        rep = rep.select(F.lit(iteration).cast("long").alias("iteration"), "*")
    return rep


def nanmean_metrics(per_task: DataFrame, cols=METRIC_COLUMNS) -> DataFrame:
    """Mean of each metric over tasks, ignoring undefined (NULL) values."""
    return per_task.agg(*[F.avg(c).alias(c) for c in cols])
