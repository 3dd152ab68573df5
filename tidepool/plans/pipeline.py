"""End-to-end entry points driven by a plain configuration dictionary.

* :func:`fingerprint_job`  — string column of a file -> fingerprint table + reject table
* :func:`active_learning_run` — read labels and features, split, seed set,
  pool/validation split, then the loop with history and metrics per iteration

Configuration keys follow the established key names where they exist
(``target_file``, ``BERT_features_file``, ``ECFP_features_file``,
``Compound_col``, ``features_type``, ``splitter``, ``train_frac``,
``selected_tasks``, ``main_task``, ``main_task_initial_set_samples``,
``sampling_strategy``, ``num_forward_passes``, ``n_query``,
``num_iterations``, ``ucb_beta``, ``dropout_p``, ``seed``,
``train_test_split_exists``, ``aux_task``, ``aux_task_samples``).  Keys added here:
``surrogate`` (``centroid`` or ``logistic``), ``output_dir`` (folder for the
initial set, the validation set, history and metrics tables), ``group_col`` (group key for the scaffold-style
split, since no chemistry is computed), ``butina_threshold`` and ``run_id``.

With ``train_test_split_exists`` each side has its own files (``train_target_file``,
``test_target_file`` and ``train_`` / ``test_`` forms of the feature files), loaded by the same
rules; a key on both sides raises.  Sides that are only listed (``train_file`` and
``test_file`` with the keys) select from ``target_file``.  ``use_all_tasks_to_split`` draws the split on
``all_tasks``; the run then goes on with ``selected_tasks`` only.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import cluster as clu
from tidepool.operators import fingerprint as fp
from tidepool.operators import reshape as rs
from tidepool.operators import sampling as smp
from tidepool.operators import split as sp
from tidepool.operators.scoring import DEFAULT_DROPOUT
from tidepool.plans import loop as lp
from tidepool.session import cut_lineage
from tidepool.sources import io as sio

log = logging.getLogger("tidepool")

SPLITTERS = ("ScaffoldSplitter", "ButinaSplitter", "RandomSplitter", "RandomStratifiedSplitter")
BUTINA_SIMILARITY = 0.4


def fingerprint_job(spark: SparkSession, input_path: str, output_path: str, column: str = "SMILES",
                    size: int = fp.DEFAULT_SIZE, radius: int = fp.DEFAULT_RADIUS, key: str | None = None) -> dict:
    """Read a file, fingerprint one string column, write ``output_path`` and ``<output>_failed``.

    Rows are numbered in file order (``Row_Index``) unless ``key`` names an id
    column.  Returns the totals (processed, succeeded, failed).
    """
    df = sio.read_table(spark, input_path, normalize=False)
    if column not in df.columns:
        raise ValueError(f"{input_path} has no column {column!r}; it has {df.columns}")
    if key is None:
        # row number in file order; deterministic for a given file listing, so both
        # outputs (and any retried task) see the same numbers without materialising
        df = df.withColumn("Row_Index", F.monotonically_increasing_id())
        key = "Row_Index"
    fps, bad = fp.hash_fingerprint(df, column, key, size=size, radius=radius)
    good = df.join(fps, key).select(key, column, "bits")
    sio.write_table(good, output_path)
    sio.write_table(bad, output_path.rstrip("/") + "_failed")
    totals = {r["status"]: r["n"] for r in fp.quarantine_summary(df, column).collect()}
    out = {"processed": sum(totals.values()), "succeeded": totals.get("ok", 0),
           "failed": sum(v for k, v in totals.items() if k != "ok")}
    log.info("fingerprints: %s", out)
    return out


def _dense_features(spark: SparkSession, path: str, key_col: str) -> DataFrame:
    """Wide feature file (key column, then numeric columns) -> (id, x array<float>)."""
    return sio.read_features(spark, path, key_col)


def _bits_from_dense(feats: DataFrame) -> DataFrame:
    """0/1 fingerprint vectors -> sorted set bits, for the cluster split."""
    idx = F.filter(F.transform("x", lambda v, i: F.when(v > 0.5, i)), lambda i: i.isNotNull())
    return feats.select("id", idx.alias("bits"))


def _file_order() -> "F.Column":
    """Order of rows as read: (file, position).  Used for keep-first deduplication."""
    return F.struct(F.input_file_name(), F.monotonically_increasing_id())


def load_labelled(spark: SparkSession, config: dict, side: str = "") -> tuple[DataFrame, DataFrame]:
    """(cells ``(id, task, y)``, features ``(id, x)``) with the key-consistency rules applied:
    labels keep only keys with features, one row per key (first in file order), and
    features keep only labelled keys — always joined by key, never by position.

    ``side``: ``train_`` or ``test_`` where the split exists and each side has its own files."""
    key = config.get("Compound_col", "SMILES")
    tasks = split_tasks(config)
    labels = sio.read_table(spark, config[f"{side}target_file"], normalize=True, label_cols=tasks)
    ftype = config.get("features_type", "BERT")
    feat_path = config[f"{side}ECFP_features_file" if ftype == "FP" else f"{side}BERT_features_file"]
    feat_key = config.get("features_key_col", "SMILES")
    feats = _dense_features(spark, feat_path, feat_key)
    # text keys are read as strings: they take the type of the labels' key (one that cannot have no label)
    feats = feats.withColumn("id", F.col("id").try_cast(labels.schema[key].dataType))
    feats = rs.dedup_keep_first(feats.withColumn("_o", _file_order()), ["id"], ["_o"]).drop("_o")
    wide = labels.select(F.col(key).alias("id"), *[F.col(t).cast("double").alias(t) for t in tasks],
                         _file_order().alias("_o"))
    wide = rs.labels_with_features(wide, feats)
    wide = rs.dedup_keep_first(wide, ["id"], ["_o"]).drop("_o")
    wide = cut_lineage(wide.select("id", *tasks))
    feats = cut_lineage(rs.features_for_labels(feats, wide))
    return rs.melt_labels(wide, tasks, keep_null=True), feats


def split_train_test(cells: DataFrame, feats: DataFrame, config: dict, split_seed: int = 42) -> DataFrame:
    """Role per id (train/test) with the configured splitter."""
    frac = float(config.get("train_frac", 0.8))
    splitter = config.get("splitter", "RandomSplitter")
    ids = cells.select("id").distinct()
    if splitter == "RandomSplitter":
        return sp.split_random(ids, frac, split_seed)
    if splitter == "RandomStratifiedSplitter":
        tasks = split_tasks(config)
        return sp.split_multilabel(rs.to_wide(cells, tasks), tasks, frac, split_seed).select("id", "role")
    if splitter == "ScaffoldSplitter":
        gcol = config.get("group_col")
        if not gcol:
            raise ValueError("ScaffoldSplitter needs 'group_col' (no chemistry is computed here)")
        groups = sio.read_table(spark_of(cells), config["target_file"]) \
            .select(F.col(config.get("Compound_col", "SMILES")).alias("id"), F.col(gcol).alias("_grp"), _file_order().alias("_o"))
        groups = rs.dedup_keep_first(groups, ["id"], ["_o"]).drop("_o")  # a repeated key has the group of its first row
        return sp.split_by_group(ids.join(groups, "id"), "_grp", frac, split_seed).select("id", "role")
    if splitter == "ButinaSplitter":
        bits = _bits_from_dense(feats.join(ids, "id", "left_semi"))
        # the cluster split's customary distance cutoff is 0.6, i.e. Jaccard similarity >= 0.4
        thr = float(config.get("butina_threshold", BUTINA_SIMILARITY))
        return clu.split_by_cluster(ids, bits, "id", frac, split_seed, thr).select("id", "role")
    raise ValueError(f"Invalid splitter: {splitter}")


def task_list(config: dict) -> list[str]:
    """``selected_tasks`` may be one name or a list."""
    tasks = config["selected_tasks"]
    return [tasks] if isinstance(tasks, str) else list(tasks)


def split_tasks(config: dict) -> list[str]:
    """Tasks that the train/test split looks at."""
    return list(config["all_tasks"]) if config.get("use_all_tasks_to_split") else task_list(config)


def load_split(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells of the selected tasks, features, roles): read, and split or tagged as the configuration says."""
    if config.get("train_test_split_exists") and "train_target_file" in config:
        (train, train_x), (test, test_x) = (load_labelled(spark, config, side) for side in ("train_", "test_"))
        roles = sp.split_existing(train.select("id").distinct(), test.select("id").distinct(), "id")
        cells, feats = train.unionByName(test), train_x.unionByName(test_x)
    else:
        cells, feats = load_labelled(spark, config)
        if config.get("train_test_split_exists"):
            key = F.col(config.get("Compound_col", "SMILES")).alias("id")
            roles = sp.split_existing(*(sio.read_table(spark, config[f]).select(key).distinct()
                                        for f in ("train_file", "test_file")), "id")
        else:
            roles = split_train_test(cells, feats, config)
    if config.get("use_all_tasks_to_split"):
        cells = cells.where(F.col("task").isin(task_list(config)))
    return cells, feats, cut_lineage(roles)


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def active_learning_run(spark: SparkSession, config: dict) -> dict:
    """Entry A: the whole run.  Returns final working sets and the history paths.

    Test split uses ``split_seed`` 42 for every run (the same test set across
    seeds); the seed set and the pool/validation split use the run's ``seed``.
    A history already holding iterations is resumed, not recomputed.
    """
    seed = int(config.get("seed", 0))
    tasks = task_list(config)
    main = config.get("main_task", tasks[0])
    out_dir = config["output_dir"].rstrip("/")
    cells, feats, roles = load_split(spark, config)
    train_all = cells.join(roles.where(F.col("role") == "train"), "id", "left_semi")
    test_cells = cut_lineage(cells.join(roles.where(F.col("role") == "test"), "id", "left_semi"))
    n0 = int(config.get("main_task_initial_set_samples", 100))
    seed_set = smp.seed_set_balanced(train_all, main, n0, seed).select("id", "task", "y")
    if config.get("aux_task") and config.get("aux_task_samples"):
        aux = [config["aux_task"]] if isinstance(config["aux_task"], str) else list(config["aux_task"])
        seed_set = seed_set.unionByName(smp.seed_set_aux(train_all, aux, int(config["aux_task_samples"]), seed)
                                        .select("id", "task", "y"))
    seed_set = cut_lineage(seed_set)
    sio.write_table(seed_set, f"{out_dir}/initial_set")
    rest = smp.remainder_pool(train_all, seed_set, by="cells")
    # pool / validation 85 / 15, stratified on the label patterns, with the run seed; read by both sides
    pv = cut_lineage(sp.split_multilabel(rs.to_wide(rest, tasks), tasks, 0.85, seed, roles=("pool", "val")).select("id", "role"))
    pool = rest.join(pv.where(F.col("role") == "pool"), "id", "left_semi")
    val = rest.join(pv.where(F.col("role") == "val"), "id", "left_semi")
    sio.write_table(val, f"{out_dir}/validation")
    step = lp.StepConfig(strategy=config.get("sampling_strategy", "BALD"), n_query=int(config.get("n_query", 1)),
                         passes=int(config.get("num_forward_passes", 20)), seed=seed,
                         ucb_beta=float(config.get("ucb_beta", 2.0)), main_task=main, dropout=float(config.get("dropout_p", DEFAULT_DROPOUT)))
    run = lp.RunConfig(surrogate=config.get("surrogate", "centroid"), run_id=int(config.get("run_id", 0)), iterations=int(config.get("num_iterations", 1)),
                       step=step, history_path=f"{out_dir}/query_history", metrics_path=f"{out_dir}/metrics_history")
    target_feats = feats.join(test_cells.select("id").distinct(), "id", "left_semi")
    res = lp.al_run(seed_set, pool, feats, run, test_cells=test_cells, target_feats=target_feats)
    res.update(history=run.history_path, metrics=run.metrics_path)
    return res
