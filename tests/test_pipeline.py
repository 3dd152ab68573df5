"""Entry points driven by a configuration dictionary, on files written from the driver tables."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidepool.operators import reshape as rs
from tidepool.operators.split import OverlapError
from tidepool.plans import pipeline as pl
from tidepool.session import scratch_path
from tidepool.sources import io as sio
from tidepool.sources import testdata as td


def _files(spark):
    base = scratch_path(spark, "pipeline")
    cells = td.emb_cells(spark, SF_SMALL)
    wide = rs.to_wide(cells, td.EMB_TASKS).withColumnRenamed("id", "X")
    wide = wide.join(td.table(spark, SF_SMALL, "documents").select(F.col("doc_id").alias("X"), "source"), "X", "left")
    sio.write_table(wide, f"{base}/labels.tab", fmt="tab")
    feats = rs.unpack_features(td.emb_features(spark, SF_SMALL).withColumnRenamed("id", "SMILES"), 64)
    sio.write_table(feats, f"{base}/bert.csv", fmt="csv")
    return base


def test_active_learning_run_from_config(spark):
    base = _files(spark)
    config = {"target_file": f"{base}/labels.tab", "BERT_features_file": f"{base}/bert.csv",
              "Compound_col": "X", "features_type": "BERT", "splitter": "RandomStratifiedSplitter",
              "train_frac": 0.8, "selected_tasks": ["t0", "t1", "t2"], "main_task": "t0",
              "main_task_initial_set_samples": 10, "sampling_strategy": "BALD", "num_forward_passes": 4,
              "n_query": 2, "num_iterations": 2, "seed": 5, "output_dir": f"{base}/out"}
    res = pl.active_learning_run(spark, config)
    hist = spark.read.parquet(res["history"])
    assert hist.count() == 4
    # pool and validation keep their 85 / 15 of the rows that are left (20 queried cells or fewer apart)
    val = spark.read.parquet(f"{base}/out/validation").select("id").distinct().count()
    rest = spark.read.parquet(f"{base}/out/validation").select("id").union(res["pool"].select("id")).distinct().count()
    assert abs(val / rest - 0.15) < 0.01
    assert spark.read.parquet(res["metrics"]).where("Tasks = 'mean'").count() == 2
    # resume: same config again adds nothing
    pl.active_learning_run(spark, config)
    assert spark.read.parquet(res["history"]).count() == 4


def test_group_split_from_config(spark):
    base = _files(spark)
    config = {"target_file": f"{base}/labels.tab", "BERT_features_file": f"{base}/bert.csv",
              "Compound_col": "X", "selected_tasks": ["t0"], "splitter": "ScaffoldSplitter",
              "group_col": "source", "train_frac": 0.8}
    cells, feats = pl.load_labelled(spark, config)
    roles = pl.split_train_test(cells, feats, config)
    per_group = roles.join(sio.read_table(spark, f"{base}/labels.tab").select(F.col("X").alias("id"), "source"), "id") \
        .groupBy("source").agg(F.countDistinct("role").alias("r"))
    assert per_group.agg(F.max("r")).first()[0] == 1


def test_fingerprint_job(spark):
    base = scratch_path(spark, "fpjob")
    docs = td.table(spark, SF_SMALL, "documents").select("doc_id", F.col("text").alias("SMILES"))
    docs = docs.unionByName(spark.createDataFrame([(10_000, None), (10_001, "!!!")], "doc_id long, SMILES string"))
    sio.write_table(docs, f"{base}/in.parquet")
    totals = pl.fingerprint_job(spark, f"{base}/in.parquet", f"{base}/out", "SMILES", size=2048, radius=6,
                                key="doc_id")
    assert totals == {"processed": docs.count(), "succeeded": docs.count() - 2, "failed": 2}
    assert spark.read.parquet(f"{base}/out_failed").count() == 2


def test_cli_fingerprints(spark):
    from tidepool.cli import main
    base = scratch_path(spark, "cli")
    docs = td.table(spark, SF_SMALL, "documents").select(F.col("text").alias("SMILES"))
    sio.write_table(docs, f"{base}/in.parquet")
    assert main(["fingerprints", "-i", f"{base}/in.parquet", "-o", f"{base}/out", "-s", "SMILES"]) == 0
    assert spark.read.parquet(f"{base}/out").count() == docs.count()


def test_cluster_split_from_config(spark):
    base = _files(spark)
    fps = td.emb_features(spark, SF_SMALL).select(
        F.col("id").alias("SMILES"), *[(F.col("x")[i] > 0).cast("double").alias(f"MF_{i}") for i in range(64)])
    sio.write_table(fps, f"{base}/mf.csv", fmt="csv")
    config = {"target_file": f"{base}/labels.tab", "ECFP_features_file": f"{base}/mf.csv", "features_type": "FP",
              "Compound_col": "X", "selected_tasks": ["t0"], "splitter": "ButinaSplitter", "train_frac": 0.8}
    cells, feats = pl.load_labelled(spark, config)
    roles = pl.split_train_test(cells, feats, config)
    n = roles.count()
    assert n == cells.select("id").distinct().count()
    assert roles.where("role = 'train'").count() <= 0.8 * n


def test_sides_with_their_own_files(spark):
    base = _files(spark)
    for side, keep in (("train", "X % 4 != 0"), ("test", "X % 4 = 0")):
        sio.write_table(sio.read_table(spark, f"{base}/labels.tab").where(keep), f"{base}/{side}.tab", fmt="tab")
        sio.write_table(sio.read_table(spark, f"{base}/bert.csv").where(keep.replace("X", "SMILES")), f"{base}/{side}.csv", fmt="csv")
    config = {"train_test_split_exists": True, "Compound_col": "X", "selected_tasks": ["t0", "t1"], "main_task": "t0",
              "all_tasks": td.EMB_TASKS, "use_all_tasks_to_split": True,
              **{f"{s}_target_file": f"{base}/{s}.tab" for s in ("train", "test")},
              **{f"{s}_BERT_features_file": f"{base}/{s}.csv" for s in ("train", "test")}}
    cells, feats, roles = pl.load_split(spark, config)
    assert {r["task"] for r in cells.select("task").distinct().collect()} == {"t0", "t1"}
    assert {(r["id"] % 4 == 0, r["role"]) for r in roles.collect()} == {(True, "test"), (False, "train")}
    assert feats.count() == roles.count() == td.emb_features(spark, SF_SMALL).count()
    with pytest.raises(OverlapError):
        pl.load_split(spark, {**config, "test_target_file": f"{base}/train.tab", "test_BERT_features_file": f"{base}/train.csv"})
    whole = {k: v for k, v in config.items() if not k.startswith("train_") and not k.startswith("test_")}
    whole.update(target_file=f"{base}/labels.tab", BERT_features_file=f"{base}/bert.csv", splitter="RandomStratifiedSplitter")
    cells, _, roles = pl.load_split(spark, whole)   # split on ten tasks, go on with two
    assert {r["task"] for r in cells.select("task").distinct().collect()} == {"t0", "t1"}
    n = roles.count()
    assert roles.where("role = 'train'").count() == int(0.8 * n)


def test_wide_text_never_becomes_columns(spark, tmp_path):
    width = 2048
    head = ",".join(["SMILES", *[f"u{i}" for i in range(width)]])
    rows = ['"C(C,""x"")O",' + ",".join(str(i % 7) for i in range(width)),
            "CC," + ",".join(["NaN", "", "bad"] + ["0.5"] * (width - 3))]
    folder = tmp_path / "wide.csv"
    folder.mkdir()
    (folder / "a.csv").write_text(head + "\n" + rows[0] + "\n")
    (folder / "b.csv").write_text(head + "\n" + rows[1] + "\n")
    df = sio.read_features(spark, str(folder), "SMILES")
    got = {r["id"]: list(r["x"]) for r in df.collect()}
    assert got['C(C,"x")O'] == [float(i % 7) for i in range(width)]
    assert got["CC"] == [None, None, None] + [0.5] * (width - 3)
    plan = df._jdf.queryExecution().toString()
    assert "u100" not in plan and plan.count("FileScan") == 1


def test_key_column_in_the_middle(spark, tmp_path):
    (tmp_path / "m.tab").write_text("a\tkey\tb\n1\tk 1\t2\n3\tk2\t4.5\n")
    got = {r["id"]: list(r["x"]) for r in sio.read_features(spark, str(tmp_path / "m.tab"), "key").collect()}
    assert got == {"k 1": [1.0, 2.0], "k2": [3.0, 4.5]}
    (tmp_path / "e.tab").write_text("x\tkey\n")
    assert sio.read_features(spark, str(tmp_path / "e.tab"), "key").count() == 0
    with pytest.raises(ValueError):
        sio.read_features(spark, str(tmp_path / "m.tab"), "none")
