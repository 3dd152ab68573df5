"""History tables: one partition per (run, iteration), compacted as a run grows.

An iteration is appended as the partition ``run_id=R/iteration=I``, so a retried iteration
replaces itself.  Thousands of iterations would leave thousands of small files, so
:func:`compact_history` merges a run's older partitions into one file set

    _merged/run_id=R/upto=U/        every stored iteration below U

which is valid once it holds the marker file: creating the marker is the atomic switch.
Readers take the valid set with the highest ``U`` and only those partitions whose iteration is at
least ``U``, so the partitions and older sets that are removed afterwards may be there or not.  A
crash leaves either an unmarked set, which is ignored and written anew, or remains of
merged partitions, which readers skip.  (Spark skips folders that begin with ``_``.)

Folders are listed through the file system of the path, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MERGED = "_merged"
MARKER = "_COMPLETE"
ROWS_PER_FILE = 1_000_000


class HistorySchemaError(ValueError):
    pass


# -- folders --------------------------------------------------------------------------

def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, p = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def remove_path(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def _numbers(names: list[str], prefix: str) -> list[int]:
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix))


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if there is none.  A damaged table raises."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


# -- appending and reading --------------------------------------------------------------

def append_history(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("run_id", "iteration")) -> str:
    """Append rows to a history table partitioned by run and iteration.

    Dynamic partition overwrite makes a retried iteration idempotent: re-running
    iteration i replaces only partition (run_id, i).  A header mismatch with the
    existing table raises instead of warning.
    """
    existing = read_if_present(df.sparkSession, path)
    if existing is not None:
        want = [f.name for f in existing.schema.fields]
        got = [c for c in df.columns]
        if sorted(want) != sorted(got):
            raise HistorySchemaError(f"history columns differ: expected {want}, got {got}")
        df = df.select(*[c for c in want])
    if list_folder(df.sparkSession, f"{path}/{MERGED}"):
        for r in df.groupBy("run_id").agg(F.min("iteration").alias("i")).collect():  # one row per run
            upto = merged_upto(df.sparkSession, path, r["run_id"])
            if upto is not None and r["i"] < upto:
                raise ValueError(f"iteration {r['i']} of run {r['run_id']} is in its merged history and cannot be replaced")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    return path


def merged_upto(spark: SparkSession, path: str, run_id: int) -> int | None:
    """All stored iterations of the run below this number are in its merged file set; None without one."""
    root = f"{path}/{MERGED}/run_id={run_id}"
    for upto in reversed(_numbers(list_folder(spark, root), "upto=")):
        if path_exists(spark, f"{root}/upto={upto}/{MARKER}"):
            return upto
    return None


def tail_iterations(spark: SparkSession, path: str, run_id: int, since: int | None) -> list[int]:
    """Iterations of a run that stand as partitions of their own (from ``since`` on)."""
    names = _numbers(list_folder(spark, f"{path}/run_id={run_id}"), "iteration=")
    return [i for i in names if since is None or i >= since]


def read_run(spark: SparkSession, path: str, run_id: int) -> DataFrame | None:
    """A run's history rows (``iteration`` and the stored columns), None if it has none."""
    upto = merged_upto(spark, path, run_id)
    parts = []
    if upto is not None:
        parts.append(spark.read.parquet(f"{path}/{MERGED}/run_id={run_id}/upto={upto}"))
    tail = tail_iterations(spark, path, run_id, upto)
    if tail:
        rows = spark.read.option("basePath", f"{path}/run_id={run_id}") \
            .parquet(*[f"{path}/run_id={run_id}/iteration={i}" for i in tail])
        parts.append(rows.withColumn("iteration", F.col("iteration").cast("long")))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def runs_of(spark: SparkSession, path: str) -> list[int]:
    """Runs that the history holds."""
    both = list_folder(spark, path) + list_folder(spark, f"{path}/{MERGED}")
    return sorted(set(_numbers(both, "run_id=")))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All runs' rows, merged or not.  No history raises, as reading any missing table does."""
    merged = {r: u for r in _numbers(list_folder(spark, f"{path}/{MERGED}"), "run_id=")
              if (u := merged_upto(spark, path, r)) is not None}
    tail = spark.read.parquet(path)
    if not merged:
        return tail
    since = spark.createDataFrame(list(merged.items()), "run_id long, _since long")
    tail = tail.withColumn("run_id", F.col("run_id").cast("long")).withColumn("iteration", F.col("iteration").cast("long"))
    tail = tail.join(F.broadcast(since), "run_id", "left").where("_since is null or iteration >= _since").drop("_since")
    old = spark.read.option("basePath", f"{path}/{MERGED}") \
        .parquet(*[f"{path}/{MERGED}/run_id={r}/upto={u}" for r, u in merged.items()])
    return tail.unionByName(old.drop("upto").withColumn("run_id", F.col("run_id").cast("long")))


def has_iteration(spark: SparkSession, path: str, run_id: int, iteration: int) -> bool:
    """Does the history hold rows of (run, iteration)?  Opens that partition only, or the run's merged set.

    No history means no; a damaged partition raises.
    """
    upto = merged_upto(spark, path, run_id)
    if upto is not None and iteration < upto:
        merged = spark.read.parquet(f"{path}/{MERGED}/run_id={run_id}/upto={upto}")
        return not merged.where(F.col("iteration") == iteration).isEmpty()
    rows = read_if_present(spark, f"{path}/run_id={run_id}/iteration={iteration}")
    return rows is not None and not rows.isEmpty()


# -- compaction ------------------------------------------------------------------------------

def compact_history(spark: SparkSession, path: str, run_id: int, keep: int = 1, fail_at: str | None = None) -> int | None:
    """Merge all but the run's last ``keep`` partitions into one file set; returns its ``upto``.

    ``fail_at`` (``written``, ``marked``) stops there, as a crash would.
    """
    if keep < 1:
        raise ValueError("the last partition stays as it is: an iteration that is retried replaces it")
    old = merged_upto(spark, path, run_id)
    tail = tail_iterations(spark, path, run_id, old)
    if len(tail) <= keep:
        _sweep(spark, path, run_id, old)
        return old
    upto = tail[-keep]
    rows = read_run(spark, path, run_id).where(F.col("iteration") < upto)
    root = f"{path}/{MERGED}/run_id={run_id}"
    files = max(1, -(-rows.count() // ROWS_PER_FILE))
    rows.repartitionByRange(files, "iteration").sortWithinPartitions("iteration") \
        .write.mode("overwrite").parquet(f"{root}/upto={upto}")
    if fail_at == "written":
        raise RuntimeError("stopped before the switch")
    fs, marker = _folder(spark, f"{root}/upto={upto}/{MARKER}")
    fs.create(marker).close()
    if fail_at == "marked":
        raise RuntimeError("stopped after the switch")
    _sweep(spark, path, run_id, upto)
    return upto


def _sweep(spark: SparkSession, path: str, run_id: int, upto: int | None) -> None:
    """Remove what the valid merged set replaces."""
    if upto is None:
        return
    for i in _numbers(list_folder(spark, f"{path}/run_id={run_id}"), "iteration="):
        if i < upto:
            remove_path(spark, f"{path}/run_id={run_id}/iteration={i}")
    root = f"{path}/{MERGED}/run_id={run_id}"
    for u in _numbers(list_folder(spark, root), "upto="):
        if u != upto:
            remove_path(spark, f"{root}/upto={u}")
