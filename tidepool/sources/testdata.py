"""Inputs derived from the driver's Parquet tables (``<sf_dir>/<name>.parquet``).

How the active-learning data model maps onto them:

* features ``(id, x)``            = ``embeddings(vec_id, embedding)``
* cells ``(id, task, y)``         = ``embeddings.label`` one-hot over tasks t0..t9;
  a hash-chosen share of cells is hidden (y NULL) so the pool has real gaps
* two-task wide labels           = ``documents`` left join ``labels`` (quality, toxic)
* strings to fingerprint / group = ``documents.text`` / ``documents.source``
* (task, y, p, z) at size         = ``lineitem``: task = l_linestatus,
  y = (l_returnflag = 'R'), p = 10 * l_discount (many ties), z = l_quantity / 10 - 2.5

Every builder has a DuckDB twin (``SQL_*``) used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.hashing import HASH_SCALE, hash52, sql_hash52

N_EMB_TASKS = 10
EMB_TASKS = [f"t{k}" for k in range(N_EMB_TASKS)]
DOC_TASKS = ["quality", "toxic"]
#: marks that stand in for sparse tasks of documents: does the text hold it?
DOC_MARKS = ["@", "|", "#", "+", "$", "*", "(", "license", "0", "\u00fc", "\u00e8", "the "]
MARK_TASKS = [f"m{k:02d}" for k in range(len(DOC_MARKS))]
HIDE_SEED = "hide"
HIDE_FRAC = 0.15
HIDE_BELOW = int(HIDE_FRAC * HASH_SCALE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def emb_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))


def _hidden(id_col: str, task_col) -> "F.Column":
    return hash52(HIDE_SEED, id_col, task_col) < F.lit(HIDE_BELOW)


def emb_cells(spark: SparkSession, sf_dir: str, hide: bool = True) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    c = e.select("id", "label", F.explode(F.sequence(F.lit(0), F.lit(N_EMB_TASKS - 1))).alias("k"))
    c = c.select("id", F.concat(F.lit("t"), F.col("k").cast("string")).alias("task"),
                 (F.col("label") == F.col("k")).cast("double").alias("y"))
    if hide:
        c = c.withColumn("y", F.when(_hidden("id", "task"), F.lit(None).cast("double")).otherwise(F.col("y")))
    return c


def doc_labels_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    w = d.join(lab, "id", "left")
    for t in DOC_TASKS:
        w = w.withColumn(t, F.when(_hidden("id", F.lit(t)), F.lit(None).cast("double")).otherwise(F.col(t).cast("double")))
    return w


def doc_marks_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve sparse tasks of documents (``DOC_MARKS``), with gaps."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return d.select("id", *[F.when(~_hidden("id", F.lit(t)), F.contains("text", F.lit(m)).cast("double")).alias(t)
                            for t, m in zip(MARK_TASKS, DOC_MARKS)])


def lineitem_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), "l_linenumber", F.col("l_linestatus").alias("task"),
                     (F.col("l_returnflag") == "R").cast("double").alias("y"),
                     (F.col("l_discount") * 10).alias("p"),
                     (F.col("l_quantity") / 10 - 2.5).alias("z"))


# ---- DuckDB twins -------------------------------------------------------------

SQL_EMB_FEATURES = "SELECT vec_id AS id, embedding AS x FROM embeddings"

SQL_EMB_CELLS = f"""
SELECT id, task,
       CASE WHEN {sql_hash52(HIDE_SEED, 'id', 'task')} < {HIDE_BELOW} THEN NULL ELSE y END AS y
FROM (SELECT e.vec_id AS id, 't' || CAST(k.range AS VARCHAR) AS task,
             CAST(CAST(e.label = k.range AS INTEGER) AS DOUBLE) AS y
      FROM embeddings e, range({N_EMB_TASKS}) k) c
"""

SQL_DOC_LABELS_WIDE = f"""
SELECT d.doc_id AS id,
       CASE WHEN {sql_hash52(HIDE_SEED, 'd.doc_id', "'quality'")} < {HIDE_BELOW} THEN NULL
            ELSE CAST(l.quality AS DOUBLE) END AS quality,
       CASE WHEN {sql_hash52(HIDE_SEED, 'd.doc_id', "'toxic'")} < {HIDE_BELOW} THEN NULL
            ELSE CAST(l.toxic AS DOUBLE) END AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

SQL_DOC_MARKS_WIDE = "SELECT doc_id AS id, " + ", ".join(
    f"CASE WHEN {sql_hash52(HIDE_SEED, 'doc_id', chr(39) + t + chr(39))} >= {HIDE_BELOW} "
    f"THEN CAST(CAST(contains(text, '{m}') AS INTEGER) AS DOUBLE) END AS {t}"
    for t, m in zip(MARK_TASKS, DOC_MARKS)) + " FROM documents"

SQL_LINEITEM_SCORES = """
SELECT l_orderkey AS id, l_linenumber, l_linestatus AS task,
       CAST(CAST(l_returnflag = 'R' AS INTEGER) AS DOUBLE) AS y, l_discount * 10 AS p, l_quantity / 10 - 2.5 AS z
FROM lineitem
"""
