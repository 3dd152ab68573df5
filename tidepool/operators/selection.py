"""Selection and working-set updates on long cell tables ``(id, task, y)``.

Cell-level lookups (one scan of the table per cell, done naively) become
semi/anti joins on (id, task).  Top-k is a global ``orderBy(...).limit(k)``
(Spark plans a distributed TakeOrderedAndProject: each task keeps k rows, the
driver merges at most k x partitions).  Ties are broken by (id, task) so the
result does not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["id", "task"]


def mask_unlabelled(scores: DataFrame, pool_cells: DataFrame) -> DataFrame:
    """Keep scores of pool cells that carry a label (unlabelled cells can never be chosen)."""
    lab = pool_cells.where(F.col("y").isNotNull()).select(*KEY)
    return scores.join(lab, KEY, "left_semi")


def topk_cells(scores: DataFrame, k: int) -> DataFrame:
    """Global top-k cells by score (desc), ties by id then task."""
    return scores.orderBy(F.col("score").desc(), F.col("id").asc(), F.col("task").asc()).limit(k)


def topk_one_task(scores: DataFrame, k: int, task: str | None = None) -> DataFrame:
    """Top-k rows within one task, or within every task at once (``task=None``).

    The per-task form is ``row_number() <= k`` over task; Spark inserts a
    partial WindowGroupLimit before the shuffle, so each task ships <= k rows.
    """
    if task is not None:
        return topk_cells(scores.where(F.col("task") == task), k)
    w = Window.partitionBy("task").orderBy(F.col("score").desc(), F.col("id").asc())
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reveal_cells(pool_cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """Query set: the chosen cells with their labels (other cells of the rows stay hidden)."""
    return pool_cells.join(chosen.select(*KEY), KEY, "left_semi").where(F.col("y").isNotNull())


def upsert_train(train_cells: DataFrame, query_cells: DataFrame) -> DataFrame:
    """Merge a query set into the training cells; an existing training value wins."""
    t = train_cells.select(*KEY, "y").where(F.col("y").isNotNull())
    q = query_cells.select(*KEY, "y").where(F.col("y").isNotNull()).join(t.select(*KEY), KEY, "left_anti")
    return t.unionByName(q)


def upsert_train_wide(train: DataFrame, query: DataFrame, tasks: list[str], key: str = "id") -> DataFrame:
    """Wide form of :func:`upsert_train`: full outer merge by key, ``coalesce(train, query)``."""
    t = train.alias("t")
    q = query.alias("q")
    j = t.join(q, F.col(f"t.{key}") == F.col(f"q.{key}"), "full_outer")
    return j.select(F.coalesce(F.col(f"t.{key}"), F.col(f"q.{key}")).alias(key),
                    *[F.coalesce(F.col(f"t.{c}"), F.col(f"q.{c}")).alias(c) for c in tasks])


def shrink_pool(pool_cells: DataFrame, query_cells: DataFrame) -> DataFrame:
    """Remove queried cells from the pool (rows with no cell left vanish by construction)."""
    return pool_cells.join(query_cells.where(F.col("y").isNotNull()).select(*KEY), KEY, "left_anti")


def shrink_pool_wide(pool: DataFrame, query_cells: DataFrame, tasks: list[str], how: str = "all",
                     subset: list[str] | None = None, key: str = "id") -> DataFrame:
    """Wide pool: blank queried cells, then drop rows whose ``subset`` labels are all (or any) NULL."""
    q = query_cells.where(F.col("y").isNotNull()).groupBy(F.col("id").alias("_qid")) \
        .agg(F.collect_set("task").alias("_qt"))
    j = pool.join(q, pool[key] == q["_qid"], "left")
    out = j.select(key, *[F.when(F.coalesce(F.array_contains("_qt", t), F.lit(False)),
                                 F.lit(None).cast(pool.schema[t].dataType)).otherwise(F.col(t)).alias(t)
                          for t in tasks])
    return out.dropna(how=how, subset=subset or tasks)


def shrink_pool_single(pool: DataFrame, query_cells: DataFrame, tasks: list[str], aux_tasks: list[str],
                       key: str = "id") -> DataFrame:
    """Single-task variant: blank chosen cells, drop rows with any NULL among the aux tasks."""
    return shrink_pool_wide(pool, query_cells, tasks, how="any", subset=aux_tasks, key=key)


class ConservationError(AssertionError):
    pass


def cell_counts(by=None, **tables: DataFrame) -> DataFrame:
    """Non-null cell counts per named table in one job: ``(role, n)``, and per value of ``by`` (a column ``part``) if given."""
    keys = ["role"] if by is None else ["role", "part"]
    parts = [df.where(F.col("y").isNotNull()).select(F.lit(name).alias("role"), *([] if by is None else [by.alias("part")]))
             for name, df in tables.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def conservation_check(train: DataFrame, pool: DataFrame, query: DataFrame,
                       new_train: DataFrame, new_pool: DataFrame, raise_on_error: bool = True, by=None) -> DataFrame:
    """train' = train + query and pool' = pool - query (non-null cells); raise on violation.

    ``by``: a column (such as the run) for each of whose values this must hold.
    """
    counts = cell_counts(by, train=train, pool=pool, query=query, new_train=new_train, new_pool=new_pool)
    if raise_on_error:
        rows = counts.collect()  # five rows, for every value of ``by``
        c = {(r["role"], None if by is None else r["part"]): r["n"] for r in rows}
        for part in {k[1] for k in c}:
            get = lambda k: c.get((k, part), 0)
            if get("new_train") != get("train") + get("query"):
                raise ConservationError(f"training cells {get('new_train')} != {get('train')} + {get('query')}")
            if get("new_pool") != get("pool") - get("query"):
                raise ConservationError(f"pool cells {get('new_pool')} != {get('pool')} - {get('query')}")
        # hand back the counts already computed instead of re-running five branches
        return train.sparkSession.createDataFrame(rows, counts.schema)
    return counts
