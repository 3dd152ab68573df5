"""Initial (seed) sets drawn in hash order, and the pool that remains.

Each draw is "the n lowest hashes of a class".  One scan keeps, per task, the n lowest
rows and the row count of every class; only those rows are exchanged, and the class sizes come
with them.  A class with fewer rows than asked for raises (sampling without replacement cannot
satisfy it), as NumPy's choice does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.hashing import hash52
from tidepool.session import cut_lineage


class SampleSizeError(ValueError):
    pass


def _first_of_class(table: pa.Table, part: list[str], order: list[str], n: int) -> pa.Table:
    """The first ``n`` rows of each class, with the class's ``_c`` summed up on its first row."""
    table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in [*part, *order]]))
    rows = table.num_rows
    starts = np.zeros(rows, dtype=bool)
    starts[:1] = True
    for c in part:
        codes = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        starts[1:] |= codes[1:] != codes[:-1]
    first = np.flatnonzero(starts)
    place = np.arange(rows) - np.repeat(first, np.diff(np.append(first, rows)))
    counts = np.zeros(rows, dtype=np.int64)
    counts[first] = np.add.reduceat(table.column("_c").to_numpy(), first)
    at = table.schema.get_field_index("_c")
    table = table.set_column(at, table.schema.field(at), pa.array(counts))
    return table.filter(pa.array(place < n))


def lowest_per_class(df: DataFrame, part: list[str], h_col: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows of lowest (``h_col``, ``key``) of every class ``part``, and the class size ``_n``.

    Equals ``row_number() <= n`` over the class; every map task hands on at most ``n`` rows a
    class, and what it counted on the first of them.
    """
    d = df.withColumn("_c", F.lit(1).cast("long"))
    cols = d.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            kept = _first_of_class(new if kept is None else pa.concat_tables([kept, new]), part, [h_col, key], n) \
                if new.num_rows else kept
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    partial = d.mapInArrow(run, T.StructType([d.schema[c] for c in cols]))
    cls = Window.partitionBy(*part)
    return partial.withColumn("_rn", F.row_number().over(cls.orderBy(h_col, key))) \
        .withColumn("_n", F.sum("_c").over(cls)).where(F.col("_rn") <= n).drop("_c", "_rn")


def _draw(df: DataFrame, part: list[str], per_class: int, seed, key: str, check: bool,
          expected: list | None = None) -> DataFrame:
    chosen = lowest_per_class(df.withColumn("_h", hash52(seed, key)), part, "_h", key, max(1, per_class))
    if check:
        chosen = cut_lineage(chosen)  # a few rows per class; read for the sizes and by the caller
        # one row per class (a handful): sizes, including classes that are absent
        sizes = {tuple(row[c] for c in part): row["_n"] for row in chosen.select(*part, "_n").distinct().collect()}
        for cls in (expected or []):
            sizes.setdefault(cls if isinstance(cls, tuple) else (cls,), 0)
        for cls, n in sizes.items():
            if n < per_class:
                raise SampleSizeError(f"class {list(cls)} has {n} rows, {per_class} requested")
    return (chosen if per_class else chosen.limit(0)).drop("_h", "_n")


def seed_set_balanced(cells: DataFrame, task: str, n: int, seed=0, check: bool = True) -> DataFrame:
    """n/2 positive and n/2 negative cells of ``task`` without replacement."""
    c = cells.where((F.col("task") == task) & F.col("y").isNotNull())
    return _draw(c, ["y"], n // 2, seed, "id", check, expected=[0.0, 1.0])


def seed_set_aux(cells: DataFrame, tasks: list[str], n_per_task: int, seed=0, check: bool = True) -> DataFrame:
    """The balanced draw for several tasks in one pass (window over (task, y))."""
    c = cells.where(F.col("task").isin(tasks) & F.col("y").isNotNull())
    return _draw(c, ["task", "y"], n_per_task // 2, seed, "id", check,
                 expected=[(t, v) for t in tasks for v in (0.0, 1.0)])


def row_activity(cells: DataFrame, n_tasks: int) -> DataFrame:
    """Per row: ``active`` = any task positive; ``inactive`` = every task observed and 0."""
    g = cells.groupBy("id").agg(F.max("y").alias("_max"), F.count("y").alias("_obs"))
    cls = (F.when(F.col("_max") == 1, "active")
           .when((F.col("_max") == 0) & (F.col("_obs") == n_tasks), "inactive"))
    return g.select("id", cls.alias("cls")).where(F.col("cls").isNotNull())


def seed_set_any_active(cells: DataFrame, n_tasks: int, n: int, seed=0, check: bool = True) -> DataFrame:
    """n/2 rows with any positive label and n/2 rows with all labels 0: ``(id, cls)``."""
    return _draw(row_activity(cells, n_tasks), ["cls"], n // 2, seed, "id", check,
                 expected=["active", "inactive"])


def seed_sets_for_runs(cells: DataFrame, runs: DataFrame, n: int, check: bool = True,
                       by: list[str] | None = None) -> DataFrame:
    """One balanced seed set per run, all runs in one job.

    ``runs``: ``(run_id, seed, task)`` (e.g. from ``experiment_grid``).  Each
    run's draw equals :func:`seed_set_balanced` with that run's task and seed.  The draw depends
    on (task, seed) only, so cells are ranked once for each of these pairs and the runs are
    joined to the few rows drawn.  ``by``: the columns that name a task (default ``task``; with
    several data sets ``dataset`` and ``task``).
    """
    half = n // 2
    by = by or ["task"]
    draw = [*by, "seed"]
    draws = cut_lineage(runs.select(*draw).distinct())
    c = cells.where(F.col("y").isNotNull()).join(draws, by).withColumn("_h", hash52(F.col("seed"), "id"))
    chosen = cut_lineage(lowest_per_class(c, [*draw, "y"], "_h", "id", max(1, half)))
    if check:
        sizes = chosen.groupBy(*draw).agg(F.countDistinct("y").alias("classes"), F.min("_n").alias("smallest"))
        short = draws.join(sizes, draw, "left") \
            .where(F.col("classes").isNull() | (F.col("classes") < 2) | (F.col("smallest") < half))
        bad = runs.join(short, draw, "left_semi").limit(1).collect()
        if bad:
            raise SampleSizeError(f"run {bad[0]['run_id']}: a class has fewer than {half} rows")
    drawn = chosen if half else chosen.limit(0)
    return runs.select("run_id", *draw).join(drawn.select(*draw, "id", "y"), draw).select("run_id", "id", *by, "y")


def remainder_pool(cells: DataFrame, seed_set: DataFrame, by: str = "cells") -> DataFrame:
    """Training data minus the seed set, by cell (id, task) or by whole row (id)."""
    keys = ["id", "task"] if by == "cells" else ["id"]
    return cells.join(seed_set.select(*keys).distinct(), keys, "left_anti")
