"""Assembly and reshaping: semi-joins, dedup, union, alignment, long <-> wide.

Inside tidepool labels live in the long form ``(id, task, y)``; wide tables
(one column per task) exist only at the edges.  Alignment is always a key
join, never positional.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labels_with_features(labels: DataFrame, feats: DataFrame, key: str = "id", feat_key: str = "id") -> DataFrame:
    """Label rows whose key occurs in the feature table (left semi join)."""
    return labels.join(feats.select(F.col(feat_key).alias(key)), key, "left_semi")


def features_for_labels(feats: DataFrame, labels: DataFrame, key: str = "id", label_key: str = "id") -> DataFrame:
    """Feature rows whose key occurs in the label table (left semi join)."""
    return feats.join(labels.select(F.col(label_key).alias(key)), key, "left_semi")


def dedup_keep_first(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """One row per key: the first by ``order_cols`` (file order must be an explicit column).

    Written as ``min(struct(order, rest))`` per key: an aggregate, so map tasks
    combine partially and a hot key (many copies) ships one row per map task.
    Remaining columns break exact ties, so the result never depends on partitioning.
    """
    order = [c for c in order_cols if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in order]
    fields = order + rest
    if not fields:
        return df.select(*keys).distinct()
    packed = F.min(F.struct(*[F.col(c) for c in fields])).alias("_first")
    out = df.groupBy(*keys).agg(packed)
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in fields]).select(*df.columns)


def concat_features(*tables: DataFrame, key: str = "id", order_col: str | None = None) -> DataFrame:
    """Union of feature inputs by column name; a key seen in several keeps the earliest input."""
    parts = [t.withColumn("_src", F.lit(i)) for i, t in enumerate(tables)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    order = ["_src"] + ([order_col] if order_col else [])
    return dedup_keep_first(u, [key], order).drop("_src")


class MissingKeysError(ValueError):
    pass


def align_features(rows: DataFrame, feats: DataFrame, key: str = "id", check: bool = True) -> DataFrame:
    """Equi-join a working set with its features by key; raise if any key has no features."""
    if check:
        lost = rows.select(key).join(feats.select(key), key, "left_anti").limit(1).collect()
        if lost:
            raise MissingKeysError(f"key {lost[0][key]!r} has no features")
    return rows.join(feats, key, "inner")


def select_tasks(wide: DataFrame, tasks: list[str], key: str = "id") -> DataFrame:
    return wide.select(key, *tasks)


def select_tasks_long(cells: DataFrame, tasks: list[str]) -> DataFrame:
    return cells.where(F.col("task").isin(tasks))


def pack_features(df: DataFrame, cols: list[str], out: str = "x", keep: list[str] | None = None) -> DataFrame:
    """N numeric columns -> one ``array<double>`` column (no 1,024-column tables downstream)."""
    keep = keep if keep is not None else [c for c in df.columns if c not in cols]
    return df.select(*keep, F.array(*[F.col(c).cast("double") for c in cols]).alias(out))


def unpack_features(df: DataFrame, width: int, col: str = "x", prefix: str = "f") -> DataFrame:
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, *[F.col(col)[i].alias(f"{prefix}{i}") for i in range(width)])


def to_wide(cells: DataFrame, tasks: list[str], key: str = "id") -> DataFrame:
    """Long cells -> one column per task (explicit task list: no extra job to find pivot values)."""
    return cells.groupBy(key).pivot("task", tasks).agg(F.max("y"))


def to_dataset(wide: DataFrame, tasks: list[str], key: str = "id") -> DataFrame:
    """Wide frame -> key + label array in task order."""
    return wide.select(key, F.array(*[F.col(t) for t in tasks]).alias("ys"))


def melt_labels(wide: DataFrame, tasks: list[str], key: str = "id", keep_null: bool = False) -> DataFrame:
    """Wide -> long ``(id, task, y)``; by default only observed cells."""
    long = wide.unpivot([key], tasks, "task", "y")
    return long if keep_null else long.where(F.col("y").isNotNull())


def merge_cells(partial: DataFrame, tasks: list[str], key: str = "id") -> DataFrame:
    """Merge partial rows of one key into one row; an all-NULL task stays NULL (sum, min_count=1)."""
    return partial.groupBy(key).agg(*[F.sum(t).alias(t) for t in tasks])
