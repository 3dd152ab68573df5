"""Skew-free ranking and prefix sums.

Spark's ``row_number().over(Window.partitionBy(k))`` sorts a whole partition
key in one task; with one hot stratum (a third of the rows) that task gets a
third of the data.  Both helpers here split each key into blocks first:

* :func:`hash_rank` ranks rows by a uniform 52-bit hash.  Blocks are the top
  bits of the hash (balanced by construction); block sizes are counted with a
  map-side-combined aggregate, turned into offsets on the small count table,
  and each block is ranked on its own.
* :func:`prefix_sums` computes running sums in value order (threshold curves).
  Blocks come from a range repartition (sampled bounds, so balanced for any
  value distribution), frozen with a reliable checkpoint so every consumer
  sees the same block ids, then the same offset trick.
* :func:`ordered_rank` numbers all rows of a table in the order of some columns:
  a range repartition, the place within the sorted partition, and one offset per
  partition.

The number of blocks is a parameter (by default ``spark.sql.shuffle.partitions`` for the
range-partitioned forms) and never depends on the data; results do not depend on it.  In
:func:`hash_rank` and :func:`prefix_sums` the rows meet their offsets by an equi-join on the
same plain keys that the block window is partitioned by, so they are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.hashing import hash_bucket
from tidepool.session import cut_lineage

POS_BITS = 33        # monotonically_increasing_id is partition << 33 | place in the partition
RANK_BITS = 14       # 16,384 hash blocks per key: 10**10 rows of one key are sorted 600,000 at a time


def join_null_safe(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``cols`` where NULL matches NULL (NULL is its own stratum)."""
    if not cols:
        raise ValueError("join_null_safe needs at least one key")
    r = right
    renamed = {c: f"__r_{c}" for c in cols}
    for c, n in renamed.items():
        r = r.withColumnRenamed(c, n)
    cond = None
    for c, n in renamed.items():
        e = left[c].eqNullSafe(r[n])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*renamed.values())


HOT_KEYS = 10_000


def join_hot(rows: DataFrame, info: DataFrame, keys: list[str], count_col: str) -> DataFrame:
    """``rows`` joined with ``info`` (one row per key, with the number of ``rows`` that have it).

    Keys with more than one in ``HOT_KEYS`` of all rows, of which there are fewer than
    ``HOT_KEYS``, are broadcast; the others meet their rows in an ordinary join.
    """
    total = info.agg(F.sum(count_col)).first()[0] or 0
    hot = F.col(count_col) > max(1_000, total // HOT_KEYS)
    few = F.broadcast(info.where(hot))
    return rows.join(few, keys).unionByName(
        rows.join(few.select(*keys), keys, "left_anti").join(info.where(~hot), keys))


def hash_rank(df: DataFrame, part_cols: list[str], h_col: str, tie_cols: list[str],
              rank_col: str = "_rn", size_col: str | None = "_n", bits: int = RANK_BITS) -> DataFrame:
    """1-based rank of each row within ``part_cols`` ordered by (h_col, tie_cols).

    Equals ``row_number() over (partition by part_cols order by h, ties)`` but no
    task ever sorts more than one hash block (of ``2**bits``) of one key.  ``size_col``
    (optional) receives the key's row count.  NULL is a key like any other.
    """
    # a struct compares NULL fields as equal, so it is a plain key of joins and windows
    key = F.struct(*[F.col(c) for c in part_cols]) if part_cols else F.lit(0)
    d = df.withColumn("_key", key).withColumn("_bkt", hash_bucket(F.col(h_col), bits))
    counts = d.groupBy("_key", "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy("_key").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    cols = ["_key", "_bkt", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off")]
    if size_col:
        cols.append(F.sum("_cnt").over(Window.partitionBy("_key")).alias(size_col))
    w = Window.partitionBy("_key", "_bkt").orderBy(F.col(h_col), *[F.col(c) for c in tie_cols])
    return d.join(counts.select(*cols), ["_key", "_bkt"]) \
        .withColumn(rank_col, F.row_number().over(w) + F.col("_off")).drop("_key", "_bkt", "_off")


def prefix_sums(base: DataFrame, part_cols: list[str], order_col: str, value_cols: list[str],
                descending: bool = True, blocks: int | None = None, prefix: str = "cum_",
                total_prefix: str | None = None) -> DataFrame:
    """Inclusive running sums of ``value_cols`` per ``part_cols`` in ``order_col`` order.

    ``base`` must be unique on (part_cols, order_col) (e.g. the output of a
    group-by); ties are then impossible and the running sum is well defined.
    ``blocks`` is the number of range blocks (``spark.sql.shuffle.partitions`` if
    not given): a task sorts about ``rows / blocks`` rows.  ``total_prefix`` adds the
    keys' totals, taken from the block sums.
    """
    n = blocks or int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order: Column = F.col(order_col).desc() if descending else F.col(order_col).asc()
    ranged = base.repartitionByRange(n, *[F.col(c) for c in part_cols], order) \
        .withColumn("_blk", F.spark_partition_id())
    # Freeze block ids: range bounds are sampled, so a recomputation could move rows.
    ranged = cut_lineage(ranged).withColumn("_key", F.struct(*[F.col(c) for c in part_cols]))
    totals = ranged.groupBy("_key", "_blk").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    whole = Window.partitionBy("_key")
    before = whole.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    cols = ["_key", "_blk", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in value_cols]]
    if total_prefix:
        cols += [F.sum(f"_t_{v}").over(whole).alias(f"{total_prefix}{v}") for v in value_cols]
    out = ranged.join(totals.select(*cols), ["_key", "_blk"])
    running = Window.partitionBy("_key", "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for v in value_cols:
        out = out.withColumn(f"{prefix}{v}", F.sum(v).over(running) + F.col(f"_o_{v}"))
    return out.drop("_key", "_blk", *[f"_o_{v}" for v in value_cols])


def ordered_rank(df: DataFrame, order_cols: list[str], rank_col: str = "_rn", blocks: int | None = None) -> DataFrame:
    """1-based place of each row in the order of ``order_cols`` over the whole table.

    One range exchange (frozen by a checkpoint) and a join with one offset per
    partition.  ``order_cols`` should identify a row: a hot prefix is then spread
    over as many partitions as it has rows for.
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) for c in order_cols]
    d = cut_lineage(df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
                    .withColumn("_pos", F.monotonically_increasing_id()))
    d = d.withColumn("_blk", F.shiftright("_pos", POS_BITS))
    sizes = d.groupBy("_blk").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_blk", (F.coalesce(F.sum("_cnt").over(before), F.lit(0))
                                    - F.shiftleft("_blk", POS_BITS) + 1).alias("_off"))
    return d.join(F.broadcast(offsets), "_blk").withColumn(rank_col, F.col("_pos") + F.col("_off")).drop("_blk", "_pos", "_off")
