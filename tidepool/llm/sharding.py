"""Shards by extendible hashing: only oversized buckets split on another hash bit.

A document's hash is the first 60 bits of the md5 of its id.  The directory starts as
one bucket; a bucket whose documents exceed ``limit`` bytes splits on its next bit, so a
bucket is the shortest hash prefix whose documents fit.

Spark sums the bytes by prefixes of a first depth near ``log2(total / limit)``; prefixes that
are still too large are summed again ``STEP`` bits deeper, and only those, until none is.
The sums are the leaves of a tree whose inner sums follow by adding up; a leaf belongs to its
highest ancestor that fits.  Documents find their shard by one equi-join per depth on
the leaf's prefix.  Directory rows are about ``total / limit``, a few per shard.

Bytes are the UTF-8 length of the text.  A shard is named by its depth and prefix bits.

Defined cases: NULL text has no bytes; documents with one id always share a shard; a shard
over the limit that cannot split (one id, or equal 60 bits) is marked ``oversized``; NULL ids hash
as the empty string; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import materialize, table

HASH_BITS = 60
STEP = 4
SHARD_BYTES = 4 << 20


def id_hash(col: str) -> Column:
    text = F.coalesce(F.col(col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, HASH_BITS - depth)


def leaf_sums(rows: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, bytes) of leaves: prefixes that fit, or that have no further bits."""
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    depth = min(HASH_BITS, max(1, math.ceil(math.log2(max(total, 1) / limit)) + 2 if total > limit else 1))
    left, leaves = rows, None
    while True:
        sums = materialize(left.groupBy(prefix(F.col("h"), depth).alias("prefix")).agg(F.sum("bytes").alias("bytes"))
                           .withColumn("depth", F.lit(depth)), "shard-sums")
        large = sums.where(F.col("bytes") > limit).select("prefix")
        last = depth == HASH_BITS or large.isEmpty()
        own = sums if last else sums.where(F.col("bytes") <= limit)
        own = own.select("depth", "prefix", "bytes")
        leaves = own if leaves is None else leaves.unionAll(own)
        if last:
            return leaves
        left = left.withColumn("prefix", prefix(F.col("h"), depth)).join(large, "prefix", "left_semi").select("h", "bytes")
        depth = min(HASH_BITS, depth + STEP)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(leaf_depth, leaf, depth, prefix, bytes): the bucket of every leaf."""
    leaves = materialize(leaf_sums(rows, limit), "shard-leaves")
    up = F.explode(F.sequence(F.lit(0), F.col("depth")))
    paths = leaves.select(F.col("depth").alias("leaf_depth"), F.col("prefix").alias("leaf"), "bytes", up.alias("at")) \
        .withColumn("node", F.expr("shiftright(leaf, leaf_depth - at)"))
    nodes = paths.groupBy("at", "node").agg(F.sum("bytes").alias("node_bytes"))
    fits = paths.drop("bytes").join(nodes, ["at", "node"]).where((F.col("node_bytes") <= limit) | (F.col("at") == F.col("leaf_depth")))
    top = fits.groupBy("leaf_depth", "leaf").agg(F.min(F.struct("at", "node", "node_bytes")).alias("b"))
    return top.select("leaf_depth", "leaf", F.col("b.at").alias("depth"), F.col("b.node").alias("prefix"),
                      F.col("b.node_bytes").alias("bytes"))


def shards(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bytes, depth, prefix, shard_bytes, oversized) of every document row."""
    rows = materialize(docs.select(
        F.col(id_col).alias("id"), id_hash(id_col).alias("h"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes")), "shard-rows")
    book = materialize(directory(rows, limit), "shard-directory")
    out = None
    for (depth,) in sorted(book.select("leaf_depth").distinct().collect()):  # at most 60 / STEP depths
        own = book.where(F.col("leaf_depth") == depth).select(
            "leaf", "depth", "prefix", F.col("bytes").alias("shard_bytes"))
        part = rows.withColumn("leaf", prefix(F.col("h"), depth)).join(own, "leaf").drop("leaf", "h")
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = rows.select("id", "bytes", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"),
                          F.lit(0).cast("long").alias("shard_bytes")).limit(0)
    return out.withColumn("oversized", F.col("shard_bytes") > limit)


def op8_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shards(table(spark, sf_dir, "documents"))
    return s.select(F.col("id").alias("doc_id"), F.col("bytes").alias("n_bytes"), F.col("depth").cast("int").alias("depth"),
                    F.col("prefix").alias("shard_prefix"), F.col("shard_bytes").cast("long").alias("shard_bytes"), "oversized")


OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {HASH_BITS // 4}) AS BIGINT) AS h
  FROM documents
), g AS (SELECT unnest(range(0, {HASH_BITS + 1})) AS depth),
t AS (
  SELECT depth, h >> ({HASH_BITS} - depth) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM d, g GROUP BY ALL
), b AS (
  SELECT d.doc_id, d.n_bytes, t.depth, t.prefix, t.bytes,
         row_number() OVER (PARTITION BY d.doc_id ORDER BY t.depth) AS k
  FROM d JOIN t ON t.prefix = d.h >> ({HASH_BITS} - t.depth) WHERE t.bytes <= {SHARD_BYTES} OR t.depth = {HASH_BITS}
)
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth, prefix AS shard_prefix, bytes AS shard_bytes,
       bytes > {SHARD_BYTES} AS oversized
FROM b WHERE k = 1
"""
