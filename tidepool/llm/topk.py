"""Exact top-k by inner product with Fagin's threshold algorithm, in blocks.

Candidates are dealt by hash into blocks of about ``block_rows`` and queries into chunks of
about ``chunk_rows``; every (chunk, block) pair is one group of an equi-join.  In a
block each dimension has its list of rows sorted by value.  For a query, the lists are
read from the end that the component's sign favours, a stretch at a time; every row met
is scored in full (random access), and the sum of the query's components times the last
values read bounds every row not met yet.  Reading stops when the k-th best score is
strictly above that bound, so ties by id stay exact.  The best k of all blocks are then
the best k overall.

Components are quantised to ``floor(scale * x)`` and scores are exact integers.

Defined cases: vectors that are NULL or hold NULL or non-finite components take no part;
vectors are compared with vectors of their own length only (empty ones score 0); every
row is a candidate of its own, so a repeated id may be returned more than once, and no
row with the query's id is its candidate; a query row that is repeated is answered once
per row; an empty table gives an empty result; only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.llm.common import materialize, table

EXACT = 2.0 ** 53


def quantised(col: str, scale: int) -> Column:
    """``floor(scale * x)`` of every component, NULL if any component is NULL or not finite."""
    x = F.transform(col, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * scale)))


class SortedLists:
    """A block of vectors with a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        first = np.argsort(ids, kind="stable")  # row order is id order, so ties go to the smaller row
        self.ids, self.x = ids[first], x[first]
        self.order = np.argsort(self.x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, self.order, axis=0)

    def top(self, query_id: int, q: np.ndarray, k: int, first_stretch: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` rows, best first, ties to the smaller id."""
        n = len(self.ids)
        dims = np.flatnonzero(q)
        own = self.ids == query_id
        if not len(dims):
            rows = np.flatnonzero(~own)[:k]
            return self.ids[rows], np.zeros(len(rows), dtype=q.dtype)
        qd, down = q[dims], q[dims] > 0
        seen = own.copy()
        best, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=q.dtype)
        depth, stretch = 0, first_stretch
        while depth < n:
            stop = min(n, depth + stretch)
            at = np.arange(depth, stop)[:, None]
            rows = self.order[np.where(down, n - 1 - at, at), dims]
            new = np.zeros(n, dtype=bool)
            new[rows.ravel()] = True
            new &= ~seen
            met = np.flatnonzero(new)
            seen |= new
            if len(met):
                s = self.x[met] @ q
                if len(score) == k:
                    keep = s >= score[-1]
                    met, s = met[keep], s[keep]
                best, score = np.concatenate((best, met)), np.concatenate((score, s))
                if len(best) > k:
                    top = np.lexsort((best, -score))[:k]
                    best, score = best[top], score[top]
                else:
                    top = np.lexsort((best, -score))
                    best, score = best[top], score[top]
            depth, stretch = stop, stretch * 2
            bound = self.sorted[np.where(down, n - depth, depth - 1), dims] @ qd
            if len(score) == k and score[-1] > bound:
                break
        return self.ids[best], score


def _matrix(vectors, exact_float: bool) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64 if exact_float else np.int64).reshape(len(vectors), -1)


def block_search(k: int):
    """Task function of one (chunk, block) pair."""
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            q, x = _matrix(queries["vec"], False), _matrix(rows["vec"], False)
            dims = max(q.shape[1], 1)
            if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * dims < EXACT:
                q, x = q.astype(np.float64), x.astype(np.float64)  # sums stay exact, and BLAS is used
            lists = SortedLists(rows["id"].to_numpy(), x)
            for row, qid, v in zip(queries["row"], queries["id"], q):
                ids, scores = lists.top(qid, v, k)
                out += [(row, qid, int(i), int(s)) for i, s in zip(ids, scores)]
        return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 256, block_rows: int = 8_192, chunk_rows: int = 4_096) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``k`` candidates of every query row."""
    v = vectors.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), quantised(vec_col, scale).alias("vec"), is_query.alias("query")) \
        .where("vec is not null").withColumn("dim", F.size("vec"))
    v = materialize(v.withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    n, n_queries = v.agg(F.count(F.lit(1)), F.count(F.when(F.col("query"), 1))).first()
    blocks, chunks = -(-n // block_rows) or 1, -(-n_queries // chunk_rows) or 1

    def dealt(count: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = v.where("query").withColumn("chunk", dealt(chunks)).withColumn("block", every(blocks))
    rows = v.withColumn("block", dealt(blocks)).withColumn("chunk", every(chunks))
    key = ["dim", "chunk", "block"]
    found = queries.select(*key, "row", "id", "vec").groupBy(*key).cogroup(
        rows.select(*key, "id", "vec").groupBy(*key)).applyInPandas(
        block_search(k), "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")  # k rows per block
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def op7_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return top_k(v, F.col("vec_id") % 50 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
