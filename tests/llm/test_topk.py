import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import topk


def brute(rows, is_query, k, scale=256):
    good = []
    for i, (vid, v) in enumerate(rows):
        if vid is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, vid, [math.floor(scale * float(np.float32(x))) for x in v]))
    out = []
    for i, vid, q in good:
        if is_query(vid):
            s = sorted((-sum(a * b for a, b in zip(q, x)), c) for _, c, x in good if c != vid and len(x) == len(q))[:k]
            out += [(vid, r + 1, c, -score) for r, (score, c) in enumerate(s)]
    return sorted(out)


def vectors():
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 6) for i in range(40)]  # one common vector: ties
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [math.nan] * 6), (303, [math.inf] * 6), (304, [0.0] * 6),
             (305, [1.0, 2.0]), (310, [2.0, -1.0]), (306, []), (320, []), (50, [0.1] * 6), (60, [1e6] * 6), (None, [1.0] * 6)]
    return rows


@pytest.mark.parametrize("block,chunk", [(10_000, 10_000), (16, 5)])
def test_equals_brute_force(spark, block, chunk):
    rows = vectors()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, score string")
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=5, block_rows=block, chunk_rows=chunk)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0, 5)


def test_fewer_rows_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0


def test_reading_stops_early(monkeypatch):
    """Lists whose tops agree are not read to their ends."""
    n = 5000
    x = np.zeros((n, 3))
    x[:, 0] = np.arange(n)
    lists = topk.SortedLists(np.arange(n), x)
    seen = []
    order = lists.order

    class Spy:
        def __getitem__(self, at):
            seen.append(np.size(at[0]))
            return order[at]
    lists.order = Spy()
    ids, scores = lists.top(-1, np.array([1.0, 0.0, 0.0]), 5)
    assert ids.tolist() == [4999, 4998, 4997, 4996, 4995]
    assert sum(seen) < n / 10
