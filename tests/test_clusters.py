"""The set join with common bits, and the joint surrogate's neighbours: exact and spread."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepool import session
from tidepool.operators import cluster as clu
from tidepool.operators import fingerprint as fp
from tidepool.operators import ranking as rk
from tidepool.operators import setjoin as sj


def _sets(seed, n=240, hot=1_000_000):
    """Bit sets of 1 to 60 bits with near copies; a third of them hold the hot bit, short ones nothing else rare."""
    rnd = random.Random(seed)
    out = []
    while len(out) < n:
        base = set(rnd.sample(range(400), rnd.choice([1, 2, 3, 8, 20, 60])))
        for _ in range(rnd.choice([1, 1, 3])):
            s = set(base)
            if len(s) > 4:
                s.discard(rnd.choice(sorted(s)))
                s.add(rnd.randrange(400))
            if rnd.random() < 1 / 3:
                s.add(hot)
            out.append(sorted(s))
    return [(i, s) for i, s in enumerate(out[:n])]


def _brute(rows, t):
    out = {}
    for i, (a, sa) in enumerate(rows):
        for b, sb in rows[i + 1:]:
            inter = len(set(sa) & set(sb))
            sim = inter / (len(sa) + len(sb) - inter)
            if sim >= t:
                out[a, b] = sim
    return out


@pytest.mark.parametrize("t,block,k", [(0.7, 4096, 3), (0.7, 8, 3), (0.5, 16, 1), (0.4, 5, 5), (0.9, 3, 2)])
def test_pairs_equal_brute_force_for_any_block_size(spark, t, block, k):
    rows = _sets(int(t * 10))
    reps = spark.createDataFrame(rows, "key long, bits array<int>").withColumn("mult", F.lit(1)).repartition(5)
    got = {(r["a"], r["b"]): r["sim"] for r in clu.similar_pairs(reps, t, k, block).collect()}
    want = _brute(rows, t)
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_a_hot_bit_is_spread_over_blocks(spark):
    # 3,000 sets; a third of them hold bit 7 and no rarer bit, so bit 7 is in every prefix
    rows = [(i, [7, 8] if i % 3 == 0 else [10_000 + i, 20_000 + i]) for i in range(3000)]
    sized = spark.createDataFrame(rows, "key long, bits array<int>").withColumn("len", F.size("bits"))
    freq = sized.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("df"))
    short, long = clu._sides(clu._prefix_rows(sized, freq, 0.7, 3, 64))
    for side in (short, long):
        most = side.groupBy("bit", "cls", "x", "y").count().agg(F.max("count")).first()[0]
        assert most <= 64 * 2
    assert short.where("bit = 7").select("x", "y").distinct().count() == 16 * 16


def test_equal_sets_meet_by_digest(spark):
    rows = [(i, [1, 2, 3] if i % 3 else [i]) for i in range(3, 600)] + [(1000, [3, 2, 1])]
    fps = spark.createDataFrame(rows, "doc_id long, bits array<int>")
    reps, members = clu.collapse_identical(fps, "doc_id")
    got = {r["member"]: r["key"] for r in members.collect()}
    assert got == {i: (4 if s == [1, 2, 3] else i) for i, s in rows}
    assert {r["key"]: r["mult"] for r in reps.collect()}[4] == sum(s == [1, 2, 3] for _, s in rows)
    assert "Exchange hashpartitioning(bits" not in reps._jdf.queryExecution().toString()


def test_join_hot_equals_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else str(i)) for i in range(6000)], "id long, k string")
    info = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = rk.join_hot(rows, info, ["k"], "n")
    assert got.count() == 6000
    assert got.where("k = 'hot'").select("n").distinct().collect() == [(4000,)]


def test_clusters_without_pairs_or_rows(spark):
    lone = spark.createDataFrame([(1, [1]), (2, [2])], "doc_id long, bits array<int>")
    assert {r["doc_id"]: r["cluster"] for r in clu.similarity_clusters(lone, "doc_id").collect()} == {1: 1, 2: 2}
    assert clu.similarity_clusters(lone.limit(0), "doc_id").count() == 0


def test_a_set_is_moved_once_for_its_cell_not_for_each_candidate(spark):
    clique = [(f"k{a:03d}", f"k{b:03d}") for a in range(60) for b in range(a + 1, 60)]
    _, moved = clu._moves(spark.createDataFrame(clique, "a string, b string"))
    assert moved.count() == 60  # of 1,770 candidates


def test_candidates_across_cells_are_verified(spark, monkeypatch):
    monkeypatch.setattr(clu, "CELL_SETS", 4)
    rows = [(f"k{i:03d}", sorted({*range(40), 100 + i % 7})) for i in range(50)] + [("z", [500, 501]), ("y", [500, 501, 502])]
    reps = spark.createDataFrame(rows, "key string, bits array<int>")
    got = {(r["a"], r["b"]): r["sim"] for r in clu.similar_pairs(reps, 0.6).collect()}
    want = {tuple(sorted(p)): s for p, s in _brute(rows, 0.6).items()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)



def _near_copies(seed, n=400, size=120, universe=1 << 14):
    """Sets of many bits that all share some by chance; every third is a near copy of one before, with 0 to 30 of its bits changed."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        s = set(rnd.sample(range(universe), rnd.randrange(size // 2, size * 2)))
        if i % 3 == 2:
            s = set(out[rnd.randrange(i)])
            for x in rnd.sample(sorted(s), rnd.randrange(31)):
                s.discard(x)
                s.add(rnd.randrange(universe))
        out.append(sorted(s))
    return [(i, s) for i, s in enumerate(out)]


@pytest.mark.parametrize("t,turn_bits", [(0.7, 1 << 22), (0.7, 1 << 13), (0.8, 1 << 14), (0.55, 1 << 15)])
def test_neighbours_find_all_similar_pairs_in_any_turns(spark, monkeypatch, t, turn_bits):
    monkeypatch.setattr(sj, "TURN_BITS", turn_bits)
    rows = _near_copies(int(t * 100))
    reps = spark.createDataFrame(rows, "key long, bits array<int>").repartition(3)
    got = {(r["a"], r["b"]): r["sim"] for r in clu.similar_pairs(reps, t).collect()}
    want = _brute(rows, t)
    assert len(want) > 20 and got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_checkpoints_have_no_row_for_each_bit(spark):
    rows = _near_copies(5)
    fps = spark.createDataFrame(rows, "doc_id long, bits array<int>")
    saved = []
    session.CHECKPOINT_OBSERVERS.append(lambda df: saved.append(df.count()))
    try:
        assert clu.similarity_clusters(fps, "doc_id").count() == len(rows)
    finally:
        session.CHECKPOINT_OBSERVERS.pop()
    assert max(saved) <= 3 * len(rows)


def test_packed_sets_keep_their_bits():
    rnd = random.Random(3)
    rows = [[], [0], [5, 5, 1], [-3, 2], None, [2**31 - 1], sorted(rnd.sample(range(1 << 30), 300)), sorted(rnd.sample(range(1 << 20), 5000))]
    got = sj.packed_column(pa.array([[1, 2]] + rows, pa.list_(pa.int32())).slice(1))
    assert [x if x is None else sj.unpack(x).tolist() for x in got.to_pylist()] == rows
    some = [r for r in rows[5:]]
    assert sj.unpacked_column(got.slice(5), np.array([len(r) for r in some])).tolist() == [x for r in some for x in r]
    assert len(got[7].as_py()) < 2 * 5000


def test_pairs_that_a_task_passes_on_in_pieces_are_the_same(monkeypatch):
    rows = _near_copies(9, n=90)
    lens = [len(s) for _, s in rows]
    bits = sj.packed_column(pa.array([s for _, s in rows], pa.list_(pa.int32())))
    batch = pa.RecordBatch.from_arrays([pa.array([f"k{i}" for i, _ in rows]), bits, pa.array(lens, pa.int32())], ["key", "bits", "len"])
    dealt = sj._dealt(batch, np.arange(sj.ORDER_SLOTS), 0.7, 0, 1, 1)

    def pairs():
        out = {}
        for b in sj._spread(list(sj._meeting([dealt], 0.7))):
            for a, c, w in zip(*(x.to_pylist() for x in b.columns)):
                out[a, c] = out.get((a, c), 0) + w
        return out
    want = pairs()
    monkeypatch.setattr(sj, "MEET_PAIRS", 7)
    got = pairs()
    assert got.keys() == want.keys() and all(min(got[p], sj.COMMON) == min(want[p], sj.COMMON) for p in want)


def test_fingerprints_equal_md5_of_every_n_gram():
    rnd = random.Random(2)
    alpha = "ab \u00e9\t\n\r  \x0b  \u65e5x"
    texts = ["".join(rnd.choice(alpha) for _ in range(rnd.randrange(1, 120))) for _ in range(200)]
    texts += ["x" * 55, "x" * 56 + " y " + "z" * 200, "", " ", "\n", " q ", "a"]
    for n, size in ((3, 1 << 20), (1, 64), (2, 1000)):
        want = []
        for text in texts:
            tok = [x for x in re.split("[ \t\n\r]+", text) if x]
            grams = [" ".join(tok[i:i + k]) for k in range(1, n + 1) for i in range(len(tok) - k + 1)]
            want.append(sorted({int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % size for g in grams}))
        got = fp.fingerprint_column(pa.array(["left out"] + texts).slice(1), n, size)
        assert got.to_pylist() == want
