import random

import numpy as np
import pytest
import xxhash

from tidepool.llm import simhash


def brute_fp(text, shingle=4):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, fps, max_bits):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= max_bits:
                parent[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: low[find(i)] for i, d in enumerate(ids)}


def texts():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    out = [None, "", "  \t\n", "one", "ONE", "two words", "a b c d", "A  b\tc\nd"]
    for _ in range(40):
        base = rnd.choices(words, k=rnd.choice([5, 30, 200]))
        for _ in range(rnd.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("segments", [2, 3])
def test_groups_equal_brute_force(spark, segments):
    t = texts()
    ids = [7 * i + 3 for i in range(len(t))]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in zip(ids, t)], "doc_id long, text string, fp string")
    got = {r.id: r for r in simhash.simhash_groups(docs, segments=segments).collect()}
    fps = [brute_fp(x) for x in t]
    assert {d: r.fp & (2 ** 64 - 1) for d, r in got.items()} == dict(zip(ids, fps))
    assert {d: r.component_id for d, r in got.items()} == brute_components(ids, fps, 4)


@pytest.mark.parametrize("max_bits", [3, 4])
def test_dense_groups_lose_no_link(spark, max_bits):
    """Every bucket over the pair bound goes through ball centres: components stay those of the full graph."""
    rnd = random.Random(1)
    centre = rnd.getrandbits(64)
    fps = {centre}
    for _ in range(60):
        fps.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 4, 5, 8]))))
    fps |= {rnd.getrandbits(64) for _ in range(20)}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    from tidepool.llm.components import connected_components
    want = brute_components(fps, fps, max_bits)
    for dense in (0, 10 ** 9):
        star = connected_components(simhash.fingerprint_links(df, max_bits, dense_pairs=dense), "a", "b").collect()
        root = {r.node & (2 ** 64 - 1): r.root & (2 ** 64 - 1) for r in star}
        groups = {}
        for f in fps:
            groups.setdefault(root.get(f, f), set()).add(f)
        mine = {f: min(g) for g in groups.values() for f in g}
        assert mine == want


def test_dedup_keeps_one_row_of_each_group(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A B C D E F", "y"), (3, "other words here now ok", "z"), (4, None, "n"), (5, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = simhash.simhash_dedup(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4]
    assert simhash.simhash_dedup(docs.where("false")).count() == 0


def test_pigeonhole_of_the_segment_plan():
    rnd = np.random.default_rng(0)
    for segments in (1, 2, 3, 4, 5):
        plan = simhash.segment_plan(segments, 4)
        for _ in range(300):
            x = sum(1 << int(b) for b in rnd.choice(64, rnd.integers(0, 5), replace=False))
            assert any(r >= 0 and bin(x >> low & ((1 << w) - 1)).count("1") <= r for low, w, r in plan)
