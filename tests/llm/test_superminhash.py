import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import superminhash as smh


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k=2):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k=2, percent=80):
    """rows (id, text) -> sorted (id, n, component)"""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return sorted(((d, len(s), names.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = rnd.choices(vocab, k=60)
    texts = [None, "", " \t\n", "one", "ONE", "two words", "Two\tWORDS", "two", "x " * 5000]
    for _ in range(25):
        base = rnd.choices(vocab, k=rnd.choice([4, 12, 60, 300]))
        if rnd.random() < .4:
            base = passage + base
        for _ in range(rnd.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2, len(base) // 22])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            texts.append(" ".join(copy))
    # edited copies that are each close to their original only, and chains a-b-c where a and c are far
    base = rnd.choices(vocab, k=200)
    texts += [" ".join(base)] + [" ".join(f"e{i}_{j}" if j in set(rnd.sample(range(200), 8)) else w for j, w in enumerate(base)) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows + rows[:3] + [(None, "two words"), (None, "alone here"), (7, "another text with the same id as seven")]


@pytest.mark.parametrize("seed,shingle", [(1, 2), (2, 2), (3, 5)])
def test_groups_equal_brute_force(spark, seed, shingle):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("n", F.lit(0)).repartition(4)
    got = smh.near_duplicate_groups(df, shingle=shingle, percent=80)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, shingle)


def test_hot_buckets_take_the_other_joins(spark, monkeypatch):
    """With every group counted as hot, results stay the same."""
    monkeypatch.setattr(smh, "over", lambda count, total: F.col(count) > 3)
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = smh.near_duplicate_groups(df, shingle=2, percent=80)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def plain_superminhash(elements, slots):
    """Element by element, with the whole permutation drawn."""
    sig = [float("inf")] * slots
    for e in elements.tolist():
        perm = list(range(slots))
        for i in range(slots):
            draw = int(smh.mix(np.array([(e + (i + 1) * int(smh.GOLDEN)) % 2 ** 64], dtype=np.uint64))[0])
            k = i + ((draw & 0xFFFFFF) * (slots - i) >> 24)
            perm[i], perm[k] = perm[k], perm[i]
            sig[perm[i]] = min(sig[perm[i]], i + (draw >> 24) * 2.0 ** -40)
    return sig


@pytest.mark.parametrize("n", [1, 2, 7, 40, 500])
def test_early_stopping_changes_nothing(n):
    elements = np.unique(smh.mix(np.arange(1, n + 1, dtype=np.uint64)))
    assert smh.superminhash(elements, 40).tolist() == plain_superminhash(elements, 40)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.8):
        errors = []
        for _ in range(40):
            pool = np.unique(rng.integers(0, 2 ** 63, 400).astype(np.uint64))
            both = int(len(pool) * share)
            rest = (len(pool) - both) // 2
            a, b = np.concatenate([pool[:both], pool[both:both + rest]]), np.concatenate([pool[:both], pool[both + rest:both + 2 * rest]])
            errors.append((smh.superminhash(a, 160) == smh.superminhash(b, 160)).mean() - both / (both + 2 * rest))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < (share * (1 - share) / 160) ** .5 * 1.2


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert smh.op12_superminhash_near_dedup(spark, str(tmp_path)).collect() == []
