import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidepool.llm import repair as rp

SPACE = " \t\n\v\f\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = "".join(c for c in text if c not in ".!?")
        if k == 4:
            role = "user"
        out.extend([(conv, turn, role, text)] * (2 if k == 3 else 1))
    return out


def brute_repair(rows):
    """rows of one conversation (turn, role, text): its counts, cost, least audit and repaired lines."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    ini = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:]))
    go = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    name = {"u": "user", "a": "assistant"}
    # forward: least (cost, audit, lines) per state of the pattern after every row, with up to four inserts anywhere
    best = {0: (0, "", ())}

    def inserted(best):
        for _ in range(4):
            for s, (c, audit, lines) in list(best.items()):
                for x in "ua":
                    t = go.get((s, x))
                    if t is not None:
                        cand = (c + 3, audit + "I", lines + (f"{name[x]}:",))
                        best[t] = min(best.get(t, cand), cand)
        return best
    for (_, role, text), fault, i in zip(rows, faults, ini):
        new = {}
        for s, (c, audit, lines) in inserted(best).items():
            cands = [(s, (c + 4, audit + "D", lines))]
            if fault in ("", "t"):
                extra = 3 if fault else 0
                if (s, i) in go:
                    cands.append((go[s, i], (c + extra, audit + "K", lines + (f"{role}:{text}",))))
                for x in "ua":
                    if (s, x) in go:
                        cands.append((go[s, x], (c + extra + 3, audit + "R", lines + (f"{name[x]}:{text}",))))
            for t, cand in cands:
                new[t] = min(new.get(t, cand), cand)
        best = new
    cost, audit, lines = min(v for s, v in inserted(best).items() if s in (0, 3))
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def random_rows(rnd, conv, n, turns=None):
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "User"]
    texts = ["Hi.", "Yes!", "Why?", "cut off", "end. \n", " \t", "", None, "a. b", "long " * 30 + "."]
    return [(conv, rnd.choice([None, i, i, i, i]) if turns is None else rnd.randrange(turns), rnd.choice(roles),
             f"{rnd.choice(texts)} {i}." if rnd.random() < .5 else rnd.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("chunk_bits", [2, 10])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, chunk_bits):
    rnd = random.Random(chunk_bits)
    rows = [r for c in range(60) for r in random_rows(rnd, c, rnd.choice([1, 2, 3, 8, 30]))]
    rows += random_rows(rnd, None, 20) + random_rows(rnd, 500, 700) + random_rows(rnd, 501, 90, turns=3)
    rows += [(502, 7, "user", "Same.")] * 40 + [(503, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
        .withColumn("conv", F.lit("clash")).withColumn("pos", F.lit(0))
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(rp.repair, "__defaults__", (chunk_bits,))
    out = rp.op11_rank_convergence_viterbi(spark, str(tmp_path))
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    by_conv = defaultdict(list)
    for conv, *r in brute_damage(rows):
        by_conv[conv].append(tuple(r))
    assert got == {c: brute_repair(by_conv[c]) for c in {r[0] for r in rows}}
    assert out.count() == len(got)


def test_given_conversations_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in rp.op11_rank_convergence_viterbi(spark, "/root/testdata/sf0.01").collect()}
    by_conv = defaultdict(list)
    for conv, *r in brute_damage(rows):
        by_conv[conv].append(tuple(r))
    assert got == {c: brute_repair(by_conv[c]) for c in {r[0] for r in rows}}


def test_fix_up_equals_a_whole_rerun():
    rnd = random.Random(3)
    for _ in range(300):
        steps = [(rnd.choice("sua?"), rnd.choice(["", "", "t", "b", "d"]), i) for i in range(rnd.randrange(1, 40))]
        old, new = [tuple(rnd.randrange(9) for _ in range(4)) for _ in range(2)]
        assert rp.fix_up(steps, new, old, rp.sweep(steps, old)) == rp.sweep(steps, new)


def test_chunks_converge_after_few_passes(spark, monkeypatch):
    """2,000 rows in chunks of 64: vectors differ only by constants soon, whatever was speculated."""
    passes = []
    real = rp.materialize
    monkeypatch.setattr(rp, "materialize", lambda df, name: passes.append(name) or real(df, name))
    rnd = random.Random(9)
    rows = spark.createDataFrame([(1, i, rnd.choice(["user", "assistant", "system"]), f"t{i}.") for i in range(2000)],
                                 "conv_id long, turn long, role string, text string")
    rp.repair(rows.select(F.struct(F.col("conv_id").alias("id")).alias("conv"), "turn", "role", "text", F.lit(1).cast("long").alias("m")), 6)
    assert 1 <= passes.count("repair-pass") <= 3


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert rp.op11_rank_convergence_viterbi(spark, str(tmp_path)).collect() == []
