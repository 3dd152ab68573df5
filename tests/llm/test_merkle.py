import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidepool.llm import merkle


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i:i + 3])) for i in range(0, len(last), 3)])
    return levels


def brute_siblings(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 3 * 3
        out.append((level[first:i], level[i + 1:first + 3]))
        i //= 3
    return out


def brute_fold(leaf, siblings):
    for left, right in siblings:
        leaf = h("".join(left) + leaf + "".join(right))
    return leaf


def brute(rows):
    """rows: (doc_id, source, leaf, checked) -> sorted result rows"""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[s] = own, brute_levels([r[2] for r in own])
    top = brute_levels([trees[s][1][-1][0] for s in sources])
    root, out = top[-1][0], []
    for k, s in enumerate(sources):
        own, levels = trees[s]
        for i, r in enumerate(own):
            sib = brute_siblings(levels, i) + brute_siblings(top, k)
            proof = h("".join("".join(left + right) for left, right in sib))
            out.append((r[0], r[2], levels[-1][0], root, proof, brute_fold(r[3], sib)))
    return sorted(out, key=str)


def got(df):
    d = df.select("doc_id", "leaf", "subroot", "root", F.sha2(F.translate("proof", ",;", ""), 256), "folded_root")
    return sorted((tuple(r) for r in d.collect()), key=str)


@pytest.mark.parametrize("levels,sizes", [(1, [1, 2, 3, 4, 10, 28]), (2, [100, 9, 1]), (7, [5000, 1]), (3, [1]), (2, [1] * 30)])
def test_manifest_equals_brute_force(spark, levels, sizes):
    rows = [(i * 7 % 1009 + 2000 * k, f"s{k}" if k else None, h(f"{k} {i}"), h(f"{k} {i}") if i % 3 else h("x"))
            for k, n in enumerate(sizes) for i in range(n)]
    rows += rows[:2]                                     # repeated rows
    rows += [(None, "s0", h("n"), h("n")), (rows[0][0], rows[0][1], h("same id"), h("same id"))]
    df = spark.createDataFrame(rows, "doc_id long, source string, digest string, checked string").repartition(5)
    assert got(merkle.merkle_manifest(df, "checked", levels=levels)) == brute(rows)


def test_leaf_digest_and_nulls(spark):
    row = spark.createDataFrame([(1, None, "é", None, "a\nb")], "doc_id long, source string, lang string, n_chars long, text string")
    got_ = row.select(merkle.leaf_digest(*[F.col(c) for c in merkle.FIELDS])).first()[0]
    assert got_ == h("1:1-2:é-3:a\nb")


def test_query_on_documents_with_nulls_and_tampering(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f"s{i % 3}", "en", i if i % 4 else None, None if i == 7 else f"line {i}\nend" if i % 2 else "plain")
            for i in range(40)] + [(None, "s1", "en", 3, "a\nb")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string") \
        .withColumn("digest", F.lit("clash")).withColumn("tree", F.lit(1))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()}

    def leaf(r, text):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], r[3], text)))
    tampered = [(r[0], r[1], leaf(r, r[4]), leaf(r, r[4].replace("\n", "") if r[4] and r[0] is not None
                 and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4])) for r in rows]
    want = brute(tampered)
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in out.values()), key=str) == want
    assert all(out[t[0]]["verified"] == (t[2] == t[3]) for t in tampered)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = merkle.op13_merkle_manifest(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[-1] == "verified"
