"""SimHash near-duplicate groups by multi-index hashing.

A text's 64-bit fingerprint is the bitwise majority of the XXH64 values of its
word shingles.  Fingerprints within ``max_bits`` differing bits are linked, and a
group is a connected component of that graph.

Multi-index hashing: the fingerprint is cut into ``segments``; two fingerprints
within ``r = segments * a + b`` bits agree up to ``a`` bits in one of the first
``b + 1`` segments or up to ``a - 1`` bits in one of the others (else the distances
would add up to more than ``r``).  So every fingerprint stands in one table row per
segment, and probes the small Hamming ball round its segment value; the matches
of an equi-join are verified by their complete distance.  A pair at a segment
distance above zero is probed from one side only (the smaller segment value).
Rows and probes grow with the number of *different* fingerprints; equal ones are one
node from the start.  ``segments`` sets the trade-off: about
``64 / log2(fingerprints)`` is best, 3 suits up to some ten million, 2 beyond.

Dense groups (thousands of fingerprints within a few bits of each other) would
make all their pairs.  Where a table bucket stands for more than ``dense_pairs`` pairs,
its fingerprints are linked through ball centres instead: two fingerprints are
within ``2k`` bits exactly if they share a centre within ``k`` bits of both, so every
fingerprint is listed under all centres within ``max_bits // 2`` bits, and those
listed under one centre are linked to the smallest of them.  All such links are true
links and no pair is lost, while the rows are linear in the fingerprints.

Defined cases: NULL or wordless texts have fingerprint zero and are linked like any
other; fewer words than a shingle make one shingle of the whole sequence; repeated
rows share a component; NULL doc_ids are ignored as component names unless nothing
else is in the group; an empty table gives an empty result; only the id and text
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import fresh, materialize, table, text_of
from tidepool.llm.components import connected_components

BITS = 64
SEED = 42


def shingle_hashes(text: str, shingle: int) -> list[int]:
    """XXH64 values of a text's word shingles (A-Z lower-cased)."""
    from xxhash import xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return []
    joined = b" ".join(words)
    if n <= shingle:
        return [xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1)
    first = np.concatenate(([0], ends[:n - shingle])).tolist()
    last = (ends[shingle - 1:] - 1).tolist()
    return [xxh64_intdigest(joined[i:j], SEED) for i, j in zip(first, last)]


def majority(hashes: list[int]) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit integer."""
    if not hashes:
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    h = np.array(hashes, dtype="<u8")
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") \
            .sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint(col: str, shingle: int) -> Column:
    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([majority(shingle_hashes(t, shingle)) for t in s], dtype="int64")
    return fp(text_of(col))


def segment_plan(segments: int, max_bits: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of each segment."""
    a, b = divmod(max_bits, segments)
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(edges[i], edges[i + 1] - edges[i], a if i <= b else a - 1) for i in range(segments)]


def ball_masks(width: int, low: int, high: int) -> list[int]:
    """Masks of ``low`` to ``high`` set bits among ``width``."""
    return [sum(1 << i for i in c) for k in range(low, high + 1) for c in combinations(range(width), k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def index_rows(fps: DataFrame, segments: int, max_bits: int) -> DataFrame:
    """(seg, key, fp, probe): the table row and the probes of every fingerprint in every segment."""
    def entry(s: int, low: int, width: int, radius: int) -> Column:
        key = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        own = F.array(F.struct(F.lit(s).alias("seg"), key.alias("key"), F.lit(False).alias("probe")))
        masks = ball_masks(width, 1, radius)
        if not masks:
            return own
        near = F.filter(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]),
                                    lambda m: key.bitwiseXOR(m)), lambda x: x > key)
        return F.concat(own, F.transform(near, lambda x: F.struct(
            F.lit(s).alias("seg"), x.alias("key"), F.lit(True).alias("probe"))))
    entries = [entry(s, *p) for s, p in enumerate(segment_plan(segments, max_bits)) if p[2] >= 0]
    return fps.select("fp", F.explode(F.concat(*entries)).alias("e")).select("e.seg", "e.key", "fp", "e.probe")


def ball_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``max_bits`` of each other, without their pairs.

    Two fingerprints within ``max_bits`` bits share a centre at ``max_bits // 2`` or
    ``max_bits - max_bits // 2`` bits; those under one centre are at most a ball, so the lists are
    bounded.  Odd distances need balls of two radii, which the even case does not.
    """
    small, large = max_bits // 2, max_bits - max_bits // 2
    masks = [_signed(m) for m in ball_masks(BITS, 0, large)]
    near = len(ball_masks(BITS, 0, small))
    c = fps.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("i", "m")) \
        .select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("centre"), (F.col("i") < near).alias("near"))
    g = c.groupBy("centre").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("b"),
                                F.collect_list("fp").alias("all")).where("b is not null and size(`all`) > 1")
    return g.select(F.explode("all").alias("a"), "b").where("a != b").distinct()


def fingerprint_links(fps: DataFrame, max_bits: int, segments: int = 3, dense_pairs: int = 20_000) -> DataFrame:
    """Links (a, b) between different fingerprints (``fps`` has one row per fingerprint ``fp``).

    Their components are those of the full graph of pairs within ``max_bits``.
    """
    rows = materialize(index_rows(fps, segments, max_bits), "mih-index")
    sizes = rows.groupBy("seg", "key").agg(F.sum(F.when(F.col("probe"), 0).otherwise(1)).alias("t"),
                                           F.count(F.lit(1)).alias("n"))
    dense = materialize(sizes.where(F.col("t") * F.col("n") > dense_pairs).select("seg", "key"), "mih-dense")
    thin = rows.join(dense, ["seg", "key"], "left_anti")
    left = thin.where("not probe").select("seg", "key", F.col("fp").alias("a"))
    right = thin.select("seg", "key", F.col("fp").alias("b"), "probe")
    pairs = left.join(right, ["seg", "key"]).where(
        (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits) & (F.col("probe") | (F.col("a") < F.col("b")))) \
        .select("a", "b")
    crowded = rows.join(dense, ["seg", "key"], "left_semi").select("fp").distinct()
    return pairs.unionAll(ball_links(crowded, max_bits))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                   max_bits: int = 4, segments: int = 3) -> DataFrame:
    """(id, fp, component_id) per row: signed fingerprint and smallest id reachable."""
    rows = materialize(docs.select(F.col(id_col).alias("id"), fingerprint(text_col, shingle).alias("fp")), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("rep"))
    star = connected_components(fingerprint_links(nodes.select("fp"), max_bits, segments), "a", "b")
    rooted = nodes.join(star, F.col("fp") == F.col("node"), "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.select("fp", "root").join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                  max_bits: int = 4, segments: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id.

    Of rows that share this id and a fingerprint, the one with the smallest hash of all columns stays.
    """
    fp, n = fresh(docs, "fp", "n")
    groups = simhash_groups(docs, id_col, text_col, shingle, max_bits, segments)
    first = groups.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("id", "fp") \
        .agg(F.count(F.lit(1)).alias(n)).select(F.col("id").alias("_id"), F.col("fp").alias("_fp"), n)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.withColumn(fp, fingerprint(text_col, shingle)).join(
        first, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(fp) == F.col("_fp")))
    once = kept.where(F.col(n) == 1).select(*cols)
    again = kept.where(F.col(n) > 1).groupBy("_id", "_fp").agg(
        F.min_by(F.struct(*cols), F.xxhash64(*cols)).alias("r")).select("r.*")
    return once.unionAll(again)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash_groups(table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
