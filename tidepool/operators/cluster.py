"""Similarity clustering (Butina) on sparse bit sets, and the cluster split.

Neighbours are pairs with Jaccard similarity >= ``threshold``.  They are found
with an exact set-similarity join (prefix filtering): with bits ordered
globally from rarest to most common, two sets with J >= t must share one of
the first ``|A| - ceil(t |A|) + 1`` bits of each; a length filter prunes
more.  Where t > 1/2, all but tiny sets meet by pairs of bits next to each other in
that order, which are far rarer (:mod:`tidepool.operators.setjoin`).  Posting lists of
single bits are cut into blocks, so a common bit is spread over many
tasks.  Candidates are then verified exactly, cell against cell, so a set is moved
once for many candidates.  Identical bit sets are
collapsed first (they are always neighbours of each other), so copies of one
text never produce pairs; what remains is the neighbour graph itself.  Sets are kept and moved
as bytes, once on the disk for all steps.

Butina in fixed order (neighbour count desc, key asc) equals a greedy maximal
independent set taken in that order: in rounds, every live node that ranks
above all its live neighbours becomes a centre, and centres and their
neighbours leave.  Each round is a join over the shrinking live edge set and
is checkpointed.  Finally each non-centre joins its best-ranked adjacent
centre, which is the centre that claims it in the sequential algorithm.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators.ranking import join_hot
from tidepool.operators.setjoin import (
    ORDER_SLOTS, PART_BITS, least_size, neighbour_candidates, packed, unpack, unpacked,
)
from tidepool.session import broadcast, cut_lineage, free_shuffles, release

DEFAULT_THRESHOLD = 0.7
POSTING_BLOCK = 4_096    # rows of a posting list that meet in one join key
CELL_SETS = 256          # sets of a cell: candidates of two cells are verified together
PLACE_BITS = 15          # rows of a partition that are marked together, as a power of two


def _rank_key() -> "F.Column":
    # smaller is better: more neighbours first, then smaller key
    return F.struct((-F.col("nbrs")).alias("a"), F.col("key").alias("b"))


def _digest() -> list["F.Column"]:
    """128 bits that stand for a bit set."""
    return [F.xxhash64("bits").alias("_d1"), F.xxhash64(F.lit("set"), "bits").alias("_d2")]


def collapse_identical(fps: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(representatives ``(key, bits, len, mult)``, members ``(member, key)``): one node per distinct bit set.

    ``bits`` of the representatives are bytes (:func:`tidepool.operators.setjoin.packed`).  If those of ``fps`` are too, it
    is a checkpoint.  Equal sets meet by a 128-bit digest; the sets themselves stay where they are, and the
    representatives are read from there.
    """
    saved = fps if dict(fps.dtypes)["bits"] == "binary" else cut_lineage(packed(fps.select(key, "bits")))
    d = saved.select(F.col(key).alias("member"), F.monotonically_increasing_id().alias("place"), *_digest())
    # the least key, null last, and the place of its row
    least = F.min(F.struct(F.col("member").isNull().alias("none"), "member", "place"))
    g = cut_lineage(d.groupBy("_d1", "_d2").agg(least.alias("m"), F.count(F.lit(1)).alias("mult"))
                    .select("_d1", "_d2", F.col("m.member").alias("key"), F.col("m.place").alias("place"), "mult"))
    members = join_hot(d.select("member", "_d1", "_d2"), g.select("_d1", "_d2", "key", "mult"), ["_d1", "_d2"], "mult")
    return _rows_at(saved.withColumnRenamed(key, "key"), g.select("place", "mult")), members.select("member", "key")


def _rows_at(saved: DataFrame, places: DataFrame) -> DataFrame:
    """Rows ``(key, bits, len, mult)`` of the checkpoint ``saved`` that stand at ``places`` (with ``mult``).

    The places go to all tasks, as a compressed count (0 for other rows) for every row: about 1 bit a row.
    """
    span = 1 << PLACE_BITS

    def marks(batches):
        for b in batches:
            out = []
            for at in b.column(1):
                rows, mult = at.values.field(0).to_numpy(), at.values.field(1).to_numpy()
                count = np.zeros(span, dtype=np.int64)
                count[rows] = mult
                out.append(zlib.compress(count.view(np.uint8).reshape(span, 8).T.tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["block", "counts"])

    blocks = places.groupBy(F.shiftright("place", PLACE_BITS).alias("block")).agg(F.collect_list(F.struct(
        F.col("place").bitwiseAND(F.lit(span - 1)).cast("int").alias("at"), F.col("mult").cast("long").alias("mult"))).alias("rows")) \
        .mapInArrow(marks, "block long, counts binary").toArrow()
    counts = broadcast(saved.sparkSession, dict(zip(blocks["block"].to_pylist(), blocks["counts"].to_pylist())))

    def run(batches):
        block, count = None, np.zeros(span, dtype=np.int64)
        for b in batches:
            place = b.column(3).to_numpy()
            mult = np.zeros(len(place), dtype=np.int64)
            for x in np.unique(place >> PLACE_BITS):
                if x != block:
                    block, held = x, counts.value.get(int(x))
                    count = np.zeros(span, np.int64) if held is None else \
                        np.frombuffer(zlib.decompress(held), np.uint8).reshape(8, span).T.copy().view(np.int64).reshape(-1)
                m = place >> PLACE_BITS == x
                mult[m] = count[place[m] & span - 1]
            keep = np.flatnonzero(mult)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep)) for c in b.columns[:3]] + [pa.array(mult[keep])],
                                             ["key", "bits", "len", "mult"])

    kind = saved.schema["key"].dataType.simpleString()
    return saved.select("key", "bits", "len", F.monotonically_increasing_id().alias("place")) \
        .mapInArrow(run, f"key {kind}, bits binary, len int, mult long")


def _slot_counts(freq: DataFrame) -> np.ndarray:
    """Counts ``(bit, df)`` added up in ``ORDER_SLOTS`` counters (bits modulo that number)."""
    t = freq.select(F.pmod("bit", F.lit(ORDER_SLOTS)).cast("int").alias("slot"), F.col("df").cast("long").alias("df")).toArrow()
    out = np.zeros(ORDER_SLOTS, dtype=np.int64)
    np.add.at(out, t["slot"].to_numpy(), t["df"].to_numpy())
    return out


def _prefix_rows(sized: DataFrame, freq: DataFrame, t: float, k: int, block: int) -> DataFrame:
    """Prefix tokens of every set, in the order of (count of the bit's slot, bit), found row by row.

    Any one order of the bits is exact; the slots only decide which bits pass for rare.  ``df`` is the slot's count,
    so the token's posting list has at most ``df`` rows; ``nb`` is the number of blocks that it is cut into.
    """
    counts = broadcast(sized.sparkSession, _slot_counts(freq))

    def part(b: pa.RecordBatch) -> pa.RecordBatch:
        bits = b.column(1).flatten().to_numpy(zero_copy_only=False)
        lens = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lens)), lens)
        df = counts.value[np.mod(bits, ORDER_SLOTS)]
        order = np.lexsort((bits, df, row))
        pos = np.arange(1, len(bits) + 1) - np.repeat(np.cumsum(lens) - lens, lens)
        # small slack keeps float rounding from ever shortening a prefix (longer is still exact)
        plen = lens - np.ceil(t * lens - 1e-9).astype(np.int64) + k
        keep = (pos <= plen[row]) & (df[order] > 1)
        row, at = row[keep], order[keep]
        return pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(row)), pa.array(lens[row], pa.int32()), pa.array(bits[at], pa.int32()),
             pa.array(pos[keep], pa.int32()), pa.array(-(-df[at] // block), pa.int32())], ["key", "len", "bit", "pos", "nb"])

    def run(batches):
        for b in batches:
            upto = np.cumsum(b.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:  # a part has at most PART_BITS bits, or one row
                before = upto[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(upto, before + PART_BITS, "right")))
                yield part(b.slice(at, stop - at))
                at = stop

    kind = sized.schema["key"].dataType.simpleString()
    cls = F.floor(F.log("len") / F.lit(max(-math.log(t), 1e-9)) + F.lit(1e-9))
    return sized.select("key", "bits", "len").mapInArrow(run, f"key {kind}, len int, bit int, pos int, nb int").withColumn("cls", cls)


def _sides(prefix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The shorter and the longer sets of the self-join on ``(bit, cls, x, y)``.

    ``x`` and ``y`` are the blocks of the two sides: a row stands in its own block, once for
    every block of the other side; the longer set's class is the shorter's or the next.
    """
    own = F.pmod(F.xxhash64("key"), F.col("nb")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    short = prefix.select("bit", "cls", own.alias("x"), others.alias("y"),
                          F.col("key").alias("a"), F.col("len").alias("la"), F.col("pos").alias("ia"))
    long = prefix.withColumn("cls", F.explode(F.array("cls", F.col("cls") - 1))).select(
        "bit", "cls", own.alias("y"), others.alias("x"), F.col("key").alias("b"), F.col("len").alias("lb"), F.col("pos").alias("ib"))
    return short, long


def similar_pairs(reps: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                  prefix_extra: int = 3, block: int = POSTING_BLOCK) -> DataFrame:
    """Exact pairs ``(a, b, sim)``, a < b, with Jaccard(bits_a, bits_b) >= threshold.

    Filters, all exact (no true pair is ever dropped):

    * length: ``t |A| <= |B| <= |A| / t``, so the longer set is in the length class
      (logarithm to the base ``1 / t``) of the shorter or in the next one;
    * prefix: with bits in global (frequency, id) order, a pair needing overlap
      ``o = ceil(t / (1 + t) (|A| + |B|))`` shares its first ``min(k, o)`` common
      bits inside both prefixes of length ``|A| - ceil(t |A|) + k``
      (``k = prefix_extra``), so pairs matching fewer prefix bits are dropped;
    * position: common bits after the last of those are at most
      ``min(|A| - i, |B| - j)`` (i, j its positions), so each of the first ``k`` has
      ``min(|A| - i, |B| - j) + k >= o``; other matches are not even counted.

    A bit's posting list is cut into blocks of about ``block`` rows, and blocks are joined
    against blocks, so a bit that is common to a third of the sets is spread over
    (blocks x blocks) join keys.  If ``t`` > 1/2 this is done for pairs with a tiny set only; other
    sets meet by pairs of neighbouring bits (:func:`tidepool.operators.setjoin.neighbour_candidates`).
    Survivors are verified on the full sets (:func:`verified_pairs`).
    """
    t = float(threshold)
    k = int(prefix_extra)
    ready = dict(reps.dtypes)["bits"] == "binary"
    sets = reps.select("key", "bits", "len") if ready else cut_lineage(packed(reps.select("key", "bits")))
    sets = sets.where((F.col("len") > 0) & F.col("key").isNotNull())
    least = least_size(t)
    tiny = sets if math.isinf(least) else sets.where(F.col("len") * F.lit(t) < F.lit(least) + 1e-6)
    cand = None
    if math.isinf(least) or tiny.where(F.col("len") < least).limit(1).collect():
        cand = _bit_candidates(unpacked(tiny), t, k, block, least)
    if not math.isinf(least):
        more = neighbour_candidates(sets.where(F.col("len") >= least), t)
        cand = more if cand is None else cut_lineage(cand.unionByName(more).distinct())
    return verified_pairs(sets, cand, t)


def _bit_candidates(sized: DataFrame, t: float, k: int, block: int, below: float) -> DataFrame:
    """Candidates ``(a, b)`` by single bits; the shorter set has fewer than ``below``."""
    freq = sized.select(F.explode("bits").alias("bit")).groupBy(F.pmod("bit", F.lit(ORDER_SLOTS)).alias("bit")) \
        .agg(F.count(F.lit(1)).alias("df"))
    prefix = cut_lineage(_prefix_rows(sized, freq, t, k, block))  # read by both sides of the self-join
    short, long = _sides(prefix)
    if not math.isinf(below):
        short = short.where(F.col("la") < below)
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("la") + F.col("lb")) - F.lit(1e-9))
    left = F.least(F.col("la") - F.col("ia"), F.col("lb") - F.col("ib"))
    # the size that Spark expects of the prefix rows is far too small: it must not broadcast them
    matches = short.join(long.hint("merge"), ["bit", "cls", "x", "y"]).where(
        ((F.col("la") < F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("a") < F.col("b"))))
        & (F.col("la") >= F.lit(t) * F.col("lb")) & (left + k >= need))
    per_pair = matches.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"), F.first("la").alias("la"), F.first("lb").alias("lb"))
    cand = cut_lineage(per_pair.where(F.col("m") >= F.least(F.lit(k), need)).select("a", "b"))
    release(prefix)
    return cand


def _cells(cand: DataFrame) -> DataFrame:
    """``(key, cell)``: sets that share candidates stand in the same cell, of about ``CELL_SETS`` sets at most.

    A set's label is the least key within two steps along candidates; a label with many sets is cut by a hash.
    """
    both = cand.unionByName(cand.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = cut_lineage(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("l")))
    label = cut_lineage(both.join(near.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("l")))
    release(near)
    sizes = label.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    cut = F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / CELL_SETS))
    return cut_lineage(join_hot(label, sizes, ["l"], "n").select(F.col("a").alias("key"), F.xxhash64("l", cut).alias("cell")))


def _moves(cand: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates ``(a, b, g)`` with the pair of cells that they meet in, and the sets ``(g, key)`` needed there."""
    cells = _cells(cand)
    pairs = cut_lineage(cand.join(cells.select(F.col("key").alias("a"), F.col("cell").alias("ca")), "a")
                        .join(cells.select(F.col("key").alias("b"), F.col("cell").alias("cb")), "b")
                        .select("a", "b", F.xxhash64(F.least("ca", "cb"), F.greatest("ca", "cb")).alias("g")))
    release(cells)
    return pairs, pairs.select("g", F.col("a").alias("key")).unionByName(pairs.select("g", F.col("b").alias("key"))).distinct()


def verified_pairs(sets: DataFrame, cand: DataFrame, t: float) -> DataFrame:
    """``(a, b, sim)``, a < b, of the candidates with Jaccard similarity >= ``t`` on the full (packed) sets.

    Candidates are dealt out by their two cells, and a set is moved once for each pair of cells that needs it,
    not once for each candidate.  A task reads the sets of a pair of cells, then its candidates, as a stream.
    """
    pairs, wanted = _moves(cand)
    kind = cand.schema["a"].dataType.simpleString()
    rows = wanted.join(sets.select("key", "bits").hint("merge"), "key").select("g", F.col("key").alias("a"), F.lit(None).cast(kind).alias("b"), "bits") \
        .unionByName(pairs.select("g", "a", "b", F.lit(None).cast(sets.schema["bits"].dataType).alias("bits")))

    def run(batches):
        group, held = None, {}
        for batch in batches:
            out_a, out_b, out_s = [], [], []
            gs, ks, bs = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            bits = batch.column(3).to_pylist()
            for i, (g, a, b) in enumerate(zip(gs, ks, bs)):
                if g != group:
                    group, held = g, {}
                if b is None:
                    x = unpack(bits[i])
                    held.setdefault(a, []).append((len(x), np.unique(x)))
                    continue
                for na, xa in held.get(a, ()):
                    for nb, xb in held.get(b, ()):
                        inter = len(np.intersect1d(xa, xb, assume_unique=True))
                        sim = inter / (na + nb - inter)
                        if sim >= t:
                            out_a.append(a)
                            out_b.append(b)
                            out_s.append(sim)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, batch.column(1).type), pa.array(out_b, batch.column(1).type),
                                              pa.array(out_s, pa.float64())], ["a", "b", "sim"])

    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # sets (no b) before the candidates of their cells
    found = rows.repartition(n, "g").sortWithinPartitions("g", F.col("b").asc_nulls_first()) \
        .mapInArrow(run, f"a {kind}, b {kind}, sim double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")


def butina(reps: DataFrame, pairs: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Cluster representatives: ``(key, cluster, is_centre)``; ``cluster`` is the centre's key."""
    und = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nb = und.join(reps.select(F.col("key").alias("b"), F.col("mult").alias("mb")), "b") \
        .groupBy("a").agg(F.sum("mb").alias("s"))
    nodes = reps.join(nb.withColumnRenamed("a", "key"), "key", "left") \
        .select("key", (F.col("mult") - 1 + F.coalesce("s", F.lit(0))).alias("nbrs"))
    nodes = cut_lineage(nodes.select("key", _rank_key().alias("rk")))
    edges = cut_lineage(und.join(nodes.select(F.col("key").alias("b"), F.col("rk").alias("rkb")), "b"))
    live, open_edges = nodes, edges
    centres = None
    rounds = 0
    while True:
        rounds += 1
        best_nbr = open_edges.groupBy("a").agg(F.min("rkb").alias("best"))
        new_c = live.join(best_nbr.withColumnRenamed("a", "key"), "key", "left") \
            .where(F.col("best").isNull() | (F.col("rk") < F.col("best"))).select("key")
        new_c = cut_lineage(new_c)
        if not new_c.limit(1).collect():
            break
        centres = new_c if centres is None else cut_lineage(centres.unionByName(new_c))
        gone = cut_lineage(new_c.unionByName(open_edges.join(new_c.withColumnRenamed("key", "a"), "a", "left_semi")
                                             .select(F.col("b").alias("key"))).distinct())
        # only edges between live nodes go into the next round
        before = (live if rounds > 1 else None, open_edges if rounds > 1 else None, gone)
        live = cut_lineage(live.join(gone, "key", "left_anti"))
        open_edges = cut_lineage(open_edges.join(gone.withColumnRenamed("key", "a"), "a", "left_anti")
                                 .join(gone.withColumnRenamed("key", "b"), "b", "left_anti"))
        release(*before)
        if not live.limit(1).collect():
            break
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"Butina rounds exceeded {max_rounds}")
    if centres is None:
        return reps.select("key", F.col("key").alias("cluster"), F.lit(True).alias("is_centre")).limit(0)
    c_rank = centres.join(nodes, "key").select(F.col("key").alias("b"), F.col("rk").alias("crk"))
    claim = edges.join(c_rank, "b").groupBy("a").agg(F.min(F.struct("crk", "b")).alias("m")) \
        .select(F.col("a").alias("key"), F.col("m.b").alias("cluster"))
    cen = centres.select("key", F.col("key").alias("cluster"), F.lit(True).alias("is_centre"))
    rest = claim.join(centres, "key", "left_anti").select("key", "cluster", F.lit(False).alias("is_centre"))
    return cen.unionByName(rest)


def similarity_clusters(fps: DataFrame, key: str, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """``(key, cluster, is_centre)`` for every input row (copies share their representative's cluster)."""
    spark = fps.sparkSession
    saved = cut_lineage(packed(fps.select(key, "bits")))
    free_shuffles(spark)
    reps, members = collapse_identical(saved, key)
    members, nodes = cut_lineage(members), cut_lineage(reps.select("key", "mult"))
    free_shuffles(spark)
    pairs = cut_lineage(similar_pairs(reps, threshold))
    release(saved)
    free_shuffles(spark)
    cl = butina(nodes, pairs)
    return members.join(cl, "key").select(F.col("member").alias(key), "cluster",
                                          (F.col("is_centre") & (F.col("member") == F.col("key"))).alias("is_centre"))


def split_by_cluster(df: DataFrame, fps: DataFrame, key: str, frac_train: float = 0.8, seed=42,
                     threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Cluster split: similarity clusters, then the biggest-first group split on the cluster id.

    A row without a fingerprint is a cluster of its own.
    """
    from tidepool.operators.split import split_by_group
    cl = similarity_clusters(fps, key, threshold).select(key, "cluster")
    clustered = df.join(cl, key, "left").withColumn("cluster", F.coalesce("cluster", key))
    return split_by_group(clustered, "cluster", frac_train, seed)
