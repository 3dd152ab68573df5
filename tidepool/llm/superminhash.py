"""MinHash near-duplicate groups with SuperMinHash signatures.

A text's set is its distinct word shingles (64-bit hashes).  SuperMinHash gives every
element a random permutation of the signature's slots and a random value in every step:
in step ``i`` the element offers ``i + r`` to the ``i``-th slot of its permutation, and a slot keeps the
least offer.  As the offers of a step are all below those of the next, a signature is
complete (early stopping) once every slot has an offer, mostly after the first step
or two; slots of one text are correlated so that they estimate the similarity with less variance than
independent minima.  Steps are taken for all elements of a text at once.

Banding: ``bands`` keys of ``band_rows`` slots each; texts that share a key are
candidates.  With the 32 bands of 5 slots used here a pair at similarity 0.8 shares none with probability
3e-6, one at 0.9 with 1e-12.  Verification computes the exact similarity of full sets.  Union-find
grouping joins verified links into components.

Equal sets are one node from the start.  A bucket (nodes that share a key) never makes
all its pairs: its members are verified against its hub only, the most central member (the one that
shares most keys with others, which for edited copies is their original).  That leaves pairs of a hub's
members in different components of the links found.  Two sets of that similarity share an element
among the first ``n - ceil(0.8 n) + 1`` of each, in any common order; with the elements that the hub lacks in front, those that
the fewest members hold first, these are a copy's own edits, so members that are not close to the hub meet only those that share
their edits.  Such pairs across components are verified too, hence no link between components is
lost.  Keys, hubs and groups with more than one in ``HOT_SHARE`` of all rows, at
most ``HOT_SHARE`` of them, meet their rows by a broadcast or by salts.

Defined cases: texts with fewer words than a shingle are one element; NULL or wordless
texts have empty sets and are groups of their own; repeated rows share a group; a NULL id
names a group only if it has no other, and is then kept; an empty table gives an empty result; only the id and text
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidepool.llm.common import materialize, table, text_of
from tidepool.llm.components import connected_components

HOT_SHARE = 5_000
HUB_SALTS = 64
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# -- signatures (inside tasks) --------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (A-Z lower-cased)."""
    from xxhash import xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=n)
    size = min(shingle, n)
    acc = h[:n - size + 1]
    for j in range(1, size):
        acc = mix(acc * GOLDEN + h[j:n - size + 1 + j])
    return np.unique(mix(acc + np.uint64(size)))


def superminhash(elements: np.ndarray, slots: int) -> np.ndarray:
    """Signature of a non-empty set: least offer per slot."""
    sig = np.full(slots, np.inf)
    rows = np.arange(len(elements))
    perm = None
    for i in range(slots):
        draw = mix(elements + np.uint64((i + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        r = (draw >> np.uint64(24)) * 2.0 ** -40
        k = i + (((draw & np.uint64(0xFFFFFF)) * np.uint64(slots - i)) >> np.uint64(24)).astype(np.int64)
        if i == 0:
            slot, first = k, k
        else:
            if perm is None:                       # the first step's exchange, made up for
                perm = np.tile(np.arange(slots, dtype=np.int32), (len(elements), 1))
                perm[rows, first], perm[:, 0] = 0, first
            slot = perm[rows, k]
            perm[rows, k] = perm[:, i]
            perm[:, i] = slot
        np.minimum.at(sig, slot, i + r)
        if sig.max() < i + 1:                      # later offers are all larger
            break
    return sig


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    v = sig.view(np.uint64).reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64) * MIX2
    for j in range(v.shape[1]):
        key = mix(key * GOLDEN + v[:, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, band_rows: int) -> DataFrame:
    """(id, n, node, keys) per row: set size, 128-bit digest of the set, band keys; NULL node and keys if empty."""
    id_field = docs.schema[id_col]
    schema = pa.schema([("id", to_arrow_type(id_field.dataType)), ("n", pa.int64()), ("node", pa.binary()),
                        ("keys", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh128_digest
        for b in batches:
            n, node, keys = [], [], []
            for text in b.column(1):
                s = shingle_set(text.as_py(), shingle)
                n.append(len(s))
                node.append(xxh128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(superminhash(s, bands * band_rows), bands) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()),
                                              pa.array(keys, schema.field("keys").type)], schema=schema)
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")) \
        .mapInArrow(sign, f"id {id_field.dataType.simpleString()}, n long, node binary, keys array<long>")


# -- joins that survive hot keys --------------------------------------------------------------------

def join_hot(rows: DataFrame, info: DataFrame, keys: list[str], hot) -> DataFrame:
    """``rows`` joined with ``info`` (one row per key); info rows that are ``hot`` are broadcast.

    ``hot`` is a condition that holds for at most ``HOT_SHARE`` rows of ``info``.
    """
    few = F.broadcast(info.where(hot))
    return rows.join(few, keys).unionByName(
        rows.join(few.select(*keys), keys, "left_anti").join(info.where(~hot), keys))


def over(count: str, total: int):
    """Groups with more than one in ``HOT_SHARE`` of ``total`` rows: fewer than ``HOT_SHARE`` of them."""
    return F.col(count) > max(total // HOT_SHARE, 1_000)


# -- links --------------------------------------------------------------------------------------------

def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(num, set) of the nodes in ``wanted`` (num, node, rep), from the texts of their representative rows."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([("node", pa.binary()), ("set", pa.list_(pa.int64()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh128_digest
        for b in batches:
            for at in range(0, b.num_rows, 256):
                sets = [shingle_set(t.as_py(), shingle) for t in b.column(0).slice(at, 256)]
                yield pa.RecordBatch.from_arrays([pa.array([xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                                                  pa.array([s.view(np.int64) for s in sets], schema.field("set").type)], schema=schema)
    ids = wanted.select(F.col("rep").cast(id_type).alias("_rep")).distinct()
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text")) \
        .join(ids, F.col("_id").eqNullSafe(F.col("_rep")), "left_semi").select("text")
    sets = texts.mapInArrow(build, "node binary, set array<long>").join(wanted.select("node", "num"), "node")
    return sets.groupBy("num").agg(F.first("set").alias("set"))


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, n, link, edits, common) of pairs (a, b): size of ``b``, similarity reached, what ``b`` has and ``a`` lacks, and
    so many of their common elements as complete the prefix of ``b``.

    Hubs among ``a`` are salted.
    """
    degrees = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    hubs = F.broadcast(degrees.where(over("d", pairs.count())).select("a", F.lit(HUB_SALTS).cast("long").alias("salts")))
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    salted = pairs.join(hubs, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), salts)).drop("salts")
    left = sets.select(F.col("num").alias("a"), F.col("set").alias("sa")).join(hubs, "a", "left") \
        .select("a", "sa", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    both = sets.select(F.col("num").alias("b"), F.col("set").alias("sb")).join(salted, "b").join(left, ["a", "salt"])
    both = both.select("a", "b", "sb", F.size("sa").alias("na"), F.size("sb").alias("n"), F.array_intersect("sb", "sa").alias("common"))
    inter = F.size("common")
    rest = F.greatest(prefix_length("n", percent) - (F.col("n") - inter), F.lit(0))
    return both.select("a", "b", "n", (100 * inter >= percent * (F.col("na") + F.col("n") - inter)).alias("link"),
                       F.array_except("sb", "common").alias("edits"), F.slice("common", F.lit(1), rest).alias("common"))


def prefix_length(n: str, percent: int):
    return (F.col(n) - F.ceil(F.col(n) * percent / 100) + 1).cast("int")


def compare(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    pairs = materialize(pairs, "smh-pairs")
    ends = pairs.select(F.col("a").alias("num")).union(pairs.select("b")).distinct()
    wanted = materialize(nodes.select("num", "node", "rep").join(ends, "num", "left_semi"), "smh-wanted")
    sets = materialize(full_sets(docs, wanted, id_col, text_col, shingle), "smh-sets")
    return materialize(compared(pairs, sets, percent), "smh-compared")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
                          bands: int = 32, band_rows: int = 5) -> DataFrame:
    """(id, n, component_id) per row: size of its set and smallest id reachable over links of ``percent`` similarity."""
    rows = materialize(signatures(docs, id_col, text_col, shingle, bands, band_rows), "smh-signatures")
    nodes = materialize(rows.where("node is not null").groupBy("node").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies"))
        .withColumn("num", F.monotonically_increasing_id()), "smh-nodes")
    buckets = nodes.select("num", F.explode("keys").alias("key"))
    shared = materialize(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "smh-shared")
    members = bands * nodes.count()
    live = materialize(join_hot(buckets, shared, ["key"], over("c", members)), "smh-buckets")

    weight = live.groupBy("num").agg(F.sum("c").alias("w"))
    hubs = materialize(live.join(weight, "num").groupBy("key", "c").agg(F.max(F.struct("w", "num")).alias("hub"))
                       .select("key", "c", F.col("hub.num").alias("a")), "smh-hubs")
    stars = join_hot(live.drop("c"), hubs, ["key"], over("c", members)).where(F.col("num") != F.col("a")) \
        .select("a", F.col("num").alias("b")).distinct()
    starred = compare(stars, nodes, docs, id_col, text_col, shingle, percent)
    links = starred.where("link").select("a", "b")

    star = connected_components(links, "a", "b")
    across = pairs_across(starred, star, percent)
    more = compare(across, nodes, docs, id_col, text_col, shingle, percent).where("link").select("a", "b")
    if not more.isEmpty():
        star = connected_components(links.unionAll(more), "a", "b")
    return name_groups(rows, nodes, star)


def pairs_across(starred: DataFrame, star: DataFrame, percent: int) -> DataFrame:
    """Pairs of one hub's members that lie in different components and share an element of their prefixes in reach.

    Members of the hub's own component are met by the others only, never by each other.
    """
    total = starred.count()
    label = star.select(F.col("node").alias("num"), F.col("root").alias("comp"))
    degrees = starred.groupBy("a").agg(F.count(F.lit(1)).alias("d")).join(label, F.col("a") == F.col("num"), "left") \
        .select("a", "d", F.coalesce("comp", "a").alias("ca"))
    placed = starred.drop("link").join(label, F.col("b") == F.col("num"), "left") \
        .select("a", "b", "n", "edits", "common", F.coalesce("comp", "b").alias("cb"))
    placed = materialize(join_hot(placed, degrees, ["a"], over("d", total)), "smh-placed")
    mixed = placed.groupBy("a").agg(F.max("d").alias("d"), F.sum((F.col("ca") != F.col("cb")).cast("long")).alias("apart")) \
        .where("apart > 0 and d > 1").select("a", "d")
    mixed = materialize(mixed, "smh-mixed")
    placed = join_hot(placed.drop("d"), mixed, ["a"], over("d", total)) \
        .withColumn("apart", F.col("ca") != F.col("cb")).withColumn("u", F.size("edits"))
    member = ["a", "b", "n", "cb", "apart"]
    edits = materialize(placed.select(*member, F.explode("edits").alias("token")), "smh-edits")
    held = materialize(edits.groupBy("a", "token").agg(F.count(F.lit(1)).alias("c")), "smh-held")
    rarest = Window.partitionBy("a", "b").orderBy("c", "token")
    edits = join_hot(edits, held, ["a", "token"], over("c", edits.count())) \
        .withColumn("i", F.row_number().over(rarest) - 1).where(F.col("i") < prefix_length("n", percent))
    common = placed.select(*member, "u", F.posexplode("common").alias("at", "token")).withColumn("i", F.col("u") + F.col("at"))
    tokens = materialize(edits.select(*member, "token", "i").unionAll(common.select(*member, "token", "i")), "smh-prefixes")
    left = tokens.where("apart").select("a", "token", "b", "n", "cb", "i")
    right = tokens.select("a", "token", F.col("b").alias("b2"), F.col("n").alias("n2"), F.col("cb").alias("cb2"), F.col("i").alias("i2"))
    need = F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent))
    reach = 1 + F.least(F.col("n") - 1 - F.col("i"), F.col("n2") - 1 - F.col("i2"))
    return left.join(right, ["a", "token"]).where((F.col("cb") != F.col("cb2")) & (reach >= need)
                                                  & (100 * F.col("n") >= percent * F.col("n2")) & (100 * F.col("n2") >= percent * F.col("n"))) \
        .select(F.least("b", "b2").alias("a"), F.greatest("b", "b2").alias("b")).distinct()


def name_groups(rows: DataFrame, nodes: DataFrame, star: DataFrame) -> DataFrame:
    """(id, n, component_id): every group is named by its smallest id."""
    total = rows.count()
    rooted = materialize(nodes.select("num", "node", "rep", "copies").join(star.withColumnRenamed("node", "num"), "num", "left")
                         .select("node", "rep", "copies", F.coalesce("root", "num").alias("root")), "smh-rooted")
    names = materialize(rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("size")), "smh-names")
    named = join_hot(rooted, names, ["root"], over("size", total)).select("node", "copies", "component_id")
    named = materialize(named, "smh-named")
    filled = join_hot(rows.where("node is not null").select("id", "n", "node"), named, ["node"], over("copies", total))
    return filled.select("id", "n", "component_id").unionAll(
        rows.where("node is null").select("id", "n", F.col("id").alias("component_id")))


def op12_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = near_duplicate_groups(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return g.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
                    F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sn AS (SELECT s.doc_id, s.sh, n.n FROM s JOIN n USING (doc_id)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sn a JOIN sn b ON a.sh = b.sh AND a.doc_id < b.doc_id
    AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), arcs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS d, doc_id AS c FROM documents
  UNION
  SELECT arcs.b, reach.c FROM reach JOIN arcs ON arcs.a = reach.d
), g AS (SELECT d, min(c) AS component_id FROM reach GROUP BY d)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, g.component_id, w.doc_id = g.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN g ON g.d = w.doc_id
"""
