"""Merkle dataset manifest by time-forward processing.

Every row is a leaf (a SHA-256 of its fields).  The leaves of a source form a tree of
fan-out 3, whose root is the source's subroot; the subroots form a tree of the same kind,
whose root stands for the data set.  A leaf's proof is the digests of its siblings, level
by level up to the root.

Time-forward processing treats the tree as a circuit whose nodes are labelled
``(level, index)`` and evaluated in label order: a node's digest is a message to its parent,
kept in a priority queue ordered by the receiver's label until the sweep gets there.  The
queue is external: blocks of ``FANOUT ** BLOCK_LEVELS`` consecutive nodes are evaluated
inside a task with a heap, and the messages that leave a block (one per block) travel through
a shuffle sorted by the label of the receiving block, which is the next round.  The reversed
sweep goes the same way down: a block receives the proof suffix of its top (the siblings
above it) and hands every node its own.  Rounds are ``log(leaves) / log(block)``; a task
holds one block at a time, however large a source is.

Leaves are placed by a range exchange of digests (no texts), so a source with a third of all
rows is spread over all tasks; the tables of windows below have one row per partition and
source.

Defined cases: a NULL field is ``-`` (an empty text is ``0:``); NULL sources form the first source,
NULL ids stand first in their source; rows of one source with equal ids stand in order of
their leaves, identical rows are leaves of their own; a source of one row has its leaf as
subroot, a single source its subroot as root; a row without siblings on any level has the digest of
the empty string as proof; an empty table gives an empty result.  Columns other than those
hashed are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidepool.llm.common import materialize, table
from tidepool.llm.streams import key_runs, to_batches

FANOUT = 3
BLOCK_LEVELS = 7       # a block has at most 3 ** 7 = 2,187 nodes
POS_BITS = 33          # monotonically_increasing_id: partition << 33 | row
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: str) -> str:
    return sha256(parts.encode()).hexdigest()


def field(c: Column) -> Column:
    """``bytes:value``, or ``-`` for NULL."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*cols: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in cols]), 256)


def height_of(n: int) -> int:
    """Levels from ``n`` nodes up to one."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def block_height(n: int, levels: int) -> int:
    """Levels inside a block at a round where the tree has ``n`` nodes."""
    return levels if n > FANOUT ** levels else height_of(n)


def sweep_up(digests: list[str], height: int) -> tuple[list, str]:
    """Inner nodes ``(level, index, child digests)`` of a block in label order, and its top's digest."""
    queue = [(1, i // FANOUT, i % FANOUT, d) for i, d in enumerate(digests)]   # sorted, so a heap
    inner, top = [], digests[0]
    while queue and height:
        level, index = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, index):
            children.append(heappop(queue)[3])
        top = digest("".join(children))
        inner.append((level, index, children))
        if level < height:
            heappush(queue, (level + 1, index // FANOUT, index % FANOUT, top))
    return inner, top


def sweep_down(digests: list[str], height: int, suffix: list) -> list:
    """Proof of every node of a block: ``(left, right, proof of the parent)`` chains ending in ``suffix``."""
    inner, _ = sweep_up(digests, height)
    chain = None
    for left, right in reversed(suffix):
        chain = (left, right, chain)
    waiting = {(height, 0): chain}
    for level, index, children in reversed(inner):
        own = waiting.pop((level, index))
        for slot in range(len(children)):
            waiting[level - 1, FANOUT * index + slot] = (
                "".join(children[:slot]), "".join(children[slot + 1:]), own)
    return [waiting[0, i] for i in range(len(digests))]


def unchain(chain) -> list[tuple[str, str]]:
    out = []
    while chain is not None:
        out.append(chain[:2])
        chain = chain[2]
    return out


def pack(levels: list[tuple[str, str]]) -> str:
    return ";".join(f"{left},{right}" for left, right in levels)


def unpack(s: str) -> list[list[str]]:
    return [level.split(",") for level in s.split(";")] if s else []


def fold(leaf: str, levels: list) -> str:
    """Root that follows from a leaf and its proof."""
    for left, right in levels:
        leaf = digest(left + leaf + right)
    return leaf


def block_of(levels: int) -> Column:
    return F.floor(F.col("idx") / FANOUT ** levels)


def _by_block(nodes: DataFrame, *order: str) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def tops_of_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, idx, n, digest) of the blocks' tops; ``n`` is the number of blocks of the tree."""
    schema = pa.schema([("tree", pa.int64()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tops():
            for rows in key_runs(batches, ["tree", "block"]):
                n = rows[0]["n"]
                _, top = sweep_up([r["digest"] for r in rows], block_height(n, levels))
                yield {"tree": rows[0]["tree"], "idx": rows[0]["block"], "n": -(-n // FANOUT ** levels), "digest": top}
        yield from to_batches(tops(), schema)

    blocks = nodes.select("tree", "idx", "n", "digest", block_of(levels).alias("block"))
    return _by_block(blocks, "idx").mapInArrow(evaluate, "tree long, idx long, n long, digest string")


def forward(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """All rounds' node tables, and the (tree, digest) tops of the trees."""
    rounds, tops = [], None
    while True:
        rounds.append(nodes)
        up = materialize(tops_of_blocks(nodes, levels), "merkle-round")
        done = up.where("n = 1").select("tree", "digest")
        tops = done if tops is None else tops.unionAll(done)
        nodes = up.where("n > 1")
        if nodes.isEmpty():
            return rounds, tops


def descend(nodes: DataFrame, heads: DataFrame, levels: int, emit, out: str, *payload: str) -> DataFrame:
    """Reversed sweep of one round: ``emit(node row, its proof levels, the block's head row)`` per node, as ``out``.

    ``heads``: (tree, block, suffix, top) of the blocks; ``payload``: further columns of ``nodes`` handed to ``emit``.
    """
    schema = to_arrow_schema(StructType.fromDDL(out))

    def deliver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for run in key_runs(batches, ["tree", "block"]):
                head, block = run[0], run[1:]
                chains = sweep_down([r["digest"] for r in block], block_height(block[0]["n"], levels), unpack(head["suffix"]))
                for r, chain in zip(block, chains):
                    yield emit(r, unchain(chain), head)
        yield from to_batches(rows(), schema)

    # heads (kind 0) and nodes (kind 1) in one table: one sorted exchange brings a block together
    n = nodes.select("tree", block_of(levels).alias("block"), F.lit(1).alias("kind"), "idx", "n", "digest", *payload)
    both = n.unionByName(heads.select("*", F.lit(0).alias("kind")), allowMissingColumns=True)
    return _by_block(both, "kind", "idx").mapInArrow(deliver, out)


def backward(rounds: list[DataFrame], suffixes: DataFrame, levels: int) -> DataFrame:
    """(tree, block, suffix, top) for the blocks of the first round; ``suffixes``: (tree, suffix, top) of the trees.

    ``top`` is handed on unchanged to all blocks of a tree.
    """
    def to_child(r, proof, head):
        return {"tree": r["tree"], "block": r["idx"], "suffix": pack(proof), "top": head["top"]}

    heads = None
    for i in range(len(rounds) - 1, -1, -1):
        # trees whose last round this is start here
        last = rounds[i].where((F.col("n") <= FANOUT ** levels) & (F.col("idx") == 0)).select("tree")
        begin = suffixes.join(last, "tree").select("tree", F.lit(0).cast("long").alias("block"), "suffix", "top")
        heads = begin if heads is None else heads.unionAll(begin)
        if i:
            heads = materialize(descend(rounds[i], heads, levels, to_child, "tree long, block long, suffix string, top string"),
                                "merkle-suffix")
    return heads


def place_leaves(leaves: DataFrame) -> DataFrame:
    """Adds ``tree`` (rank of the source), ``idx`` (place in it) and ``n`` (its size) to rows with
    ``source``, ``doc_id`` and ``digest``."""
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # identical rows may go to different partitions: their order does not matter
    order = ["source", "doc_id", "digest", "any"]
    ordered = materialize(leaves.withColumn("any", F.monotonically_increasing_id())
                          .repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("any")
                          .withColumn("pos", F.monotonically_increasing_id()), "merkle-leaves")
    ordered = ordered.withColumn("key", F.struct("source")).withColumn("part", F.shiftright("pos", POS_BITS))
    spans = materialize(ordered.groupBy("key", "part").agg(F.min("pos").alias("lo"), F.count(F.lit(1)).alias("cnt")),
                        "merkle-spans")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    sources = spans.groupBy("key").agg(F.min("lo").alias("first"), F.sum("cnt").alias("n")) \
        .withColumn("part", F.shiftright("first", POS_BITS))
    starts = sources.groupBy("part").agg(F.count(F.lit(1)).alias("k")) \
        .select("part", F.coalesce(F.sum("k").over(earlier.orderBy("part")), F.lit(0)).alias("base"))
    trees = sources.join(starts, "part").select(
        "key", "n", (F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1).alias("tree"))
    before = F.coalesce(F.sum("cnt").over(earlier.partitionBy("key").orderBy("part")), F.lit(0))
    shifts = spans.select("key", "part", (before - F.col("lo")).alias("shift")).join(trees, "key")
    return ordered.join(shifts, ["key", "part"]).withColumn("idx", F.col("pos") + F.col("shift")) \
        .drop("key", "part", "pos", "shift")


def merkle_manifest(rows: DataFrame, checked: str = "digest", id_col: str = "doc_id",
                    levels: int = BLOCK_LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root) of leaves ``(doc_id, source, digest)``.

    ``proof``: per level the digests of the left and of the right siblings, as :func:`pack` writes them; ``folded_root`` is computed from the leaf digest in column ``checked``.
    A block spans ``levels`` levels.
    """
    id_type = rows.schema[id_col].dataType.simpleString()
    out = f"doc_id {id_type}, leaf string, subroot string, root string, proof string, folded_root string"
    leaves = materialize(place_leaves(rows.select(F.col(id_col).alias("doc_id"), "source", "digest",
                                                  F.col(checked).alias("checked"))).drop("source"), "merkle-placed")
    if leaves.isEmpty():
        return rows.sparkSession.createDataFrame([], out)
    rounds, subroots = forward(leaves, levels)
    subroots = materialize(subroots, "merkle-subroots")
    sources = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"),
                              F.lit(subroots.count()).cast("long").alias("n"), "digest")
    upper, tops = forward(sources, levels)
    root = tops.first()["digest"]
    known = backward(upper, tops.select("tree", F.lit("").alias("suffix"), F.col("digest").alias("top")), levels)

    def to_source(r, proof, head):
        return {"tree": r["idx"], "suffix": pack(proof), "top": r["digest"]}

    def to_leaf(r, proof, head):
        return {"doc_id": r["doc_id"], "leaf": r["digest"], "subroot": head["top"], "root": root,
                "proof": pack(proof), "folded_root": fold(r["checked"], proof)}

    of_sources = materialize(descend(sources, known, levels, to_source, "tree long, suffix string, top string"), "merkle-sources")
    return descend(leaves, backward(rounds, of_sources, levels), levels, to_leaf, out, "doc_id", "checked")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of ``documents``; the checked leaf of a row with an even CRC-32 of its id has a text without ``\\n``."""
    docs = table(spark, sf_dir, "documents")
    cols = {c: F.col(c) for c in FIELDS}
    changed = F.when(F.crc32(cols["doc_id"].cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))) \
        .otherwise(cols["text"])
    leaves = docs.select("doc_id", "source", leaf_digest(*cols.values()).alias("digest"),
                         leaf_digest(*{**cols, "text": changed}.values()).alias("checked"))
    m = merkle_manifest(leaves, "checked")
    return m.select("doc_id", "leaf", "subroot", "root", F.sha2(F.translate("proof", ",;", ""), 256).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 of an ASCII string as a DuckDB expression over a column ``s``
def sql_crc32(s: str) -> str:
    bit = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    step = "list_reduce(list_prepend(CAST({0} AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, i: " + bit + ")"
    chars = f"list_transform(string_split({s}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    over = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {chars}), lambda a, b: {step.format('xor(a, b)')})"
    return f"xor({over}, 4294967295)"


OP13_SQL = f"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') ||
    coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') ||
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    CASE WHEN {sql_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM documents
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS checked FROM f
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves
), up AS (
  SELECT tree, CAST(0 AS BIGINT) AS lvl, idx, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM up) WHERE n > 1 GROUP BY tree, lvl, idx // 3
), tops AS (SELECT tree, max(lvl) AS top, arg_max(digest, lvl) AS subroot FROM up GROUP BY tree),
over AS (
  SELECT CAST(0 AS BIGINT) AS lvl, tree AS idx, subroot AS digest FROM tops
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER () AS n FROM over) WHERE n > 1 GROUP BY lvl, idx // 3
), steps AS (
  SELECT p.doc_id, p.tree, p.idx, u.lvl,
    coalesce(string_agg(CASE WHEN u.idx < p.idx // CAST(pow(3, u.lvl) AS BIGINT) THEN digest END, '' ORDER BY u.idx), '') AS l,
    coalesce(string_agg(CASE WHEN u.idx > p.idx // CAST(pow(3, u.lvl) AS BIGINT) THEN digest END, '' ORDER BY u.idx), '') AS r
  FROM placed p JOIN tops t USING (tree)
  JOIN up u ON u.tree = p.tree AND u.lvl < t.top AND u.idx // 3 = p.idx // CAST(pow(3, u.lvl + 1) AS BIGINT)
  GROUP BY ALL
  UNION ALL
  SELECT p.doc_id, p.tree, p.idx, t.top + o.lvl,
    coalesce(string_agg(CASE WHEN o.idx < p.tree // CAST(pow(3, o.lvl) AS BIGINT) THEN digest END, '' ORDER BY o.idx), ''),
    coalesce(string_agg(CASE WHEN o.idx > p.tree // CAST(pow(3, o.lvl) AS BIGINT) THEN digest END, '' ORDER BY o.idx), '')
  FROM placed p JOIN tops t USING (tree)
  JOIN over o ON o.lvl < (SELECT max(lvl) FROM over) AND o.idx // 3 = p.tree // CAST(pow(3, o.lvl + 1) AS BIGINT)
  GROUP BY p.doc_id, p.tree, p.idx, t.top, o.lvl
), proofs AS (
  SELECT tree, idx, list([l, r] ORDER BY lvl) AS levels, string_agg(l || r, '' ORDER BY lvl) AS proof FROM steps GROUP BY tree, idx
), folded AS (
  SELECT tree, idx, CAST(1 AS BIGINT) AS k, checked AS d FROM placed
  UNION ALL
  SELECT f.tree, f.idx, k + 1, sha256(levels[k][1] || d || levels[k][2]) FROM folded f JOIN proofs q USING (tree, idx)
  WHERE k <= len(levels)
)
SELECT p.doc_id, p.leaf, t.subroot, (SELECT arg_max(digest, lvl) FROM over) AS root,
  sha256(coalesce(q.proof, '')) AS proof_sha256, f.d AS folded_root, f.d = (SELECT arg_max(digest, lvl) FROM over) AS verified
FROM placed p JOIN tops t USING (tree) LEFT JOIN proofs q USING (tree, idx)
JOIN (SELECT tree, idx, arg_max(d, k) AS d FROM folded GROUP BY tree, idx) f USING (tree, idx)
"""
