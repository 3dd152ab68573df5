"""Conversation structure repair by rank-convergence parallel Viterbi.

The rows of a conversation, in order of turn, are kept, given the other role, deleted, or
preceded by empty inserted rows, at least cost, so that the initials of the roles read
``(s?(ua)+)?`` (a system row, then user and assistant in turn).  Every row is one min-plus
step on a vector of four costs, one per state of that pattern, so the cost of repairing
the rows from any place on is a backward recurrence over the whole conversation.

Rank convergence makes that recurrence parallel: a conversation is cut into chunks of at most
``2 ** CHUNK_BITS`` neighbouring rows.  All chunks but the last start from a speculative
cost vector at their right end.  Fix-up passes hand every chunk its right neighbour's vector; where it
differs from the one used by more than a constant, the chunk is rerun, and only until its
vectors differ from the earlier ones by a constant (min-plus products converge to
rank one, so that is soon).  When no chunk differs by more than a constant, the vectors are
the true ones up to a constant per chunk; the sum of these constants and the first chunk's cost is the
conversation's.  Tracing needs only differences: every chunk maps its entry state to its exit
state, the maps are composed per range partition and then per conversation, and each chunk
writes the least audit from its own entry state.

Rows are placed by a range exchange after equal rows (same conversation, turn, role and text)
are counted, so one conversation with a third of all rows is spread over all tasks.

Defined cases: NULL roles and texts read as one space; NULL conversations form one; NULL turns
come first; rows of one turn stand in order of role and text; a repeated row is a duplicate
like any other; roles count by their first character, an empty role has none and fits nowhere; a
conversation without rows left has zero counts and an empty audit; an empty table gives an empty result;
other columns are ignored.  Audits and digests are one string per conversation by contract.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidepool.llm.common import WORD, materialize, table
from tidepool.llm.merkle import sql_crc32
from tidepool.llm.streams import to_batches

# fixed values: costs of the edits, states of the role pattern
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
WANTED = "uuau"                 # role initial that states 0 (start), 1 (after s), 2 (after u), 3 (after a) go on with
AFTER = (2, 2, 3, 2)            # ... and the state that follows
FINAL = (0, 6, 3, 0)            # cost of the rows still missing at the end

CHUNK_BITS = 10                 # 1,024 different rows a chunk
POS_BITS = 33                   # monotonically_increasing_id: partition << 33 | row
EMPTY_SHA = sha256(b"").hexdigest()


# -- steps on cost vectors (inside tasks) ---------------------------------------------------------

def keeps(state: int, initial: str) -> int | None:
    """State after a kept row, None where the pattern does not allow it."""
    if initial == "s":
        return 1 if state == 0 else None
    return AFTER[state] if initial == WANTED[state] else None


def step(after: tuple, initial: str, fault: str) -> tuple:
    """Costs before a row from those after it."""
    best = [DELETE + c for c in after]
    if fault in ("", "t"):
        extra = TRUNCATED if fault else 0
        for s in range(4):
            t = keeps(s, initial)
            best[s] = min(best[s], extra + REROLE + after[AFTER[s]], best[s] if t is None else extra + after[t])
    u, a = best[2], best[3]
    best[2], best[3] = min(u, INSERT + a), min(a, INSERT + u)
    best[0], best[1] = min(best[0], INSERT + best[2]), min(best[1], INSERT + best[2])
    return tuple(best)


def row_steps(r: dict) -> list[tuple]:
    """(initial, fault, pos) of every row of a chunk; copies of a row have to go like any duplicate."""
    out = []
    for i, m in enumerate(r["copies"]):
        initial, fault = r["codes"][2 * i], r["codes"][2 * i + 1].strip()
        out.append((initial, fault, r["lo"] + i))
        out.extend([(initial, "d", r["lo"] + i)] * (m - 1))
    return out


def sweep(steps: list[tuple], right: tuple) -> tuple:
    for initial, fault, _ in reversed(steps):
        right = step(right, initial, fault)
    return right


def offset(a, b) -> int | None:
    """The constant by which ``a`` exceeds ``b``, None if there is none."""
    d = a[0] - b[0]
    return d if all(x - y == d for x, y in zip(a, b)) else None


def fix_up(steps: list[tuple], new: tuple, old: tuple, left: tuple) -> tuple:
    """Left vector for right vector ``new``, given that ``old`` led to ``left``: reruns until both differ by a constant."""
    for initial, fault, _ in reversed(steps):
        d = offset(new, old)
        if d is not None:
            return tuple(x + d for x in left)
        new, old = step(new, initial, fault), step(old, initial, fault)
    return new


def trace(steps: list[tuple], right: tuple, state: int, last: bool) -> tuple[str, int, list[dict]]:
    """(audit, exit state, lines) of a chunk entered in ``state``: at every place the ASCII-least cheapest edit."""
    costs = [right]
    for initial, fault, _ in reversed(steps):
        costs.append(step(costs[-1], initial, fault))
    costs.reverse()
    audit, lines = [], []

    def line(pos, role, own):
        lines.append({"pos": pos, "sub": len(lines), "role": role, "own": own})
    i, n = 0, len(steps)
    while i < n or (last and costs[n][state] > 0):
        here = costs[i][state]
        if i < n:
            initial, fault, pos = steps[i]
            after = costs[i + 1]
            if DELETE + after[state] == here:
                audit.append("D")
                i += 1
                continue
        if i == n or INSERT + costs[i][AFTER[state]] == here:
            audit.append("I")
            line(pos, ROLES[WANTED[state]], False)
            state = AFTER[state]
            continue
        t = keeps(state, initial)
        extra = TRUNCATED if fault else 0
        if t is not None and extra + after[t] == here:
            audit.append("K")
            line(pos, None, True)
            state = t
        else:
            audit.append("R")
            line(pos, ROLES[WANTED[state]], True)
            state = AFTER[state]
        i += 1
    return "".join(audit), state, lines


# -- Spark ------------------------------------------------------------------------------------------

def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, m): rows damaged by the CRC-32 of ``conv:turn`` modulo 20; ``m`` copies of each."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)])
    t = turns.select(F.struct(F.col(conv_col).alias("id")).alias("conv"), F.col(turn_col).alias("turn"),
                     F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
                     F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("k"))
    text = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return t.where("k != 0").select("conv", "turn", F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                                    text.alias("text"), F.when(F.col("k") == 3, 2).otherwise(1).cast("long").alias("m"))


def placed_rows(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, m, initial, fault, first, pos): different rows in order, with the fault of the first copy.

    ``fault``: ``b`` blank, ``d`` duplicate, ``t`` truncated or empty; rows neighbour where ``pos`` does.
    """
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    r = rows.withColumn("said", said).withColumn("at", when).groupBy("conv", "said", "at").agg(
        F.first("role").alias("role"), F.first("text").alias("text"), F.sum("m").alias("m"))
    first = rows.select("conv", said.alias("said"), when.alias("at")).groupBy("conv", "said").agg(F.min("at").alias("at")) \
        .withColumn("first", F.lit(True))
    blank = ~F.col("text").rlike(WORD)
    fault = F.when(blank, "b").when(F.col("first").isNull(), "d") \
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "t").otherwise("")
    r = r.join(first, ["conv", "said", "at"], "left").select(
        "conv", "at", "role", "text", "m", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "at", "role", "text"]
    return materialize(r.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(
        "pos", F.monotonically_increasing_id()), "repair-rows")


def cut_chunks(rows: DataFrame, chunk_bits: int) -> DataFrame:
    """(conv, part, chunk, next, many, lo, codes, copies): a conversation's rows of one chunk, and the chunk after it.

    ``codes`` has two characters a row, its role's initial (``?`` for one that the pattern does not know) and its fault.
    """
    code = F.concat(F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("?"), F.rpad("fault", 1, " "))
    c = rows.groupBy("conv", F.shiftright("pos", chunk_bits).alias("chunk")).agg(
        F.min("pos").alias("lo"), F.array_sort(F.collect_list(F.struct("pos", code.alias("code"), "m"))).alias("rows"))
    c = c.withColumn("part", F.shiftright("chunk", POS_BITS - chunk_bits))
    spans = c.groupBy("conv", "part").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    after, whole = Window.partitionBy("conv").orderBy("part"), Window.partitionBy("conv")
    spans = spans.select("conv", "part", "last", F.lead("first").over(after).alias("then"),
                         (F.min("first").over(whole) != F.max("last").over(whole)).alias("many"))
    c = c.join(spans, ["conv", "part"]).select(
        "conv", "part", "chunk", F.when(F.col("chunk") < F.col("last"), F.col("chunk") + 1).otherwise(F.col("then")).alias("next"),
        "many", "lo", F.array_join(F.transform("rows", lambda x: x["code"]), "").alias("codes"),
        F.transform("rows", lambda x: x["m"]).alias("copies"))
    return materialize(c, "repair-chunks")


def _map_rows(df: DataFrame, fn, out: str, keep: list[str]) -> DataFrame:
    """One output row per row of ``df``: columns ``keep`` and those that ``fn(row)`` returns, typed by the DDL ``out``."""
    ddl = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep), out])
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i in range(b.num_rows):               # one chunk at a time in Python form
                    r = b.slice(i, 1).to_pylist()[0]
                    yield {**{k: r[k] for k in keep}, **fn(r)}
        yield from to_batches(rows(), schema)
    return df.mapInArrow(run, ddl)


def converge(chunks: DataFrame) -> DataFrame:
    """(conv, chunk, right, left, shift): vectors at the ends of all chunks, true up to ``shift`` against the next chunk."""
    def speculate(r):
        return {"right": FINAL, "left": sweep(row_steps(r), FINAL)}

    def rerun(r):
        d = offset(r["new"], r["right"])
        if d is not None:
            return {"right2": r["right"], "left2": r["left"], "shift": d}
        left = fix_up(row_steps(r), tuple(r["new"]), tuple(r["right"]), tuple(r["left"]))
        return {"right2": r["new"], "left2": left, "shift": None}

    vectors = materialize(_map_rows(chunks, speculate, "right array<long>, left array<long>", ["conv", "chunk", "next", "many"]),
                          "repair-speculated")
    exact = vectors.where("next is null").select("conv", "chunk", "right", "left", F.lit(0).cast("long").alias("shift"))
    state = vectors.where("next is not null").select("conv", "chunk", "next", "right", "left")
    if state.isEmpty():
        return exact
    ends = vectors.where("next is null and many").select("conv", F.col("chunk").alias("next"), F.col("left").alias("new"))
    bodies = chunks.where("next is not null").select("conv", "chunk", "lo", "codes", "copies")
    while True:
        news = ends.unionAll(state.select("conv", F.col("chunk").alias("next"), F.col("left").alias("new")))
        asked = state.join(news, ["conv", "next"]).join(bodies, ["conv", "chunk"])
        state = materialize(_map_rows(asked, rerun, "right2 array<long>, left2 array<long>, shift long", ["conv", "chunk", "next"])
                            .withColumnsRenamed({"right2": "right", "left2": "left"}), "repair-pass")
        if state.where("shift is null").isEmpty():
            return exact.unionAll(state.select("conv", "chunk", "right", "left", "shift"))
        state = state.drop("shift")


def entry_states(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(conv, chunk, state) in conversations of several chunks.

    Exit states are composed over the chunks of a range partition, then over a conversation's partitions.
    """
    def exits(r):
        steps = row_steps(r)
        return {"exits": [trace(steps, tuple(r["right"]), s, False)[1] for s in range(4)]}

    def through(r):
        out = list(range(4))
        for x in r["run"]:
            out = [x["exits"][s] for s in out]
        return {"exits": out}

    def before(r):
        state, out = r["state"], []
        for x in r["run"]:
            out.append({"at": x["at"], "state": state})
            state = x["exits"][state]
        return {"states": out}

    many = chunks.where("many").join(vectors.select("conv", "chunk", "right"), ["conv", "chunk"])
    maps = _map_rows(many, exits, "exits array<int>", ["conv", "part", "chunk"])

    def in_order(at):
        return F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), "exits"))).alias("run")

    runs = materialize(maps.groupBy("conv", "part").agg(in_order("chunk")), "repair-exits")
    parts = _map_rows(runs, through, "exits array<int>", ["conv", "part"]).groupBy("conv").agg(in_order("part"))
    entered = _map_rows(parts.withColumn("state", F.lit(0)), before, "states array<struct<at:long,state:int>>", ["conv"]) \
        .select("conv", F.explode("states").alias("e")).select("conv", F.col("e.at").alias("part"), "e.state")
    return _map_rows(runs.join(entered, ["conv", "part"]), before, "states array<struct<at:long,state:int>>", ["conv"]) \
        .select("conv", F.explode("states").alias("e")).select("conv", F.col("e.at").alias("chunk"), "e.state")


def repair(rows: DataFrame, chunk_bits: int = CHUNK_BITS) -> tuple[DataFrame, DataFrame]:
    """``rows``: (conv, turn, role, text, m).  Returns the conversations and their repaired rows.

    Conversations: (conv, blank, duplicate, truncated, illegal, cost, audit).  Repaired rows:
    (conv, pos, sub, role, text), in order of (pos, sub) within a conversation.
    """
    placed = placed_rows(rows)
    chunks = cut_chunks(placed, chunk_bits)
    vectors = materialize(converge(chunks), "repair-vectors")
    states = entry_states(chunks, vectors)

    def traced(r):
        steps = row_steps(r)
        audit, _, lines = trace(steps, tuple(r["right"]), r["state"] or 0, r["next"] is None)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(steps, steps[1:]))
        return {"audit": audit, "lines": lines, "illegal": illegal, "head": steps[0][0], "tail": steps[-1][0]}

    work = chunks.join(vectors.select("conv", "chunk", "right"), ["conv", "chunk"]).join(states, ["conv", "chunk"], "left")
    done = materialize(_map_rows(work, traced, "audit string, lines array<struct<pos:long,sub:int,role:string,own:boolean>>, "
                                   "illegal long, head string, tail string", ["conv", "chunk", "next"]), "repair-traced")
    seams = done.where("next is not null").select("conv", F.col("next").alias("chunk"), "tail").join(
        done.select("conv", "chunk", "head"), ["conv", "chunk"]) \
        .groupBy("conv").agg(F.sum((~F.concat("tail", "head").isin("su", "ua", "au")).cast("long")).alias("seams"))
    audits = done.groupBy("conv").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"),
        F.sum("illegal").alias("illegal"))
    first = F.min(F.struct("chunk", F.col("left")[0].alias("c")))["c"]
    costs = vectors.groupBy("conv").agg((first + F.sum("shift")).alias("cost"))
    blank, dup = F.col("fault") == "b", F.col("fault") == "d"
    counts = placed.groupBy("conv").agg(
        F.sum(F.when(blank, F.col("m")).otherwise(0)).alias("blank"),
        F.sum(F.when(blank, 0).when(dup, F.col("m")).otherwise(F.col("m") - 1)).alias("duplicate"),
        F.sum((F.col("fault") == "t").cast("long")).alias("truncated"))
    convs = counts.join(audits, "conv").join(costs, "conv").join(seams, "conv", "left").select(
        "conv", "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce("seams", F.lit(0))).alias("illegal"), "cost", "audit")
    lines = done.select("conv", F.explode("lines").alias("l")).select("conv", "l.pos", "l.sub", F.col("l.role").alias("new"), "l.own")
    kept = lines.where("own").join(placed.select("pos", "role", "text"), "pos").select(
        "conv", "pos", "sub", F.coalesce("new", "role").alias("role"), "text")
    added = lines.where("not own").select("conv", "pos", "sub", F.col("new").alias("role"), F.lit("").alias("text"))
    return convs, kept.unionByName(added)


def digests(lines: DataFrame) -> DataFrame:
    """(conv, sha): SHA-256 of the newline-joined ``role:text`` of every conversation, read as a sorted stream.

    A digest is sequential by definition, so a conversation passes through one task, row by row.
    """
    ddl = f"conv {lines.schema['conv'].dataType.simpleString()}, sha string"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shas():
            current, sha, begun = None, None, False
            for b in batches:
                for r in b.to_pylist():
                    if not begun or r["conv"] != current:
                        if begun:
                            yield {"conv": current, "sha": sha.hexdigest()}
                        current, sha, begun = r["conv"], sha256(), True
                    else:
                        sha.update(b"\n")
                    sha.update(f"{r['role']}:{r['text']}".encode())
            if begun:
                yield {"conv": current, "sha": sha.hexdigest()}
        yield from to_batches(shas(), schema)
    return lines.repartition("conv").sortWithinPartitions("conv", "pos", "sub").mapInArrow(stream, ddl)


def op11_rank_convergence_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages ``conversations`` by rule, repairs what is left, and reports every conversation's faults and repair."""
    turns = table(spark, sf_dir, "conversations")
    rows = damage(turns)
    convs, lines = repair(rows)
    span = rows.select("conv", "turn").distinct().groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    out = turns.select(F.struct(F.col("conv_id").alias("id")).alias("conv")).distinct() \
        .join(convs, "conv", "left").join(span, "conv", "left").join(digests(lines), "conv", "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
               for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv.id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha", F.lit(EMPTY_SHA)).alias("repaired_sha256"))


#: forward recurrence: per conversation, row and state the least (cost, audit), which carries the repaired lines along
OP11_SQL = rf"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {sql_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM t WHERE k <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d
), f AS MATERIALIZED (
  SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM o
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
), ins(s, k, s1, added) AS (VALUES
  (0, 0, 0, ''), (0, 1, 2, chr(10) || 'user:'), (0, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 0, 1, ''), (1, 1, 2, chr(10) || 'user:'), (1, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 0, 2, ''), (2, 1, 3, chr(10) || 'assistant:'), (3, 0, 3, ''), (3, 1, 2, chr(10) || 'user:')
), keep(s1, ini, s2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
other(s1, role, s2) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
edits AS MATERIALIZED (
  SELECT f.conv_id, f.i, s1.s1, 'D' AS op, 4 AS price, s1.s1 AS s2, '' AS line FROM f, (SELECT DISTINCT s1 FROM ins) s1
  UNION ALL
  SELECT f.conv_id, f.i, keep.s1, 'K', CASE WHEN fault = 't' THEN 3 ELSE 0 END, keep.s2, chr(10) || role || ':' || text
  FROM f JOIN keep ON keep.ini = f.ini WHERE fault IN ('', 't')
  UNION ALL
  SELECT f.conv_id, f.i, other.s1, 'R', CASE WHEN fault = 't' THEN 6 ELSE 3 END, other.s2, chr(10) || other.role || ':' || text
  FROM f, other WHERE fault IN ('', 't')
), dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, struct_pack(cost := 0, audit := '', lines := '') AS best FROM counts
  UNION ALL
  SELECT dp.conv_id, e.i, e.s2, min(struct_pack(cost := best.cost + 3 * ins.k + e.price,
    audit := best.audit || repeat('I', ins.k) || e.op, lines := best.lines || ins.added || e.line))
  FROM dp JOIN ins ON ins.s = dp.s JOIN edits e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.i = dp.i + 1 AND e.s1 = ins.s1
  GROUP BY dp.conv_id, e.i, e.s2
), ends AS (
  SELECT dp.conv_id, min(struct_pack(cost := best.cost + 3 * ins.k, audit := best.audit || repeat('I', ins.k), lines := best.lines || ins.added)) AS best
  FROM dp JOIN counts c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND c.n = dp.i JOIN ins ON ins.s = dp.s AND ins.s1 IN (0, 3)
  GROUP BY dp.conv_id
)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost,
  coalesce(e.best.audit, '') AS audit, sha256(coalesce(substr(e.best.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM q.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM q.conv_id
"""
