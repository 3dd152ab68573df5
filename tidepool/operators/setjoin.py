"""Candidates of the exact set-similarity join for large sets, and the packed form that sets are kept in.

A set is kept as bytes (:func:`packed`): the steps between its sorted bits, 1 to 3 bytes each, so it takes about a
third of its ``array<int>``.

Candidates come from *neighbours*: put the bits of all sets in one order (rarest first).  Where two sets are merged in
that order, ``I`` places hold a common bit and ``D`` a bit of one set only.  Of the ``I + D - 1`` pairs of places next to
each other a place of one set only spoils two at most, so the two sets have at least
``I + D - 1 - 2 D = 3 I - (|A| + |B|) - 1`` pairs of neighbouring bits in common.  With Jaccard similarity >= ``t`` > 1/2
and ``I >= t / (1 + t) (|A| + |B|)`` that is at least one once the sets are not tiny (:func:`least_size`), and the prefix
filter holds for pairs of neighbours as it does for single bits.  Two neighbours together are rare, however many sets
share each of the two bits by chance, so the candidates do not grow as the posting lists of single bits do.

The pairs of neighbours are dealt out in turns, by their hash, and the shuffle files of a turn are freed before the next:
the disk holds a part of them at a time.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.session import broadcast, cut_lineage, free_shuffles, release

ORDER_SLOTS = 1 << 20    # counters that put the bits in order, however many bits there are (4 MB to every executor)
COUNT_CHUNK = 1 << 14    # counters that are added up at once
PART_BITS = 1 << 20      # bits that a task puts in order at once
TURNS = 8                # turns that the pairs of neighbours are dealt out in, at most
TURN_BITS = 1 << 22      # bits of all sets that make a turn worth its while
COMMON = 4               # pairs of neighbours that a candidate has in common (all, if it need not have so many)
MEET_PAIRS = 1 << 21     # pairs of sets that a task holds before it passes them on
NO_BIT = 0xFFFFFFFF      # stands before a set's first bit


# ---------------------------------------------------------------------------------
# packed sets
# ---------------------------------------------------------------------------------

def packed_column(col: pa.Array) -> pa.Array:
    """Sets (``list<int32>``) as bytes: 0 and the steps between ascending bits in groups of 7 bits, or 1 and the bits."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lens)), lens)
    start = (np.cumsum(lens) - lens)[lens > 0]
    val = np.diff(flat, prepend=0)
    up = val > 0
    val[start], up[start] = flat[start], flat[start] >= 0
    plain = np.zeros(len(lens), dtype=bool)  # not ascending: the bits themselves, in their order
    plain[row[~up]] = True
    raw = plain[row]
    val[raw] = flat[raw] & 0xFFFFFFFF
    size = np.ones(len(val), dtype=np.int64)
    for j in range(1, 5):
        size += val >= 1 << 7 * j
    size[raw] = 4
    upto = np.concatenate([[0], np.cumsum(size)])
    at = upto[:-1] + row + 1  # a row's first byte says how it is kept
    ends = np.concatenate([[0], upto[np.cumsum(lens)] + np.arange(1, len(lens) + 1)])
    out = np.zeros(ends[-1], dtype=np.uint8)
    out[ends[:-1]] = plain
    for j in range(5):
        m = np.flatnonzero(size > j)
        if len(m):
            byte = np.where(raw[m], val[m] >> 8 * j & 255, val[m] >> 7 * j & 127 | (size[m] > j + 1) << 7)
            out[at[m] + j] = byte
    got = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])
    return pc.if_else(pc.is_valid(col), got, pa.scalar(None, pa.binary())) if col.null_count else got


def _steps(data: np.ndarray) -> np.ndarray:
    """Numbers kept in groups of 7 bits, the last group of each below 128."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size = ends - starts + 1
    val = (data[starts] & 127).astype(np.int64)
    for j in range(1, 5):
        m = np.flatnonzero(size > j)
        if not len(m):
            break
        val[m] |= (data[starts[m] + j] & 127).astype(np.int64) << 7 * j
    return val


def unpack(data: bytes) -> np.ndarray:
    """The bits of one packed set."""
    body = np.frombuffer(data, dtype=np.uint8)
    return np.frombuffer(data, dtype="<i4", offset=1).astype(np.int64) if body[0] else np.cumsum(_steps(body[1:]))


def unpacked_column(col: pa.Array, lens: np.ndarray) -> np.ndarray:
    """The bits of packed sets of ``lens`` bits (no nulls), one after another."""
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]] if len(col) else np.zeros(0, np.uint8)
    heads = offsets[:-1] - offsets[0] if len(col) else offsets[:0]
    if data[heads].any():  # some sets are kept as they are
        return np.concatenate([unpack(x) for x in col.to_pylist()])
    val = np.cumsum(_steps(np.delete(data, heads)))
    before = np.concatenate([[0], val])[np.cumsum(lens) - lens]
    return val - np.repeat(before, lens)


def packed(df: DataFrame) -> DataFrame:
    """``bits`` as bytes, with the number of bits ``len`` (that of Spark's ``size``)."""
    if dict(df.dtypes)["bits"] == "binary":
        return df
    sized = df.withColumn("len", F.size("bits"))
    i, k = sized.columns.index("bits"), sized.columns.index("len")

    def run(batches):
        for batch in batches:
            for b in parts(batch, k):
                yield pa.RecordBatch.from_arrays([packed_column(c) if j == i else c for j, c in enumerate(b.columns)], b.schema.names)

    schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'bits' else f.dataType.simpleString()}" for f in sized.schema.fields)
    return sized.mapInArrow(run, schema)


def unpacked(df: DataFrame) -> DataFrame:
    """``(key, bits array<int>, len)`` of packed sets."""
    kind = df.schema["key"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for part in parts(b):
                lens = _lens(part)
                ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
                bits = pa.ListArray.from_arrays(pa.array(ends), pa.array(unpacked_column(part.column(1), lens), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), bits, part.column(2)], ["key", "bits", "len"])

    return df.select("key", "bits", "len").mapInArrow(run, f"key {kind}, bits array<int>, len int")


def _lens(b: pa.RecordBatch, column: int = 2) -> np.ndarray:
    return pc.fill_null(b.column(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def parts(b: pa.RecordBatch, column: int = 2):
    """Slices of a batch with at most ``PART_BITS`` bits (numbers in ``column``), or one row."""
    upto = np.cumsum(np.maximum(_lens(b, column), 0))
    at = 0
    while at < b.num_rows:
        before = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, before + PART_BITS, "right")))
        yield b.slice(at, stop - at)
        at = stop


# ---------------------------------------------------------------------------------
# one order of the bits
# ---------------------------------------------------------------------------------

def bit_counts(sets: DataFrame) -> np.ndarray:
    """How often the bits of packed sets fall on each of ``ORDER_SLOTS`` counters (bits modulo that number).

    Few tasks count, each in counters of its own; these are added up chunk by chunk.
    """
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, sets.sparkSession.sparkContext.defaultParallelism)

    def count(batches):
        total = np.zeros(ORDER_SLOTS, dtype=np.int64)
        for b in batches:
            for part in parts(b):
                total += np.bincount(unpacked_column(part.column(1), _lens(part)) & ORDER_SLOTS - 1, minlength=ORDER_SLOTS)
        some = [i for i in range(0, ORDER_SLOTS, COUNT_CHUNK) if total[i:i + COUNT_CHUNK].any()]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([i // COUNT_CHUNK for i in some], pa.int32()),
                                              pa.array([_planes(total[i:i + COUNT_CHUNK]) for i in some], pa.binary())], ["c", "n"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[c] = total.get(c, 0) + _from_planes(x, np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                              pa.array([_planes(x) for x in total.values()], pa.binary())], ["c", "n"])

    got = sets.coalesce(tasks).mapInArrow(count, "c int, n binary").repartitionById(n, F.pmod("c", F.lit(n)).cast("int")) \
        .mapInArrow(add, "c int, n binary").toArrow()
    out = np.zeros(ORDER_SLOTS, dtype=np.int64)
    for c, x in zip(got["c"].to_pylist(), got["n"].to_pylist()):
        out[c * COUNT_CHUNK:(c + 1) * COUNT_CHUNK] = _from_planes(x, np.int64)
    return out


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second bytes, ...: what compresses well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(data, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T.copy().view(kind).reshape(-1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed hash of unsigned 64-bit numbers (splitmix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


# ---------------------------------------------------------------------------------
# candidates by neighbours
# ---------------------------------------------------------------------------------

def least_size(t: float) -> float:
    """Sets of this size at least have a pair of neighbours in common if their Jaccard similarity is >= ``t``."""
    gain = 3 * t / (1 + t) - 1
    return math.ceil(1 / gain - 1e-9) if gain > 1e-6 else math.inf


def _need(t: float, both: np.ndarray) -> np.ndarray:
    """Pairs of neighbours that similar sets with ``both`` bits together have in common at least."""
    return 3 * np.ceil(t / (1 + t) * both - 1e-9).astype(np.int64) - both - 1


def ordered(b: pa.RecordBatch, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, code)`` of the distinct bits of packed sets, each set's in the one order of all bits.

    A code is the rank of the bit's slot and the bits above the slot: one for each bit.
    """
    lens = _lens(b)
    bits = unpacked_column(b.column(1), lens)
    both = np.repeat(np.arange(len(lens)) << 32, lens)
    both |= rank[bits & ORDER_SLOTS - 1].astype(np.int64) << 12
    both |= (bits >> 20) + 2048
    both.sort()
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return both >> 32, both.astype(np.uint32)


def _dealt(b: pa.RecordBatch, rank: np.ndarray, t: float, turn: int, turns: int, n: int) -> pa.RecordBatch:
    """Pairs of neighbours in the sets' prefixes, of one turn, in a row ``(p, keys, body)`` for each of ``n`` tasks.

    ``body``: sizes of the sets and numbers of their pairs; then of each pair its hash, the bit before it, and 16 bits:
    whether the set may be the shorter one here, and 5 of the hash of each of the three bits after it.
    """
    row, code = ordered(b, rank)
    size = np.bincount(row, minlength=b.num_rows)
    at = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    # prefixes: as the shorter set (others have as many bits at least), and as the longer one (others have t times as many at least)
    least = np.ceil(t * size - 1e-9).astype(np.int64)
    upto_short = size - 1 - np.maximum(_need(t, 2 * size), 1) + COMMON
    upto_long = size - 1 - np.maximum(_need(t, size + least), 1) + COMMON
    upto = np.minimum(size - 1, np.maximum(upto_short, upto_long))
    i = np.flatnonzero(at < upto[row])
    wide = np.concatenate([code, np.zeros(4, np.uint32)])
    h = _mixed(wide[i].astype(np.uint64) << np.uint64(32) | wide[i + 1])
    where = (h >> np.uint64(32)).astype(np.uint32)
    mine = np.flatnonzero(where % np.uint32(turns) == turn)
    i, h = i[mine], h[mine]
    p = (where[mine] // np.uint32(turns) % np.uint32(n)).astype(np.int64)
    o = np.argsort(p, kind="stable")
    i, h, p = i[o], h[o], p[o]
    r = row[i]
    before = np.where(at[i] > 0, code[i - 1], np.uint32(NO_BIT)).astype(np.uint32)
    marks = (at[i] < upto_short[r]).astype(np.uint16)
    small = (wide * np.uint32(0x9E3779B1) >> np.uint32(27)).astype(np.uint16)
    for j in (2, 3, 4):
        marks |= small[i + j] << np.uint16(5 * j - 9)
    heads = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (r[1:] != r[:-1])])) if len(p) else np.zeros(0, np.int64)
    number = np.diff(np.append(heads, len(p))).astype(np.uint32)
    sets, sizes = r[heads], size[r[heads]].astype(np.uint32)
    first = np.flatnonzero(np.concatenate([[True], np.diff(p[heads]) > 0])) if len(heads) else heads
    ends = np.append(first[1:], len(heads))
    hb = h.view(np.uint8).reshape(-1, 8)
    bodies = []
    for x, y in zip(first, ends):
        u, v = heads[x], heads[y] if y < len(heads) else len(p)
        bodies.append(b"".join((_planes(sizes[x:y]), _planes(number[x:y]), hb[u:v, :6].tobytes(), _planes(before[u:v]), _planes(marks[u:v]))))
    keys = pa.ListArray.from_arrays(pa.array(np.append(first, len(heads)), pa.int32()), b.column(0).take(pa.array(sets)))
    return pa.RecordBatch.from_arrays([pa.array(p[heads[first]], pa.int32()), keys, pa.array(bodies, pa.binary())], ["p", "keys", "body"])


def _meeting(batches, t: float):
    """Rows ``(keys, body)`` with the pairs of sets that have pairs of neighbours in common (see :func:`_passed_on`)."""
    keys, columns = [], []
    for b in batches:
        for some, body in zip(b.column(1), b.column(2).to_pylist()):
            k, m = len(some), (len(body) - 8 * len(some)) // 12
            cuts = np.cumsum([4 * k, 4 * k, 6 * m, 4 * m])
            sizes, number, h, before, marks = (body[x:y] for x, y in zip([0, *cuts], [*cuts, len(body)]))
            h8 = np.zeros((m, 8), np.uint8)
            h8[:, :6] = np.frombuffer(h, np.uint8).reshape(m, 6)
            number = _from_planes(number, np.uint32)
            keys.append(some.values)
            columns.append((number, np.repeat(_from_planes(sizes, np.uint32), number), h8.view(np.uint64).reshape(-1),
                            _from_planes(before, np.uint32), _from_planes(marks, np.uint16)))
    if not keys:
        return
    number, size, h, before, marks = (np.concatenate(x) for x in zip(*columns))
    del columns
    all_keys = pa.chunked_array(keys).combine_chunks().dictionary_encode()
    order = pc.sort_indices(all_keys.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    names = all_keys.dictionary.take(pa.array(order))
    o = np.argsort(h)
    h = h[o]
    run = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]]))
    shared = np.bincount(run)[run] > 1
    o, run = o[shared], run[shared]
    who = place[all_keys.indices.to_numpy()].repeat(number)[o]
    size, before, marks = size[o].astype(np.int64), before[o], marks[o]
    held, d = [], 0
    while d < len(run):
        d += 1
        x = np.flatnonzero(run[d:] == run[:-d])
        if not len(x):
            break
        for at in range(0, len(x), MEET_PAIRS):
            e = x[at:at + MEET_PAIRS]
            held.append(_met(e, e + d, who, size, before, marks, t))
            if sum(len(a) for a, _, _ in held) > MEET_PAIRS:
                yield _passed_on(held, names)
                held = []
    if sum(len(a) for a, _, _ in held):
        yield _passed_on(held, names)


def _met(e, f, who, size, before, marks, t):
    """``(a, b, w)`` of the rows ``e`` and ``f`` that begin a run of common neighbours of sets that may be similar.

    A pair that goes on with the bit before it in both sets is not the first of its run; that one is in both prefixes too.
    """
    le, lf = size[e], size[f]
    short_e, short_f = (marks[e] & 1).astype(bool), (marks[f] & 1).astype(bool)
    ok = np.where(le < lf, short_e, np.where(le > lf, short_f, short_e & short_f & (who[e] != who[f])))
    ok &= np.minimum(le, lf) >= t * np.maximum(le, lf) - 1e-9
    ok &= (before[e] != before[f]) | (before[e] == NO_BIT)
    e, f = e[ok], f[ok]
    other = marks[e] ^ marks[f]
    one = other >> 1 & 31 == 0
    two = one & (other >> 6 & 31 == 0)
    w = 1 + one + two + (two & (other >> 11 & 31 == 0))  # pairs of the run, up to COMMON, or some more
    w = w + COMMON - np.clip(_need(t, size[e] + size[f]), 1, COMMON)  # sets that need fewer reach COMMON as well
    return np.minimum(who[e], who[f]), np.maximum(who[e], who[f]), np.minimum(w, COMMON)


def _passed_on(held, names: pa.Array) -> pa.RecordBatch:
    """One row: the keys, and of each pair of sets the places of its keys and the pairs of neighbours (up to ``COMMON``)."""
    a, b, w = (np.concatenate(x) for x in zip(*held))
    pair, at = np.unique(a * len(names) + b, return_inverse=True)
    w = np.minimum(np.bincount(at, weights=w), COMMON).astype(np.uint8)
    a, b = pair // len(names), pair % len(names)
    used = np.unique(np.concatenate([a, b]))
    a, b = np.searchsorted(used, a), np.searchsorted(used, b)
    body = zlib.compress(_planes(np.diff(a, prepend=0).astype(np.int32)) + _planes(b.astype(np.int32)) + w.tobytes(), 1)
    keys = pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), names.take(pa.array(used)))
    return pa.RecordBatch.from_arrays([keys, pa.array([body], pa.binary())], ["keys", "body"])


def _spread(batches):
    """Rows ``(a, b, w)`` of what :func:`_passed_on` made."""
    for batch in batches:
        for keys, body in zip(batch.column(0), batch.column(1).to_pylist()):
            x = zlib.decompress(body)
            m = len(x) // 9
            a = np.cumsum(_from_planes(x[:4 * m], np.int32))
            for at in range(0, m, 1 << 16):
                s = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([
                    keys.values.take(pa.array(a[s])), keys.values.take(pa.array(_from_planes(x[4 * m:8 * m], np.int32)[s])),
                    pa.array(np.frombuffer(x, np.uint8, offset=8 * m)[s].astype(np.int32))], ["a", "b", "w"])


def neighbour_candidates(sets: DataFrame, t: float) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of all packed sets ``(key, bits, len)`` of :func:`least_size` and Jaccard similarity >= ``t``, and some more."""
    spark = sets.sparkSession
    counts = bit_counts(sets)
    ranks = np.empty(ORDER_SLOTS, dtype=np.int64)
    ranks[np.lexsort((np.arange(ORDER_SLOTS), counts))] = np.arange(ORDER_SLOTS)
    rank = broadcast(spark, ranks.astype(np.int32))
    turns = int(min(TURNS, 1 + counts.sum() // TURN_BITS))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = sets.schema["key"].dataType.simpleString()

    def dealer(turn: int):
        def run(batches):
            for b in batches:
                for part in parts(b):
                    yield _dealt(part, rank.value, t, turn, turns, n)
        return run

    found = []
    for turn in range(turns):
        met = sets.mapInArrow(dealer(turn), f"p int, keys array<{kind}>, body binary").repartitionById(n, F.col("p")) \
            .mapInArrow(lambda batches: _meeting(batches, t), f"keys array<{kind}>, body binary")
        found.append(cut_lineage(met))
        del met
        free_shuffles(spark)
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    cand = cut_lineage(rows.mapInArrow(_spread, f"a {kind}, b {kind}, w int").groupBy("a", "b").agg(F.sum("w").alias("w"))
                       .where(F.col("w") >= COMMON).select("a", "b"))
    release(*found)
    del rows
    free_shuffles(spark)
    return cand
