"""Held-out word n-gram perplexity: modified Kneser-Ney over all documents, nothing broadcast.

* A word is what stands between ASCII white space, as it is written; it is known by a full 64-bit
  hash salted with its language, so languages have separate models.  ``order - 1`` start symbols
  stand before a text and one end symbol after it.
* Every order has continuation counts: an n-gram counts the different words that stand before it
  in the corpus (a word of the order above).  Copies of a text, near copies and a text that
  repeats itself so teach the model no more than once.
* Every n-gram is scored with one of these taken away (leaving-one-out), from its own count, from its
  context and, where it goes with it, from the orders below: a text is not predicted from itself
  or from its copies.  What is left does not depend on the document, so each n-gram has one
  probability and a document's score is a sum of look-ups.
* Order 3, which the queries use: the 4-grams of the texts are dealt to buckets by their third word, in
  turns, as chunks of a block's words and their places (``_partial_sums``).  No row per n-gram is shuffled or kept,
  and words are compared by the 63 bits of their hashes, n-grams by their words.  4-grams of a frequent third word are
  dealt by their second word too; all of one pair are met in one task.
* Other orders: a row per n-gram, probabilities by joins (``left_out``); the n-grams' 64-bit hashes are dealt
  to buckets whose number follows the counted n-grams; each task holds one bucket's sorted hash array at a time,
  streams the documents' hashes of that bucket past it, and gives one partial sum per document and block.

Log perplexity is the mean over a document's distinct n-grams that predict a word.  Marks between spaces
and the end symbol are counted by the model but are no words here; a text without words has
no log perplexity (NULL).  Equal texts of a language have equal scores and are known by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import discard, freed_shuffles, materialize, text_of

ORDER = 3
BUCKET_GRAMS = 1_200_000
BLOCK_BYTES = 16 << 20
PIECE_BYTES = 2 << 20
TURNS = 20
WORD_TURNS = 4
SUM_BITS = 12
TURN_BYTES = 16 << 20
BLOCK_WORDS = 400_000
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_BOS, _EOS = 0x5BD1E9955BD1E995, 0x1B873593CC9E2D51
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _salt(lang: str | None) -> int:
    return xxhash.xxh64_intdigest(b"\x00" if lang is None else b"\x01" + lang.encode("utf-8", "surrogatepass"), 11)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of n-grams given as one array of word hashes per place."""
    h = _mix(words[0])
    for w in words[1:]:
        h = _mix((h * _M3) ^ w)
    return h


def events(texts: list[str], langs: list[str | None], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes by place, n-gram hashes, document index, whether a word is predicted) of the distinct n-grams of every text."""
    hashed, said, digest = [], [], xxhash.xxh64_intdigest
    for t, lang in zip(texts, langs):
        words = t.encode("utf-8", "surrogatepass").split()
        own = [_BOS] * (order - 1) + [digest(w) for w in words] + [_EOS]
        hashed.append(np.array(own, dtype=np.uint64) ^ np.uint64(_salt(lang)))
        said.append(np.array([bool(w.strip(MARKS)) for w in words] + [False], dtype=bool))
    places = [np.concatenate([h[j:len(h) - order + 1 + j] for h in hashed]) for j in range(order)]
    doc = np.repeat(np.arange(len(texts), dtype=np.uint32), [len(x) for x in said])
    g = gram_hash(places)
    at = np.lexsort((g, doc))
    first = np.ones(len(at), dtype=bool)
    first[1:] = (g[at][1:] != g[at][:-1]) | (doc[at][1:] != doc[at][:-1])
    at = at[first]
    return [p[at] for p in places], g[at], doc[at], np.concatenate(said)[at]


def _blocks(batches: Iterator[pa.RecordBatch], chars: int = 6 * BLOCK_WORDS) -> Iterator[tuple[list, list, list, list]]:
    """Runs of rows (text, lang, k1, k2) of about ``chars`` characters."""
    held, size = [], 0
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns]):
            held.append(row)
            size += len(row[0])
            if size >= chars:
                yield tuple(map(list, zip(*held)))
                held, size = [], 0
    if held:
        yield tuple(map(list, zip(*held)))


def _distinct(order: int, flush: int = 1_000_000):
    """Task function: rows (text, lang, k1, k2) to n-grams (lang, w0..), each once a flush."""
    names = ["lang", *[f"w{j}" for j in range(order)]]

    def out(held: list) -> pa.RecordBatch:
        g, lang = (np.concatenate([x[i] for x in held]) for i in range(2))
        first = np.unique(g, return_index=True)[1]
        words = [np.concatenate([x[2][j] for x in held])[first] for j in range(order)]
        return pa.RecordBatch.from_arrays([pa.array(lang[first], pa.string()), *[pa.array(w.view(np.int64)) for w in words]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for texts, langs, _, _ in _blocks(batches):
            words, g, doc, _ = events(texts, langs, order)
            u, first = np.unique(g, return_index=True)
            held.append((u, np.array(langs, dtype=object)[doc[first]], [w[first] for w in words]))
            size += len(u)
            if size > flush:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)
    return run


def _discounts(counts: DataFrame) -> DataFrame:
    from tidepool.llm.quality import _discounts as of
    return of(counts).withColumnRenamed("lang", "_l")


def _cut(a: Column) -> Column:
    """Discount of a count."""
    d = F.when(a <= 0, 0.0).when(a == 1, F.col("d1")).when(a == 2, F.col("d2")).otherwise(F.col("d3"))
    return F.least(d, a)


def _on(left: str, right: str, keys: list[str]) -> Column:
    on = F.col(f"{left}.lang").eqNullSafe(F.col(f"{right}.lang"))
    for k in keys:
        on = on & (F.col(f"{left}.{k}") == F.col(f"{right}.{k}"))
    return on


def left_out(top: DataFrame, order: int) -> DataFrame:
    """(lang, w1.., q): the probability of every n-gram with one of its events left out.

    ``top`` has the distinct n-grams of ``order + 1`` words, (lang, w0..).
    """
    words = [f"w{j}" for j in range(order + 1)]
    counts = {order + 1: top}
    for k in range(order, 0, -1):
        counts[k] = materialize(counts[k + 1].groupBy("lang", *words[order + 1 - k:]).agg(F.count(F.lit(1)).alias("a")), f"word-a{k}")
    below = None
    for k in range(1, order + 1):
        own = words[order + 1 - k:]
        context, suffix = own[:-1], own[1:]
        d = F.broadcast(_discounts(counts[k]))  # a row per language
        a = F.col("a").cast("double")
        rows = counts[k].join(d, F.col("lang").eqNullSafe(F.col("_l"))) \
            .select("lang", *own, a.alias("a"), _cut(a).alias("cut"), _cut(a - 1).alias("cut1"))
        sums = rows.groupBy("lang", *context).agg(F.sum("a").alias("t"), F.sum("cut").alias("m"), F.count(F.lit(1)).alias("kinds"))
        j = rows.alias("r").join(sums.alias("s"), _on("r", "s", context)) \
            .select("r.lang", *[f"r.{w}" for w in own], "a", "cut", "cut1", "t", "m", "kinds")
        if k == 1:
            j = j.withColumn("p_", 1 / (F.col("kinds") + 1)).withColumn("q_", F.col("p_"))
        else:
            j = j.alias("r").join(below.alias("b"), _on("r", "b", suffix)) \
                .select("r.*", F.col("b.p").alias("p_"), F.col("b.q").alias("q_"))
        # an n-gram of one event goes with it: what it continued has one kind less
        lower = F.when(F.col("a") > 1, F.col("p_")).otherwise(F.col("q_"))
        q = F.when(F.col("t") <= 1, lower).otherwise(
            (F.greatest(F.col("a") - 1 - F.col("cut1"), F.lit(0.0)) + (F.col("m") - F.col("cut") + F.col("cut1")) * lower) / (F.col("t") - 1))
        p = (F.col("a") - F.col("cut") + F.col("m") * F.col("p_")) / F.col("t")
        below = j.select("lang", *own, p.alias("p"), q.alias("q"))
        below = materialize(below.select("lang", *own, "q") if k == order else below, f"word-p{k}")
    return below


# ------------------------------------------------- order 3, without rows of n-grams

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_SAYS = ~_SPACE
_SAYS[list(MARKS)] = False
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
_LOW = np.uint64(1)


def word_hashes(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the words of the texts ``raw[edges[i]:edges[i + 1]]`` (UTF-8).

    The lowest bit of a hash says whether the word is more than marks.
    """
    ink = ~_SPACE[raw]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    for marked, at in ((first, edges[:-1][edges[:-1] < len(raw)]), (last, edges[1:][edges[1:] > 0] - 1)):
        marked[at] = ink[at]
    at, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(at):
        return at, at.astype(np.uint64)
    n = end - at
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = _mix(n.astype(np.uint64) + _M3)
    for i in np.flatnonzero(n > 64):
        h[i] = xxhash.xxh64_intdigest(raw[at[i]:end[i]].tobytes())
    left, k = np.flatnonzero(n <= 64), 0
    while len(left):
        rest = n[left] - 8 * k
        h[left] = _mix((h[left] * _M3) ^ (eight[at[left] + 8 * k] & _MASKS[np.minimum(rest, 8)]))
        left, k = left[rest > 8], k + 1
    says = np.logical_or.reduceat(_SAYS[raw], at)
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(np.searchsorted(at, edges)))
    return doc, (h & ~_LOW) | says.astype(np.uint64)


def _text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list, np.ndarray]]:
    """(bytes, edges, languages, keys) of runs of rows (text, lang, k1, k2) of about ``PIECE_BYTES`` bytes."""
    for b in batches:
        text = b.column(0).cast(pa.large_string())
        edges = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
        raw = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
        langs = b.column(1).to_pylist()
        keys = np.array([b.column(2).to_numpy(), b.column(3).to_numpy()], dtype=np.int64).T
        at = 0
        while at < len(langs):
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + PIECE_BYTES, side="right")) - 1)
            yield raw[edges[at]:edges[to]], edges[at:to + 1] - edges[at], langs[at:to], keys[at:to]
            at = to


_WORDS = ("first long, size long, langs array<string>, lang binary, sizes binary, words binary, ids binary, keys binary, "
          "often binary, counts binary")
_WORD_TYPES = pa.schema([("first", pa.int64()), ("size", pa.int64()), ("langs", pa.list_(pa.string())),
                         *[(c, pa.binary()) for c in ("lang", "sizes", "words", "ids", "keys", "often", "counts")]])
#: a file's rows are read in groups, so few of them may make one
_LARGE_ROWS = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
_EDGE = np.array([_BOS & ~1, _BOS & ~1, _BOS & ~1, _EOS & ~1], dtype=np.uint64)


def _salts(langs: list) -> np.ndarray:
    return np.array([_salt(x) & ~1 for x in langs], dtype=np.uint64)


def _width(top: int) -> int:
    return max(1, (top.bit_length() + 7) // 8)


def _word_block(held: list, first: int) -> pa.RecordBatch:
    """One row of ``_word_blocks`` from its pieces."""
    langs = list(dict.fromkeys(x for piece in held for x in piece[3]))
    code = {x: i for i, x in enumerate(langs)}
    lang = np.array([code[x] for piece in held for x in piece[3]])
    u, to = np.unique(np.concatenate([piece[0] for piece in held]), return_inverse=True)
    starts = np.cumsum([0, *[len(piece[0]) for piece in held]])
    ids = np.concatenate([to[s + piece[1]] for piece, s in zip(held, starts)])
    number = np.bincount(ids, minlength=len(u))
    by = np.argsort(-number, kind="stable")
    rank = np.empty(len(u), dtype=np.uint32)
    rank[by] = np.arange(len(u)) + 4 * len(langs)
    n = np.concatenate([piece[2] for piece in held])
    off = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n + 4, out=off[1:])
    seq = np.empty(off[-1], dtype="<u4")
    seq[np.arange(len(ids)) + 4 * np.repeat(np.arange(len(n)), n) + 3] = rank[ids]
    for j, at in enumerate((off[:-1], off[:-1] + 1, off[:-1] + 2, off[1:] - 1)):
        seq[at] = 4 * lang + j
    # byte by byte, which packs better
    planes = np.ascontiguousarray(seq.view(np.uint8).reshape(-1, 4)[:, :_width(len(u) + 4 * len(langs) - 1)].T)
    keys = np.concatenate([piece[4] for piece in held])
    often = by[:np.searchsorted(-number[by], -max(2, len(ids) // 20_000), side="right")]
    row = (first, int(off[-1]), langs, _small(lang), _small(n), u[by].tobytes(), pa.compress(planes, codec="zstd", asbytes=True),
           keys.tobytes(), u[often].tobytes(), number[often].astype(np.int64).tobytes())
    return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, _WORD_TYPES)], schema=_WORD_TYPES)


def _word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: rows (text, lang, k1, k2) to rows of about ``BLOCK_BYTES`` of text as places in a list of words.

    Documents are numbered from ``first``.  Each has three start symbols, its words and an end symbol, of its language; the symbols
    come first in the list, then the words by frequency.
    """
    task = TaskContext.get()
    first, held, size = (task.partitionId() if task else 0) << 40, [], 0
    for raw, edges, langs, keys in _text_blocks(batches):
        kinds = list(dict.fromkeys(langs))
        code = {x: i for i, x in enumerate(kinds)}
        doc, h = word_hashes(raw, edges)
        h ^= _salts(kinds)[np.array([code[x] for x in langs])][doc]
        u, at = np.unique(h, return_inverse=True)
        held.append((u, at.astype(np.uint32), np.bincount(doc, minlength=len(langs)), langs, keys))
        size += len(raw) + 64 * len(langs)
        if size >= BLOCK_BYTES:
            yield _word_block(held, first)
            first, held, size = first + sum(len(piece[3]) for piece in held), [], 0
    if held:
        yield _word_block(held, first)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        blocks = [batch] if "ids" in batch.schema.names else _word_blocks(iter([batch]))
        for block in blocks:
            for i in range(len(block)):
                yield {c: block.column(c)[i].as_buffer() if c in ("words", "ids", "keys") else block.column(c)[i].as_py()
                       for c in block.schema.names}


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: the frequent words of blocks and their counts."""
    for batch in batches:
        for words, counts in zip(*[batch.column(c).to_pylist() for c in ("often", "counts")]):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, dtype=np.int64)) for x in (words, counts)], ["word", "n"])


def _dealt(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    if n <= 65536:
        bucket = bucket.astype(np.uint16)  # sorted by its digits
    at = np.argsort(bucket, kind="stable")
    edges = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.bincount(bucket, minlength=n), out=edges[1:])
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), at[edges[b]:edges[b + 1]]


def _bucket(g: np.ndarray, n: int) -> np.ndarray:
    return ((g >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _small(x: np.ndarray) -> bytes:
    """Unsigned numbers, 1, 2 or 4 bytes each."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32).tobytes()


def _wide(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, dtype=f"u{len(x) // n if n else 1}").astype(np.int64)


def _packed(words: np.ndarray) -> bytes:
    """64-bit numbers byte by byte: of sorted ones the first bytes pack well."""
    return pa.compress(np.ascontiguousarray(words.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def _unpacked(x: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(x, 8 * n, codec="zstd"), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


_CHUNK = ("bucket int, kind int, `to` int, lang string, words binary, w int, n int, m int, grams binary, events binary, docs binary, first long, "
          "keys binary, second long")


def _rows(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.replace("`", "").split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [f for f, _ in fields])


class _Often:
    """Words of which a bucket would be too large: their 4-grams go to ``parts`` buckets, by the second word."""

    def __init__(self, words: np.ndarray | None = None, parts: np.ndarray | None = None):
        self.words = np.zeros(0, dtype=np.uint64) if words is None else words
        self.parts = np.zeros(0, dtype=np.int64) if parts is None else parts

    def of(self, words: np.ndarray) -> np.ndarray:
        """Parts of words, 0 for the others."""
        out = np.zeros(len(words), dtype=np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = self.words[at] == words
            out[hit] = self.parts[at[hit]]
        return out


def _chunks(n: int, turn: int, turns: int, with_docs: bool, often: _Often | None = None):
    """Task function: rows of ``_word_blocks``, or (text, lang, k1, k2), to the 4-grams of this turn, by bucket and language.

    A chunk has its distinct 4-grams and, ``with_docs``, the place of each document's (``events``) in them.
    """
    often = often or _Often()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _word_rows(batches):
            kinds, size = x["langs"], x["size"]
            words = np.concatenate([(_salts(kinds)[:, None] ^ _EDGE).ravel(), np.frombuffer(x["words"], dtype=np.uint64)])
            bucket, parts = _bucket(words, n * turns), often.of(words)
            mine = (bucket % turns == turn) | (parts > 0)
            edge = np.arange(4 * len(kinds)).reshape(-1, 4)
            mine[edge[:, [0, 1, 3]]] = False
            width = _width(len(words) - 1)
            planes = np.frombuffer(pa.decompress(x["ids"], size * width, codec="zstd"), dtype=np.uint8).reshape(width, size)
            seq = planes[-1].astype(np.int32)
            for plane in planes[-2::-1]:
                seq <<= 8
                seq |= plane
            third = np.flatnonzero(mine[seq])
            b = bucket[seq[third]]
            if len(often.words):
                p = parts[seq[third]]
                at = np.flatnonzero(p)
                before = (_mix(words) >> np.uint64(33)).astype(np.int64)[seq[third[at] - 1]]
                b[at] = (b[at] + before % p[at]) % (n * turns)
                at = np.flatnonzero(b % turns == turn)
                third, b = third[at], b[at]
            n_docs = x["keys"].size // 16
            off = np.zeros(n_docs + 1, dtype=np.int64)
            np.cumsum(_wide(x["sizes"], n_docs) + 4, out=off[1:])
            doc = np.searchsorted(off, third, side="right") - 1
            group = b // turns * len(kinds) + _wide(x["lang"], n_docs)[doc]
            places = np.array([seq[third + j] for j in (-2, -1, 0, 1)])
            table, rows = np.empty(len(words), dtype=np.int64), []
            for to, at in _dealt(group, n * len(kinds)):
                own = places[:, at].ravel()
                order = np.arange(len(own))
                table[own] = order
                u = own[table[own] == order]
                u = u[np.argsort(words[u])]
                table[u] = order[:len(u)]
                grams = table[own].reshape(4, -1)
                events, u4 = _distinct_grams(grams, len(u))
                d = doc[at]
                new = np.ones(len(d), dtype=bool)
                new[1:] = d[1:] != d[:-1]
                rows.append((to // len(kinds) * turns + turn, 1, 0, kinds[to % len(kinds)], _packed(words[u]), len(u), len(at), u4.shape[1],
                             _small(u4), _small(events) if with_docs else b"", _small(np.cumsum(new) - 1) if with_docs else b"",
                             x["first"], d[new].astype(np.uint32).tobytes() if with_docs else b"", None))
            if rows:
                yield _rows(rows, _CHUNK)
    return run


def _distinct_grams(grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of each 4-gram among the distinct ones, the distinct ones by place of their words)."""
    bits = max(1, int(n - 1).bit_length())
    if 4 * bits < 64:
        code, u = pd.factorize(grams[0] << 3 * bits | grams[1] << 2 * bits | grams[2] << bits | grams[3])
        low = (1 << bits) - 1
        return code, np.array([u >> j * bits & low for j in (3, 2, 1, 0)])
    left, pairs = pd.factorize(grams[0] << 32 | grams[1])
    right, ends = pd.factorize(grams[2] << 32 | grams[3])
    code, u = pd.factorize(left << 32 | right)
    low = (1 << 32) - 1
    pairs, ends = pairs[u >> 32], ends[u & low]
    return code, np.array([pairs >> 32, pairs & low, ends >> 32, ends & low])


class _Group:
    """The 4-grams of a bucket: its n-grams and their counts, by place of their words in ``words``."""

    def __init__(self, chunks: list[dict], often: _Often):
        self.langs = list(dict.fromkeys(c["lang"] for c in chunks))
        own = [_unpacked(c["words"], c["w"]) for c in chunks]
        to, self.words = pd.factorize(np.concatenate(own))
        starts = np.cumsum([0, *map(len, own)])
        self.lang = np.zeros(len(self.words), dtype=np.int64)
        for c, s, u in zip(chunks, starts, own):
            self.lang[to[s:s + len(u)]] = self.langs.index(c["lang"])
        self.often = often.of(self.words) > 0
        at = [to[s + _wide(c["grams"], 4 * c["m"]).reshape(4, -1)] for c, s in zip(chunks, starts)]
        w0, w1, w2, w3 = np.concatenate(at, axis=1)
        del at, to, own
        low = (1 << 32) - 1
        c, context = pd.factorize(w1 << 32 | w2)
        del w1, w2
        self.tri, tri = pd.factorize(c << 32 | w3)
        self.says = (self.words[w3] & _LOW).astype(bool)
        self.a3 = np.bincount(pd.unique(self.tri << 32 | w0) >> 32, minlength=len(tri))
        del c, w0, w3
        self.context3, self.second3 = tri >> 32, (context & low)[tri >> 32]
        self.bi3, bi = pd.factorize(self.second3 << 32 | tri & low)
        self.a2 = np.bincount(self.bi3, minlength=len(bi))
        self.context2 = bi >> 32
        self.uni2, self.last = pd.factorize(bi & low)
        # the bigrams of a word in several buckets are counted where all of them meet
        self.a1 = np.bincount(self.uni2, weights=~self.often[self.context2], minlength=len(self.last)).astype(np.int64)

    def dealt_words(self, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(bucket of the word, language, places in ``last``), always in the same order."""
        order = np.argsort(self.words[self.last])
        last = self.last[order]
        for b, at in _dealt(_bucket(self.words[last], n) * len(self.langs) + self.lang[last], n * len(self.langs)):
            yield b // len(self.langs), b % len(self.langs), order[at]

    def dealt_often(self, n: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(bucket of the last word, place of the first, places of bigrams) of the words in several buckets, always in the same order."""
        at = np.flatnonzero(self.often[self.context2])
        if len(at):
            last = self.words[self.last[self.uni2[at]]]
            at = at[np.lexsort((last, self.words[self.context2[at]]))]
            cut = np.flatnonzero(np.diff(self.context2[at])) + 1
            for places in np.split(at, cut):
                for b, own in _dealt(_bucket(self.words[self.last[self.uni2[places]]], n), n):
                    yield b, int(self.context2[places[0]]), places[own]


def _by_bucket(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows sorted by ``key``, a list for each of its values."""
    held: list[dict] = []
    for batch in batches:
        for i in range(len(batch)):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if held and held[0][key] != row[key]:
                yield held[0][key], held
                held = []
            held.append(row)
    if held:
        yield held[0][key], held


_COUNTED = ("bucket int, `to` int, lang string, words binary, n int, vals binary, k int, n1 long, n2 long, n3 long, n4 long, more long, "
            "t long, second long")


def _stats(k: int, lang: str | None, a: np.ndarray, second: int | None = None) -> tuple:
    n = np.bincount(np.minimum(a, 5), minlength=6)
    return (-1, -1, lang, None, 0, None, k, *map(int, n[1:]), int(a.sum()), second)


def _count(n: int, often: _Often | None = None):
    """Task function: chunks to the counts of counts of orders 3 and 2, and the words that end them by bucket of the word.

    A word of several buckets has ``second`` rows, the last words of its bigrams with this bucket's share of their counts.
    """
    often = often or _Often()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, chunks in _by_bucket(batches, "bucket"):
            g = _Group(chunks, often)
            rows, whole = [], ~g.often[g.context2]
            for i, lang in enumerate(g.langs):
                rows += [_stats(3, lang, g.a3[g.lang[g.second3] == i]), _stats(2, lang, g.a2[whole & (g.lang[g.context2] == i)])]
            rest = (0,) * 7
            for to, i, at in g.dealt_words(n):
                rows.append((bucket, to, g.langs[i], _packed(g.words[g.last[at]]), len(at), _small(g.a1[at]), *rest, None))
            for to, second, at in g.dealt_often(n):
                rows.append((bucket, to, g.langs[g.lang[second]], _packed(g.words[g.last[g.uni2[at]]]), len(at), _small(g.a2[at]), *rest,
                             int(g.words[second].astype(np.int64))))
            yield _rows(rows, _COUNTED)
    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: the words of a bucket to the counts of counts of order 1 and, for each asking bucket, its words' counts.

    The bigrams of the words of several buckets are counted here as well, whole.
    """
    for to, rows in _by_bucket(batches, "to"):
        own = [_unpacked(r["words"], r["n"]) for r in rows]
        at, u = pd.factorize(np.concatenate(own))
        starts = np.cumsum([0, *map(len, own)])
        vals = np.concatenate([_wide(r["vals"], r["n"]) for r in rows])
        seconds = {x: i for i, x in enumerate(dict.fromkeys(r["second"] for r in rows if r["second"] is not None))}
        second = np.repeat([seconds.get(r["second"], -1) for r in rows], np.diff(starts))
        split, answer = np.flatnonzero(second >= 0), np.zeros(len(at), dtype=np.int64)
        bi3, bi = pd.factorize(second[split] << 32 | at[split])
        a2 = np.bincount(bi3, weights=vals[split], minlength=len(bi)).astype(np.int64)
        plain = second < 0
        a = np.bincount(at[plain], weights=vals[plain], minlength=len(u)).astype(np.int64) \
            + np.bincount(bi & ((1 << 32) - 1), minlength=len(u))
        answer[plain], answer[split] = a[at[plain]], a2[bi3]
        langs = list(dict.fromkeys(r["lang"] for r in rows))
        lang, lang_of = np.zeros(len(u), dtype=np.int64), {}
        for r, s, w in zip(rows, starts, own):
            lang[at[s:s + len(w)]] = langs.index(r["lang"])
            lang_of[r["second"]] = r["lang"]
        out = [_stats(1, x, a[lang == i]) for i, x in enumerate(langs)]
        for i, x in _dealt(bi >> 32, len(seconds)):
            out.append(_stats(2, lang_of[list(seconds)[i]], a2[x], list(seconds)[i]))
        out += [(r["bucket"], to, r["lang"], None, r["n"], _small(answer[s:s + len(w)]), *(0,) * 7, r["second"]) for r, s, w in zip(rows, starts, own)]
        yield _rows(out, _COUNTED)


def _cuts(a: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounts of counts; ``d`` has d1, d2, d3 of each count's language."""
    return np.where(a <= 0, 0.0, np.minimum(np.where(a == 1, d[0], np.where(a == 2, d[1], d[2])), a))


def _probabilities(a, cut, cut1, t, m, p, q) -> tuple[np.ndarray, np.ndarray]:
    """(p, q): probability of an n-gram, and with one of its events left out, see ``left_out``."""
    lower = np.where(a > 1, p, q)
    left = (np.maximum(a - 1 - cut1, 0.0) + (m - cut + cut1) * lower) / np.maximum(t - 1, 1)
    return (a - cut + m * p) / t, np.where(t <= 1, lower, left)


_SUMS = "block long, docs binary, n int, nll binary, numbers binary, keys binary"


def _sum_rows(doc: np.ndarray, total: np.ndarray, number: np.ndarray) -> Iterator[tuple]:
    """Rows ``_SUMS`` of sums of documents, a row for each ``1 << SUM_BITS`` numbers."""
    at = np.argsort(doc, kind="stable")
    block = doc[at] >> SUM_BITS
    for own in np.split(at, np.flatnonzero(np.diff(block)) + 1):
        yield (int(doc[own[0]] >> SUM_BITS), (doc[own] & ((1 << SUM_BITS) - 1)).astype(np.uint16).tobytes(), len(own),
               total[own].tobytes(), _small(number[own]), None)


def _score(n: int, often: _Often | None = None):
    """Task function: a bucket's word counts, then its chunks, to partial sums per document."""
    often = often or _Often()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches, "bucket"):
            known = {(r["to"], r["lang"], r["second"]): r for r in rows if r["kind"] == 0}
            chunks = [r for r in rows if r["kind"] == 1]
            g = _Group(chunks, often)
            stats = {r["lang"]: r["stats"] for r in chunks}
            s = np.array([stats[x] for x in g.langs], dtype=np.float64).T
            a1 = np.zeros(len(g.last), dtype=np.int64)
            for to, i, at in g.dealt_words(n):
                r = known[to, g.langs[i], None]
                a1[at] = _wide(r["docs"], r["n"])
            a2, meets = g.a2, []
            for to, second, at in g.dealt_often(n):
                r = known[to, g.langs[g.lang[second]], int(g.words[second].astype(np.int64))]
                a2[at] = _wide(r["docs"], r["n"])
                meets.append((second, r["meets"]))

            def cuts(a, k, lang):
                d = s[3 * k - 3:3 * k, lang]
                return _cuts(a, d), _cuts(a - 1, d)
            lang = g.lang[g.last]
            t, m, kinds = s[9:12, lang]
            lower = 1 / (kinds + 1)
            p, q = _probabilities(a1, *cuts(a1, 1, lang), t, m, lower, lower)
            for k, a, context, below, word in ((2, a2, g.context2, g.uni2, g.context2), (3, g.a3, g.context3, g.bi3, g.second3)):
                cut, cut1 = cuts(a, k, g.lang[word])
                t, m = np.bincount(context, weights=a), np.bincount(context, weights=cut)
                for second, (events, *kinds) in meets if k == 2 else ():
                    t[second], m[second] = events, np.dot(kinds, s[3:6, g.lang[second]])
                p, q = _probabilities(a, cut, cut1, t[context], m[context], p[below], q[below])
            nll = -np.log(q).astype(np.float32).astype(np.float64)
            keys = [r["first"] + np.frombuffer(r["keys"], dtype=np.uint32).astype(np.int64) for r in chunks]
            starts = np.cumsum([0, *map(len, keys)])
            doc = np.concatenate([s + _wide(c["docs"], c["n"]) for c, s in zip(chunks, starts)])
            grams = np.cumsum([0, *[c["m"] for c in chunks]])
            gram = np.concatenate([s + _wide(c["events"], c["n"]) for c, s in zip(chunks, grams)])
            says = g.says[gram]
            event = pd.unique(doc[says] << 32 | g.tri[gram[says]])
            doc, keys = event >> 32, np.concatenate(keys)
            number = np.bincount(doc, minlength=len(keys))
            total = np.bincount(doc, weights=nll[event & ((1 << 32) - 1)], minlength=len(keys))
            at = np.flatnonzero(number)
            if len(at):
                yield _rows(list(_sum_rows(keys[at], total[at], number[at])), _SUMS)
    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(block, nll, n, keys) of the documents of every block."""
    for block, rows in _by_bucket(batches, "block"):
        total, number, keys = np.zeros(1 << SUM_BITS), np.zeros(1 << SUM_BITS, dtype=np.int64), None
        for r in rows:
            at = np.frombuffer(r["docs"], dtype=np.uint16)
            if r["keys"] is not None:
                keys = np.zeros((1 << SUM_BITS, 2), dtype=np.int64) if keys is None else keys
                keys[at] = np.frombuffer(r["keys"], dtype=np.int64).reshape(-1, 2)
            else:
                total[at] += np.frombuffer(r["nll"], dtype=np.float64)
                number[at] += _wide(r["numbers"], r["n"])
        yield block, total, number, keys


def _add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: rows ``_SUMS`` to one row for each block."""
    for block, total, number, _ in _add_up(batches):
        at = np.flatnonzero(number)
        yield _rows([(block, at.astype(np.uint16).tobytes(), len(at), total[at].tobytes(), _small(number[at]), None)], _SUMS)


def _add_keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: rows ``_SUMS`` and those of ``_doc_keys`` to (k1, k2, nll, n)."""
    for _, total, number, keys in _add_up(batches):
        at = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(keys[at, 0]), pa.array(keys[at, 1]), pa.array(total[at]), pa.array(number[at])],
                                         ["k1", "k2", "nll", "n"])


def _doc_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: the keys of the documents of ``_word_blocks`` as rows ``_SUMS``."""
    for batch in batches:
        for first, keys in zip(*[batch.column(c).to_pylist() for c in ("first", "keys")]):
            doc, rows = first + np.arange(len(keys) // 16), []
            for own in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc >> SUM_BITS)) + 1):
                rows.append((int(doc[own[0]] >> SUM_BITS), (doc[own] & ((1 << SUM_BITS) - 1)).astype(np.uint16).tobytes(), len(own),
                             None, None, keys[16 * own[0]:16 * (own[-1] + 1)]))
            yield _rows(rows, _SUMS)


def _language_stats(counted: DataFrame) -> DataFrame:
    """(_l, stats): d1, d2, d3 of the orders 1 to 3, and the events, discounts and kinds of order 1, a row per language."""
    from tidepool.llm.quality import discounts_of
    c = [f"n{i}" for i in (1, 2, 3, 4)] + ["more", "t"]
    n = counted.where("k > 0").groupBy("lang", "k").agg(*[F.sum(x).alias(x) for x in c])
    d = discounts_of(n, "k", "t", *[F.col(x) for x in ("n1", "n2", "n3", "n4", "more")])
    m = F.col("n1") * F.col("d1") + F.col("n2") * F.col("d2") + (F.col("n3") + F.col("n4") + F.col("more")) * F.col("d3")
    kinds = F.col("n1") + F.col("n2") + F.col("n3") + F.col("n4") + F.col("more")
    d = d.select("lang", "k", "d1", "d2", "d3", F.col("t").cast("double").alias("t"), m.alias("m"), kinds.cast("double").alias("kinds"))
    of = [F.max(F.when(F.col("k") == k, F.col(x))) for k in (1, 2, 3) for x in ("d1", "d2", "d3")]
    return d.groupBy(F.col("lang").alias("_l")).agg(F.array(*of, *[F.max(F.when(F.col("k") == 1, F.col(x))) for x in ("t", "m", "kinds")]).alias("stats"))


def _often_words(blocks: DataFrame, most: int) -> _Often:
    """Words with more than ``most`` places; there are at most as many as ``most`` goes into all places."""
    counts = blocks.select("often", "counts").mapInArrow(_often, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") > most).collect()
    words = np.array([r.word for r in rows], dtype=np.int64).view(np.uint64)
    parts = np.array([-(-r.n // max(1, most // 2)) for r in rows], dtype=np.int64)
    order = np.argsort(words)
    return _Often(words[order], parts[order])


def _partial_sums(rows: DataFrame, bucket_grams: int, turn_bytes: int) -> DataFrame:
    """(k1, k2, nll, n) of every text, by the model of order 3 and two rounds of turns over the texts.

    The texts are read once and written as places in lists of words.  A 4-gram goes to the bucket of its third word, where all counts of
    its trigrams, of their contexts and of its bigrams come together; only the counts of the last words are met by an exchange of their
    own.  A word with more than ``bucket_grams`` places has several buckets, by the word before it: the counts of its bigrams
    are met by that exchange too.  There are up to ``TURNS`` turns (fewer below ``turn_bytes`` of text each); a turn deals out its share of
    the buckets and its shuffle files go at its end, so that no step holds all n-grams on disk.  The first round counts, the second scores.
    """
    blocks = materialize(rows.mapInArrow(_word_blocks, _WORDS), "word-ids", **_LARGE_ROWS)
    size = 6 * (blocks.agg(F.sum("size").alias("b")).first().b or 0)
    turns = min(TURNS, max(1, -(-size // turn_bytes)))
    n = max(1, -(-size // (6 * turns * bucket_grams)))
    often = _often_words(blocks, bucket_grams)
    texts = blocks.drop("often", "counts")

    def dealt(turn, with_docs):
        return texts.mapInArrow(_chunks(n, turn, turns, with_docs, often), _CHUNK)
    counted = None
    for turn in range(turns):
        c = dealt(turn, False).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(n, often), _COUNTED)
        c = materialize(c, f"word-c{turn}")
        counted = c if counted is None else counted.unionAll(c)
    # the last words' exchange in turns too; what has been read for the last time goes
    words = None
    for turn in range(WORD_TURNS):
        c = counted.where((F.col("k") == 0) & (F.col("to") % WORD_TURNS == turn)).repartition(n, "to").sortWithinPartitions("to")
        c = materialize(c.mapInArrow(_count_words, _COUNTED), f"word-a{turn}")
        words = c if words is None else words.unionAll(c)
    stats = materialize(_language_stats(counted.unionAll(words)), "word-d")
    discard(counted)
    meets = [F.sum(c).cast("double") for c in ("t", "n1", "n2")] + [F.sum(F.col("n3") + F.col("n4") + F.col("more")).cast("double")]
    meets = words.where("k = 2").groupBy(F.col("second").alias("_s")).agg(F.array(*meets).alias("meets"))
    meets = materialize(meets, "word-m")  # a row for each word of several buckets
    empty = F.lit(None).cast("binary")
    asked = words.where("k = 0").select("bucket", F.lit(0).alias("kind"), "to", "lang", empty.alias("words"), F.lit(0).alias("w"), "n", F.lit(0).alias("m"),
                                        empty.alias("grams"), empty.alias("events"), F.col("vals").alias("docs"),
                                        F.lit(0).cast("long").alias("first"), empty.alias("keys"), "second")
    parts: list[DataFrame] = []
    sums = texts.select("first", "keys").mapInArrow(_doc_keys, _SUMS)
    for turn in range(turns):
        c = dealt(turn, True).unionAll(asked.where(F.col("bucket") % turns == turn)).repartition(n, "bucket") \
            .join(F.broadcast(stats), F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l") \
            .join(F.broadcast(meets), F.col("second") == F.col("_s"), "left").drop("_s") \
            .sortWithinPartitions("bucket").mapInArrow(_score(n, often), _SUMS)
        c = materialize(c.repartition("block").sortWithinPartitions("block").mapInArrow(_add_sums, _SUMS), f"word-s{turn}")
        sums = sums.unionAll(c)
        parts.append(c)
    keyed = sums.repartition("block").sortWithinPartitions("block").mapInArrow(_add_keyed, "k1 long, k2 long, nll double, n long")
    sums = materialize(keyed.groupBy("k1", "k2").agg(F.sum("nll").alias("nll"), F.sum("n").alias("n")), "word-s")
    for df in (words, blocks, *parts):
        discard(df)
    return sums


# ----------------------------------------------------------- other orders: look-ups

_BLOB = "bucket int, kind int, keys binary, vals binary, docs binary"


def _blob(rows: list) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "kind", "keys", "vals", "docs"])


def _model_blobs(order: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            g, v = (np.concatenate(x) for x in zip(*held))
            return _blob([(b, 0, g[at].tobytes(), v[at].tobytes(), b"") for b, at in _dealt(_bucket(g, n), n)])
        for b in batches:
            words = [b.column(j).to_numpy().astype(np.int64).view(np.uint64) for j in range(order)]
            held.append((gram_hash(words), np.log(b.column(order).to_numpy()).astype(np.float32)))
            size += len(held[-1][0])
            if size > 1_000_000:
                yield out()
                held, size = [], 0
        if size:
            yield out()
    return run


def _document_blobs(order: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs, k1, k2 in _blocks(batches):
            _, g, doc, word = events(texts, langs, order)
            g, doc = g[word], doc[word]
            keys = np.array([k1, k2], dtype=np.int64).T
            rows = []
            for b, at in _dealt(_bucket(g, n), n):
                u, local = np.unique(doc[at], return_inverse=True)
                rows.append((b, 1, g[at].tobytes(), local.astype(np.uint32).tobytes(), keys[u].tobytes()))
            if rows:
                yield _blob(rows)
    return run


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket, the model's first: partial sums (k1, k2, nll, n) per document and block."""
    bucket, parts, h, v = None, [], None, None
    for batch in batches:
        for b, kind, keys, vals, docs in zip(*[c.to_pylist() for c in batch.columns]):
            if b != bucket:
                bucket, parts, h = b, [], None
            g = np.frombuffer(keys, dtype=np.uint64)
            if kind == 0:
                parts.append((g, np.frombuffer(vals, dtype=np.float32)))
                continue
            if h is None:
                h, v = (np.concatenate(x) for x in zip(*parts))
                at = np.argsort(h)
                h, v, parts = h[at], v[at], []
            local = np.frombuffer(vals, dtype=np.uint32)
            k = np.frombuffer(docs, dtype=np.int64).reshape(-1, 2)
            at = np.minimum(np.searchsorted(h, g), len(h) - 1)
            if not (h[at] == g).all():
                raise ValueError("an n-gram of a document is not in the model")
            yield pa.RecordBatch.from_arrays(
                [pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(np.bincount(local, weights=-v[at].astype(np.float64), minlength=len(k))),
                 pa.array(np.bincount(local, minlength=len(k)).astype(np.int64))], ["k1", "k2", "nll", "n"])


def text_keys(text: Column, lang: Column) -> tuple[Column, Column]:
    """128 bits of hash of a text and its language."""
    parts = (text, lang.isNull(), F.coalesce(lang, F.lit("")))
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)


def log_perplexity(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
                   bucket_grams: int = BUCKET_GRAMS, turn_bytes: int = TURN_BYTES) -> DataFrame:
    """(k1, k2, log_ppl): held-out log perplexity of every distinct (text, language), see ``text_keys``."""
    text, lang = text_of(text_col), F.col(lang_col).cast("string")
    k1, k2 = text_keys(text, lang)
    rows = docs.select(text.alias("text"), lang.alias("lang"), k1.alias("k1"), k2.alias("k2"))
    with freed_shuffles(docs.sparkSession):
        sums = _partial_sums(rows, bucket_grams, turn_bytes) if order == 3 else _looked_up(rows, order, bucket_grams)
        return materialize(sums.groupBy("k1", "k2").agg((F.sum("nll") / F.sum("n")).alias("log_ppl")), "word-ppl")


def _looked_up(rows: DataFrame, order: int, bucket_grams: int) -> DataFrame:
    """(k1, k2, nll, n) of every text and block, by a model of any order with a row per n-gram."""
    words = [f"w{j}" for j in range(order + 1)]
    columns = ", ".join(f"{w} long" for w in words)
    top = rows.mapInArrow(_distinct(order + 1), f"lang string, {columns}").distinct()
    model = left_out(top, order)
    n = -(-model.count() // bucket_grams) or 1
    blobs = model.select(*words[1:], "q").mapInArrow(_model_blobs(order, n), _BLOB) \
        .unionAll(rows.mapInArrow(_document_blobs(order, n), _BLOB))
    return blobs.repartition(n, "bucket").sortWithinPartitions("bucket", "kind") \
        .mapInArrow(_look_up, "k1 long, k2 long, nll double, n long")
