"""Quality rules: base counters and an n-gram perplexity verdict.

The verdict uses the held-out word n-gram model of ``wordlm``, whose hash arrays stay partitioned,
and language-specific bands of a text's log perplexity: one below the band (templates) or above it
(noise, word salad) is rejected.

This module also holds a modified Kneser-Ney model over characters with broadcast arrays folded to
``hash_bits`` (``fit_perplexity``, ``with_scores``).  It merges n-grams when they outgrow the
arrays, so no query uses it.

* It reads a text as its words joined by one space, digits as ``0``, ``order - 1``
  start symbols before it and one end symbol after it.  A character is a 12-bit
  class: code points below 4096 are their own class, the others share classes
  by a multiplicative hash.

Defined cases: NULL text is an empty text (no words, base_failed); a NULL
language is a language of its own; repeated rows are judged row by row; an empty
table gives an empty result; other columns are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import wordlm
from tidepool.llm.common import fresh, materialize, table, text_of
from tidepool.session import broadcast

CLASS_BITS = 12
CLASS_MASK = (1 << CLASS_BITS) - 1
BOS, EOS, OTHER = 0, 2, 1
SYMBOLS = "#*$%&|<>"
LANG_CLASSES = 4096
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_CLEAN = 50
BELOW = 0.05
_SYMBOL_TABLE = {ord(c): None for c in SYMBOLS}


# --------------------------------------------------------------- base counters

def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words covered by ``window``-word windows that occur twice or more (all occurrences count)."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    distinct = dict.fromkeys(words)
    seen = dict(zip(distinct, range(len(distinct))))
    ids = np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=len(words))
    vocabulary = len(seen)
    if vocabulary == len(words):
        return 0
    if vocabulary ** window < 2 ** 62:
        key = ids[:n].copy()
        for j in range(1, window):
            key = key * vocabulary + ids[j:n + j]
    else:  # rank prefixes so that a key always fits 64 bits
        key = ids[:n].copy()
        for j in range(1, window):
            key = np.unique(key, return_inverse=True)[1] * vocabulary + ids[j:n + j]
    order = np.sort(key)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    hit = np.isin(key, again)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n_space = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), len(text) - n_space, len(raw) - len(raw.translate(None, SYMBOLS.encode())),
            len(lines) - len(set(lines)), repeated_words(words))


# ------------------------------------------------------------ n-grams in numpy

def char_classes(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts, each padded with ``order - 1`` BOS and one EOS, and each text's first index."""
    pad = "\x00" * (order - 1)
    parts = [f"{pad}{' '.join(t.encode('utf-8', 'replace').decode().translate(_CONTROL).split(' '))}\x02" for t in texts]
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    c = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
    c = np.where((c >= 48) & (c <= 57), np.uint32(48), c)
    big = c > CLASS_MASK
    if big.any():
        c = np.where(big, (c * np.uint32(2654435761)) >> np.uint32(32 - CLASS_BITS), c)
        c = np.where(big & (c < 128), c + np.uint32(128), c)
    return c.astype(np.int64), starts


_CONTROL = {0: "\x01", 2: "\x01"}


def normalise(text: str) -> str:
    return " ".join(x.decode("utf-8", "replace") for x in text.encode("utf-8", "replace").split())


def gram_keys(classes: np.ndarray, order: int) -> np.ndarray:
    """Packed ``order``-gram that ends at each position (the oldest class in the highest bits)."""
    key = classes.copy()
    for j in range(1, order):
        key[j:] |= classes[:-j] << (CLASS_BITS * j)
    return key


def targets(starts: np.ndarray, total: int, order: int) -> np.ndarray:
    """True at positions that are predicted: all but the start symbols."""
    keep = np.ones(total, dtype=bool)
    for j in range(order - 1):
        keep[starts[:-1] + j] = False
    return keep


def _lang_salt(lang: str | None) -> int:
    """Salt of a language, equal to ``xxhash64`` of it in Spark is not needed: salts travel with the rows."""
    import xxhash
    return xxhash.xxh64_intdigest((lang if lang is not None else "\x00").encode("utf-8"), 7) & 0x7FFFFFFFFFFFFFFF


def fold(keys: np.ndarray, salt: int, hash_bits: int) -> np.ndarray:
    """Hash of packed n-grams of one language, folded to ``hash_bits`` bits (splitmix64 finaliser)."""
    x = keys.astype(np.uint64) ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(64 - hash_bits)).astype(np.uint32)


def count_grams(order: int, flush: int = 2_000_000):
    """Task function: rows (text, lang) to partial counts (lang, gram, n) of the top order."""
    def merged(parts):
        keys = np.concatenate([k for k, _ in parts])
        counts = np.concatenate([c for _, c in parts])
        u, inv = np.unique(keys, return_inverse=True)
        return u, np.bincount(inv, weights=counts).astype(np.int64)

    def out(lang, part):
        return pd.DataFrame({"lang": pd.Series([lang] * len(part[0]), dtype=object), "gram": part[0], "n": part[1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str | None, list] = {}
        for pdf in batches:
            langs = pdf["lang"].where(pdf["lang"].notna(), None).to_numpy(dtype=object)
            texts = pdf["text"].to_numpy(dtype=object)
            for lang in dict.fromkeys(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                for part in slices(own):
                    c, starts = char_classes([normalise(t) for t in part], order)
                    key = gram_keys(c, order)[targets(starts, len(c), order)]
                    held.setdefault(lang, []).append(np.unique(key, return_counts=True))
            if sum(len(k) for parts in held.values() for k, _ in parts) > flush:
                held = {lang: [merged(parts)] for lang, parts in held.items()}
                if sum(len(parts[0][0]) for parts in held.values()) > flush:
                    for lang, parts in held.items():
                        yield out(lang, parts[0])
                    held = {}
        for lang, parts in held.items():
            yield out(lang, merged(parts))
    return run


def slices(texts: list[str], chars: int = 400_000) -> Iterator[list[str]]:
    """Consecutive runs of texts of about ``chars`` characters (a longer text is a run of its own)."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


# ------------------------------------------------------------------- the model

def _discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts d1, d2, d3 of each language from its counts of counts."""
    n = [F.sum(F.when(F.col("a") == i, 1).otherwise(0)).cast("double") for i in (1, 2, 3, 4)]
    d = counts.groupBy("lang").agg(*[x.alias(f"n{i + 1}") for i, x in enumerate(n)])
    return discounts_of(d)


def discounts_of(d: DataFrame, *more: str | Column) -> DataFrame:
    """Discounts d1, d2, d3 from counts of counts (lang, n1..n4), with the columns ``more``."""
    y = F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2")))

    def bounded(e: Column, top: int, default: float) -> Column:
        return F.greatest(F.lit(0.05), F.least(F.lit(float(top)), F.coalesce(e, F.lit(default))))

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return d.select(
        "lang", *more, bounded(1 - 2 * y * ratio("n2", "n1"), 1, 0.5).alias("d1"),
        bounded(2 - 3 * y * ratio("n3", "n2"), 2, 0.75).alias("d2"),
        bounded(3 - 4 * y * ratio("n4", "n3"), 3, 0.9).alias("d3"))


def kneser_ney(top: DataFrame, order: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Probabilities and back-off weights of every order from the top-order counts.

    ``top`` has (lang, gram, n).  Returns, for k = 1..order, ``grams[k-1]`` (lang, gram, p)
    and ``contexts[k-1]`` (lang, ctx, gamma), ``ctx`` being the first k - 1 classes.
    """
    counts = [None] * (order + 1)
    counts[order] = top.select("lang", "gram", F.col("n").alias("a"))
    for k in range(order - 1, 0, -1):
        mask = (1 << (CLASS_BITS * k)) - 1
        counts[k] = counts[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")) \
            .agg(F.count(F.lit(1)).alias("a"))
    grams, contexts = [], []
    below = None
    for k in range(1, order + 1):
        d = _discounts(counts[k]).withColumnRenamed("lang", "_l")
        ctx = F.shiftright("gram", CLASS_BITS) if k > 1 else F.lit(0).cast("long")
        cut = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = counts[k].join(d, F.col("lang").eqNullSafe(F.col("_l"))).drop("_l") \
            .select("lang", "gram", ctx.alias("ctx"), F.col("a").cast("double").alias("a"),
                    F.least(cut, F.col("a").cast("double")).alias("cut"))
        gamma = rows.groupBy("lang", "ctx").agg(F.sum("a").alias("total"), F.sum("cut").alias("mass"),
                                                F.count(F.lit(1)).alias("kinds"))
        left, right = rows.alias("r"), gamma.alias("g")
        joined = left.join(right, F.col("r.lang").eqNullSafe(F.col("g.lang")) & (F.col("r.ctx") == F.col("g.ctx"))) \
            .select("r.lang", "r.gram", ((F.col("a") - F.col("cut")) / F.col("total")).alias("own"),
                    (F.col("mass") / F.col("total")).alias("gamma"), "kinds")
        if k == 1:
            p = joined.select("lang", "gram", (F.col("own") + F.col("gamma") / (F.col("kinds") + 1)).alias("p"))
        else:
            mask = (1 << (CLASS_BITS * (k - 1))) - 1
            lower = below.select(F.col("lang").alias("_l"), F.col("gram").alias("_g"), F.col("p").alias("_p"))
            p = joined.join(lower, F.col("lang").eqNullSafe(F.col("_l"))
                            & (F.col("gram").bitwiseAND(F.lit(mask)) == F.col("_g"))) \
                .select("lang", "gram", (F.col("own") + F.col("gamma") * F.col("_p")).alias("p"))
        below = materialize(p, f"kn-p{k}")
        grams.append(below)
        if k == 1:
            contexts.append(gamma.select("lang", "ctx", (F.col("mass") / F.col("total") / (F.col("kinds") + 1)).alias("gamma")))
        else:
            contexts.append(gamma.select("lang", "ctx", (F.col("mass") / F.col("total")).alias("gamma")))
    return grams, contexts


def _sorted_arrays(df: DataFrame, key: str, value: str, hash_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hash array of one order: folded hashes and float32 logs of the values.

    Folded in the tasks and combined per hash, so at most ``2**hash_bits`` rows come back.
    """
    def run(batches):
        for pdf in batches:
            lang = pdf["lang"].where(pdf["lang"].notna(), None).to_numpy(dtype=object)
            h = np.zeros(len(pdf), dtype=np.uint32)
            for x in dict.fromkeys(lang):
                at = np.array([y == x for y in lang], dtype=bool)
                h[at] = fold(pdf["k"].to_numpy()[at], _lang_salt(x), hash_bits)
            yield pd.DataFrame({"h": h.astype(np.int64), "v": pdf["v"].to_numpy()})
    t = df.select("lang", F.col(key).alias("k"), F.col(value).alias("v")).mapInPandas(run, "h long, v double") \
        .groupBy("h").agg(F.max("v").alias("v")).select(F.col("h").cast("int"), F.log("v").cast("float").alias("v"))
    got = t.toArrow()
    h = got["h"].to_numpy().astype(np.uint32)
    at = np.argsort(h)
    return h[at], got["v"].to_numpy().astype(np.float32)[at]


class Model:
    """Sorted hash arrays of every order."""

    def __init__(self, order: int, hash_bits: int, grams: list, contexts: list):
        self.order, self.hash_bits, self.grams, self.contexts = order, hash_bits, grams, contexts

    def _find(self, arrays, keys, salt, default):
        h, v = arrays
        x = fold(keys, salt, self.hash_bits)
        at = np.searchsorted(h, x)
        at[at == len(h)] = 0
        hit = h[at] == x if len(h) else np.zeros(len(x), dtype=bool)
        return hit, np.where(hit, v[at], np.float32(default)) if len(h) else np.full(len(x), default, np.float32)

    def logp(self, keys: np.ndarray, lang: str | None) -> np.ndarray:
        """Natural log probability of each packed top-order n-gram."""
        salt = _lang_salt(lang)
        out = np.zeros(len(keys), dtype=np.float64)
        left = np.arange(len(keys))
        for k in range(self.order, 0, -1):
            mine = keys[left] & ((1 << (CLASS_BITS * k)) - 1)
            hit, value = self._find(self.grams[k - 1], mine, salt, 0.0)
            out[left[hit]] += value[hit]
            left, mine = left[~hit], mine[~hit]
            if not len(left):
                break
            # a context never seen passes its whole weight down (log 1 = 0)
            default = 0.0 if k > 1 else np.log(1e-6)
            out[left] += self._find(self.contexts[k - 1], mine >> CLASS_BITS, salt, default)[1]
        return out


def fit_perplexity(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = 4,
                   hash_bits: int = 23) -> Model:
    """Count the n-grams of all ``docs`` and build the model."""
    rows = docs.select(text_of(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    top = rows.mapInPandas(count_grams(order), "lang string, gram long, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams, contexts = kneser_ney(materialize(top, "kn-counts"), order)
    return Model(order, hash_bits, [_sorted_arrays(g, "gram", "p", hash_bits) for g in grams],
                 [_sorted_arrays(c, "ctx", "gamma", hash_bits) for c in contexts])


SCORES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "log_ppl double")


def score_texts(model: Model, texts: list[str], langs: list[str | None]) -> pd.DataFrame:
    """Base counters and per-word log perplexity (-log p / n_words) of a list of texts."""
    base = np.array([base_counts(t) for t in texts], dtype=np.int64).reshape(len(texts), 5)
    nll = np.zeros(len(texts))
    for lang in dict.fromkeys(langs):
        own = [i for i, x in enumerate(langs) if x == lang]
        at = 0
        for part in slices([texts[i] for i in own]):
            c, starts = char_classes([normalise(t) for t in part], model.order)
            keep = targets(starts, len(c), model.order)
            lp = np.zeros(len(c))
            lp[keep] = model.logp(gram_keys(c, model.order)[keep], lang)
            nll[own[at:at + len(part)]] = -np.add.reduceat(lp, starts[:-1])
            at += len(part)
    out = pd.DataFrame(base, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
    out["log_ppl"] = nll / np.maximum(base[:, 0], 1)
    return out


def with_scores(docs: DataFrame, model: Model, out_col: str, text_col: str = "text",
                lang_col: str = "lang") -> DataFrame:
    """``docs`` with a struct column of the base counters and the log perplexity."""
    shared = broadcast(docs.sparkSession, model)

    @F.pandas_udf(SCORES)
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, lang in batches:
            yield score_texts(shared.value, list(text), [x if isinstance(x, str) else None for x in lang])
    return docs.withColumn(out_col, score(text_of(text_col), F.col(lang_col).cast("string")))


def base_failed(s: str | None = None) -> Column:
    def c(name):
        return F.col(f"{s}.{name}" if s else name)
    return (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))


def lang_class(lang_col: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(lang_col), F.lit("\x00"))), F.lit(LANG_CLASSES))


def perplexity_bands(scored: DataFrame, lang_col: str, ppl: Column, clean: Column, recall: float, low: float,
                     high: float) -> DataFrame:
    """(class, lower, upper) of the languages' bands.

    A language with ``MIN_CLEAN`` rows where ``clean`` holds keeps ``recall`` of these; of the rest ``BELOW`` lies under the band.
    Others have ``low`` and ``high`` robust deviations around the median, each side's from its own quartile
    of all rows.  Bands are kept for ``LANG_CLASSES`` classes that languages are hashed to, so there
    are at most so many rows.
    """
    q = F.percentile_approx(ppl, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000)
    below = (1 - recall) * BELOW
    c = F.percentile_approx(F.when(clean, ppl), F.array(F.lit(below), F.lit(recall + below)), 10_000)
    b = scored.groupBy(lang_class(lang_col).alias("_lang")).agg(
        q.alias("_q"), c.alias("_c"), F.count(F.when(clean & ppl.isNotNull(), 1)).alias("_n"))
    sigma = 1.4826
    floor = F.lit(0.02)
    labelled = F.col("_n") >= MIN_CLEAN
    lower = F.col("_q")[1] - low * sigma * F.greatest(F.col("_q")[1] - F.col("_q")[0], floor)
    upper = F.col("_q")[1] + high * sigma * F.greatest(F.col("_q")[2] - F.col("_q")[1], floor)
    return b.select("_lang", F.when(labelled, F.col("_c")[0]).otherwise(lower).alias("_lower"),
                    F.when(labelled, F.col("_c")[1]).otherwise(upper).alias("_upper"))


BASE = SCORES.rsplit(", ", 1)[0]


def base_scores(text: Column) -> Column:
    """Struct of the base counters."""
    @F.pandas_udf(BASE)
    def counts(text: pd.Series) -> pd.DataFrame:
        base = np.array([base_counts(t) for t in text], dtype=np.int64).reshape(len(text), 5)
        return pd.DataFrame(base, columns=[f.split()[0] for f in BASE.split(", ")])
    return counts(text)


def quality_scores(docs: DataFrame, out_col: str, text_col: str = "text", lang_col: str = "lang",
                   order: int = wordlm.ORDER, keep_columns: list[str] | None = None) -> DataFrame:
    """``keep_columns`` of ``docs`` and a struct column of the base counters and the log perplexity.

    Log perplexities come by an equi-join on the hash of text and language.
    """
    ppl = wordlm.log_perplexity(docs, text_col, lang_col, order)
    cols = docs.columns if keep_columns is None else keep_columns
    base, k1, k2 = fresh(docs, "base", "k1", "k2")
    a, b = wordlm.text_keys(text_of(text_col), F.col(lang_col).cast("string"))
    rows = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*cols, lang_col])], a.alias(k1), b.alias(k2),
                       base_scores(text_of(text_col)).alias(base))
    ppl = ppl.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("log_ppl").alias("_ppl"))
    fields = [f.split()[0] for f in BASE.split(", ")]
    score = F.struct(*[F.col(f"{base}.{f}").alias(f) for f in fields], F.col("_ppl").alias("log_ppl"))
    return rows.join(ppl, (F.col(k1) == F.col("_k1")) & (F.col(k2) == F.col("_k2")), "left") \
        .withColumn(out_col, score).drop(base, k1, k2, "_k1", "_k2", "_ppl")


def quality_verdicts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = wordlm.ORDER,
                     low: float = 8.0, high: float = 7.5, keep_columns: list[str] | None = None,
                     labels: DataFrame | None = None, id_col: str = "doc_id", recall: float = 0.98) -> DataFrame:
    """``keep_columns`` of ``docs`` (all by default) and a struct column ``verdict``.

    ``labels`` (``id_col``, quality): rows of quality 1 set the bands of their language, see ``perplexity_bands``.

    The struct has the base counters, ``log_ppl``, ``base_failed`` and ``kept``.
    """
    s, lang, clean = fresh(docs, "score", "lang", "clean")
    cols = docs.columns if keep_columns is None else keep_columns
    if labels is not None and id_col not in cols:
        raise ValueError(f"bands from labels need {id_col} among the kept columns")
    scored = quality_scores(docs, s, text_col, lang_col, order, cols)
    scored = materialize(scored.select(*[F.col(f"`{c}`") for c in cols], s, F.col(lang_col).cast("string").alias(lang)),
                         "quality-scores")
    judged = scored.where(~base_failed(s))
    if labels is None:
        judged = judged.withColumn(clean, F.lit(False))
    else:
        good = labels.where("quality = 1").select(F.col(id_col).alias("_id"), F.lit(True).alias(clean)).distinct()
        judged = judged.select(F.col(f"`{id_col}`"), lang, s).join(good, F.col(f"`{id_col}`") == F.col("_id"), "left") \
            .withColumn(clean, F.coalesce(F.col(clean), F.lit(False)))
    bands = perplexity_bands(judged, lang, F.col(f"{s}.log_ppl"), F.col(clean), recall, low, high)
    # at most LANG_CLASSES rows: the scored rows, which hold the texts, stay where they are
    j = scored.join(F.broadcast(bands), lang_class(lang) == F.col("_lang"), "left")
    failed = base_failed(s)
    ppl = F.col(f"{s}.log_ppl")
    kept = ~failed & ppl.between(F.col("_lower"), F.col("_upper"))
    fields = [f.strip().split(" ")[0] for f in SCORES.split(",")]
    verdict = F.struct(*[F.col(f"{s}.{f}").alias(f) for f in fields], failed.alias("base_failed"),
                       F.coalesce(kept, F.lit(False)).alias("kept"))
    return j.select(*[F.col(f"`{c}`") for c in cols], verdict.alias("verdict" if "verdict" not in cols else s))


def quality_filter(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    v = quality_verdicts(docs, **kw)
    name = v.columns[-1]
    return v.where(F.col(f"{name}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quality_verdicts(table(spark, sf_dir, "documents"), keep_columns=["doc_id"], labels=table(spark, sf_dir, "labels"))
    c = "verdict"
    return v.select("doc_id", f"{c}.n_words", f"{c}.word_chars", f"{c}.n_symbols", f"{c}.n_dup_lines",
                    f"{c}.n_repeat_words", f"{c}.base_failed", f"{c}.kept", F.round(f"{c}.log_ppl", 6).alias("log_ppl"))
