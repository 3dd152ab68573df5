"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. *Voters.*  Lexicon voters fire on words or word prefixes, pattern voters on how a
   text is written.  Besides the plain lists below, up to ``LEXICONS`` lexicons are mined from
   a bounded sample of labelled rows: among the terms that stand out in toxic texts, each
   lexicon is a greedy cover of these texts by terms that no earlier lexicon has, so
   every lexicon speaks for all languages and kinds of toxic text.
2. *Label model.*  A two-class latent model with a hit rate per voter and class is fitted
   by expectation maximisation to the vote patterns of all documents (a table of
   patterns and counts, summed in Spark).  A voter that does not fire abstains; only a text
   on which all abstain has their silence held against it.  Correlations of voters within a class are
   estimated from its residuals, and correlated votes count for less: voter ``j`` weighs
   ``1 / (1 + sum of its positive correlations)``.  Labels are not used here.
3. *Classifier.*  A logistic regression on the votes and a few densities, trained on the
   posterior labels of the sampled rows, scores every document.

The sample has at most ``max_toxic`` and ``max_clean`` labelled rows (a documented bound,
so its ids may be broadcast); rows whose crc32 of the id is 0 mod 5 are held out of it.
Of rows whose texts share their smallest shingle hash (copies) one is used for mining.

Defined cases: NULL and empty texts score like any text without votes; NULL labels
are not learnt from; NULL ids are not held out; without toxic labelled rows only the
plain lists vote; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import fresh, materialize, table, text_of
from tidepool.session import broadcast

WORDS = re.compile(r"[^\W\d_]+")
CAPITALS = re.compile(r"[A-Z]{3,}")
PREFIXES = (3, 4, 5, 6, 7, 8)
LEXICONS = 8
MIN_NEW = 4
FLUSH_TERMS = 200_000  # partial counts a task holds before it hands them on
MIN_LOG_ODDS = 5.0

#: Plain insults (en, de, fr, es).
PLAIN = frozenset(
    "idiot moron stupid loser scum trash pathetic worthless clown disgusting dumb fool jerk bastard imbecile "
    "trottel dumm versager abschaum arschloch wertlos widerlich dummkopf vollidiot "
    "imbécile crétin abruti ordure connard minable stupide débile salaud "
    "idiota imbécil estúpido basura escoria inútil asqueroso cretino tonto payaso".split())
SECOND_PERSON = {"you", "your", "youre", "du", "dich", "dein", "tu", "toi", "vous", "tú", "ti", "usted"}


def toxic_label(c: str) -> Column:
    return F.col(c).cast("int")


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


# ---------------------------------------------------------------------- voters

def stems_of(words: set[str], n: int) -> tuple[set[str], set[str]]:
    """Prefixes of ``n`` letters of longer words, and those that two or more of the words share."""
    seen = Counter(w[:n] for w in words if len(w) > n)
    return set(seen), {s for s, k in seen.items() if k > 1}


def terms(text: str) -> set[str]:
    """The words of a text in lower case, their prefixes marked with their length, shared ones once more with a plus."""
    words = set(WORDS.findall(text.lower()))
    out = set(words)
    for n in PREFIXES:
        once, shared = stems_of(words, n)
        out |= {f"{n}{s}" for s in once} | {f"{n}{s}+" for s in shared}
    return out


class Voters:
    """Binary voters of a text: one per lexicon, and patterns."""

    def __init__(self, lexicons: list[list[str]]):
        self.words = [PLAIN, *[frozenset(t for t in x if not t[0].isdigit()) for x in lexicons]]
        self.stems = [{}, *[{n: frozenset(t[1:] for t in x if t[0] == str(n)) for n in PREFIXES} for x in lexicons]]
        self.lengths = [n for n in PREFIXES if any(x.get(n) for x in self.stems)]
        self.names = ["plain", *[f"mined{i}" for i in range(len(lexicons))], "two_hits", "many_hits", "addressed", "shouted"]

    def vote(self, text: str) -> tuple[int, float, float]:
        """(votes as bits, log of 1 + words hit, share of capitals)."""
        words = set(WORDS.findall(text.lower()))
        stems = {}
        for n in self.lengths:
            once, shared = stems_of(words, n)
            stems[n] = once | {f"{x}+" for x in shared}
        fired, hits = [], set()
        for own, starts in zip(self.words, self.stems):
            found = words & own
            for n in self.lengths:
                if starts.get(n):
                    for stem in stems[n] & starts[n]:
                        found |= {w for w in words if w.startswith(stem.rstrip("+"))}
            fired.append(bool(found))
            hits |= found
        capitals = sum(map(len, CAPITALS.findall(text))) / max(len(text), 1)
        fired += [len(hits) >= 2, len(hits) >= 4, bool(hits) and not words.isdisjoint(SECOND_PERSON),
                  bool(hits) and capitals > 0.5]
        return sum(1 << i for i, x in enumerate(fired) if x), math.log1p(len(hits)), capitals


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                max_toxic: int, max_clean: int) -> DataFrame:
    """(toxic, text) of a bounded sample of labelled rows outside the held-out fold."""
    y = labels.where(~held_out(id_col) & F.col(id_col).isNotNull() & toxic_label(label_col).isin(0, 1)) \
        .select(F.col(id_col).alias("_id"), toxic_label(label_col).alias("toxic")).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("_id"), F.col("_id")]
    ids = y.where("toxic = 1").orderBy(*order).limit(max_toxic).unionAll(
        y.where("toxic = 0").orderBy(*order).limit(max_clean))
    # at most max_toxic + max_clean ids
    return docs.join(F.broadcast(ids), F.col(id_col) == F.col("_id")).select("toxic", text_of(text_col).alias("text"))


def _smallest_shingle(text: str) -> int:
    import xxhash
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return min((xxhash.xxh64_intdigest(b" ".join(w[i:i + 5])) for i in range(max(1, len(w) - 4))), default=0)


def mine_lexicons(sample: DataFrame) -> list[list[str]]:
    """Lexicons of terms that stand out in toxic texts; each covers these texts greedily."""
    def shingled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(_smallest_shingle).astype("uint64").astype("int64")
    once = sample.withColumn("copy", F.pandas_udf(shingled, "long")("text")) \
        .groupBy("toxic", "copy").agg(F.min("text").alias("text"))
    once = materialize(once, "toxicity-sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = [Counter(), Counter()]

        def out():
            for y in (0, 1):
                if n[y]:
                    yield pd.DataFrame({"toxic": y, "term": list(n[y].keys()), "n": list(n[y].values())})
                    n[y].clear()
        for pdf in batches:
            for y, t in zip(pdf["toxic"], pdf["text"]):
                n[y].update(terms(t))
                if len(n[y]) > FLUSH_TERMS:
                    yield from out()
        yield from out()
    size = {r["toxic"]: r["count"] for r in once.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    counts = once.mapInPandas(count, "toxic int, term string, n long").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")).where(F.col("a") >= MIN_NEW)
    a, b = F.col("a") + 0.5, F.col("b") + 0.1
    odds = F.log(a / (n1 - F.col("a") + 0.5)) - F.log(b / (n0 - F.col("b") + 0.5))
    good = frozenset(r["term"] for r in counts.where(odds >= MIN_LOG_ODDS).select("term").collect())
    if not good:
        return []

    @F.pandas_udf("array<string>")
    def found(s: pd.Series) -> pd.Series:
        return s.map(lambda t: sorted(terms(t) & good))
    texts = [set(r["found"]) for r in once.where("toxic = 1").select(found("text").alias("found")).collect()]
    out = []
    for _ in range(LEXICONS):
        chosen = cover(texts, max(MIN_NEW, len(texts) // 200))
        if not chosen:
            break
        out.append(chosen)
        texts = [t - set(chosen) for t in texts]
    return out


def cover(texts: list[set[str]], least: int) -> list[str]:
    """Greedy cover: every chosen term is in at least ``least`` texts that no earlier one is in."""
    where: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        for x in t:
            where.setdefault(x, []).append(i)
    heap = [(-len(v), x) for x, v in where.items() if len(v) >= least]
    heapq.heapify(heap)
    covered, chosen = set(), []
    while heap:
        gain, x = heapq.heappop(heap)
        now = sum(i not in covered for i in where[x])
        if now < least:
            continue
        if now < -gain:
            heapq.heappush(heap, (-now, x))
            continue
        chosen.append(x)
        covered.update(where[x])
    return chosen


# ----------------------------------------------------------------- label model

class LabelModel:
    """Hit rates of the voters in both classes, their weights, and the share of the toxic class."""

    def __init__(self, prior: float, rates: np.ndarray, weights: np.ndarray):
        self.prior, self.rates, self.weights = prior, rates, weights

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of rows of a 0/1 vote matrix."""
        fired = self.weights * np.log(self.rates[1] / self.rates[0])
        silent = self.weights * np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        z = math.log(self.prior / (1 - self.prior)) + votes @ fired + (votes.sum(axis=1) == 0) * silent.sum()
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def unpack(bits: np.ndarray, m: int) -> np.ndarray:
    return (bits[:, None] >> np.arange(m)[None, :] & 1).astype(np.float64)


def moments(patterns: DataFrame, m: int, posterior) -> list[np.ndarray]:
    """Per class: posterior mass, sums of votes and of products of votes, over all patterns."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + m + m * m))
        for pdf in batches:
            v = unpack(pdf["votes"].to_numpy(dtype=np.int64), m)
            p = posterior(v)
            for y, w in enumerate((1 - p, p)):
                w = w * pdf["n"].to_numpy()
                total[y] += np.concatenate(([w.sum()], w @ v, ((v * w[:, None]).T @ v).ravel()))
        yield pd.DataFrame({"y": np.repeat([0, 1], total.shape[1]), "i": np.tile(np.arange(total.shape[1]), 2),
                            "s": total.ravel()})
    out = np.zeros((2, 1 + m + m * m))  # 2 * (1 + m + m * m) numbers come back
    for r in patterns.mapInPandas(run, "y int, i int, s double").groupBy("y", "i").agg(F.sum("s").alias("s")).collect():
        out[r["y"], r["i"]] = r["s"]
    return [out[0], out[1]]


def fit_label_model(patterns: DataFrame, m: int, rounds: int = 12) -> LabelModel:
    """Expectation maximisation over (votes, n) patterns, with correlations re-estimated every round."""
    def start(v: np.ndarray) -> np.ndarray:
        return np.where(v.sum(axis=1) >= 2, 0.95, np.where(v.sum(axis=1) == 1, 0.5, 0.01))
    posterior, model = start, None
    for _ in range(rounds):
        s = moments(patterns, m, posterior)
        mass = [max(x[0], 1e-9) for x in s]
        rates = np.array([(x[1:m + 1] + 0.01) / (w + 0.02) for x, w in zip(s, mass)])
        rates = np.clip(rates, 1e-6, 1 - 1e-6)
        rates[1] = np.maximum(rates[1], rates[0])  # a voter never speaks for the clean class
        total = sum(mass)
        corr = np.zeros((m, m))
        for x, w, r in zip(s, mass, rates):
            mean = x[1:m + 1] / w
            cov = x[m + 1:].reshape(m, m) / w - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            corr += w / total * np.clip(cov / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(corr, 0)
        model_next = LabelModel(min(max(mass[1] / total, 1e-4), 0.5), rates, 1 / (1 + corr.sum(axis=1)))
        done = model is not None and np.abs(model.rates - rates).max() < 1e-4
        model = model_next
        posterior = model.posterior
        if done:
            break
    return model


# ------------------------------------------------------------------ classifier

FEATURES = "votes long, hits double, capitals double"


def with_votes(docs: DataFrame, voters: Voters, out_col: str, text_col: str) -> DataFrame:
    shared = broadcast(docs.sparkSession, voters)

    @F.pandas_udf(FEATURES)
    def votes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([shared.value.vote(t) for t in s], columns=["votes", "hits", "capitals"])
    return docs.withColumn(out_col, votes(text_of(F.col(f"`{text_col}`"))))


def fit_logistic(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression on soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(penalty), x.T @ (p - q) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", max_toxic: int = 5_000, max_clean: int = 15_000,
                    keep_columns: list[str] | None = None) -> tuple[DataFrame, str]:
    """``keep_columns`` of ``docs`` (all by default) with a score column, and that column's name."""
    sample = materialize(sample_rows(docs, labels, id_col, text_col, label_col, max_toxic, max_clean), "toxicity-rows")
    voters = Voters(mine_lexicons(sample))
    m = len(voters.names)
    v, score = fresh(docs, "votes", "score")
    cols = [F.col(f"`{c}`") for c in (docs.columns if keep_columns is None else keep_columns)]
    voted = materialize(with_votes(docs, voters, v, text_col).select(*cols, v), "toxicity-votes")
    patterns = materialize(voted.groupBy(F.col(f"{v}.votes").alias("votes")).agg(F.count(F.lit(1)).alias("n")),
                           "toxicity-patterns")
    model = fit_label_model(patterns, m)
    rows = with_votes(sample, voters, v, "text").select(f"{v}.*").toPandas()  # at most the sample's bound
    votes = unpack(rows["votes"].to_numpy(dtype=np.int64), m)
    x = np.hstack([votes, rows[["hits", "capitals"]].to_numpy()])
    w = fit_logistic(x, model.posterior(votes)) if len(x) else np.append(np.zeros(m + 2), -4.0)
    z = F.lit(float(w[-1])) + float(w[m]) * F.col(f"{v}.hits") + float(w[m + 1]) * F.col(f"{v}.capitals")
    for i in range(m):
        z = z + F.when(F.col(f"{v}.votes").bitwiseAND(F.lit(1 << i)) != 0, F.lit(float(w[i]))).otherwise(F.lit(0.0))
    return voted.withColumn(score, 1 / (1 + F.exp(-z))).drop(v), score


def toxicity_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    scored, score = toxicity_scores(docs, labels, **kw)
    return scored.where(F.col(score) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, score = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                    keep_columns=["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col(score).alias("score"),
                         F.when(F.col(score) >= 0.5, 1).otherwise(0).alias("predicted"))
