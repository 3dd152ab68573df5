import random
import zlib

import numpy as np
from tests.conftest import SF_SMALL
from pyspark.sql import functions as F

from tidepool.llm import toxicity as T
from tidepool.llm.common import table


def corpus(n=700, seed=3):
    """Clean words in two languages; toxic texts hold an insult or a word with a bad stem."""
    rnd = random.Random(seed)
    words = {x: ["".join(rnd.choices(s, k=rnd.randint(2, 4))) for _ in range(400)]
             for x, s in (("en", ["ta", "lo", "mi", "ne"]), ("de", ["ung", "heit", "ver", "ge"]))}
    docs, labels = [], []
    for i in range(n):
        lang = rnd.choice(["en", "de"])
        text = rnd.choices(words[lang], k=rnd.randint(20, 60))
        toxic = int(rnd.random() < 0.25)
        if toxic:
            for _ in range(rnd.randint(2, 4)):
                bad = rnd.choice(["blorf", "snark", "zilch"]) if lang == "en" else "knurz" + rnd.choice(["ung", "heit", "ver", "en"])
                text.insert(rnd.randrange(len(text)), bad)
        docs.append((i, " ".join(text), lang, f"s{i % 3}", 0))
        if i % 10:
            labels.append((i, 1, toxic))
    return docs, labels


def frames(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs + [(9001, None, None, None, 0), (9002, "", "en", "s", 0), (9002, "", "en", "s", 0), (None, "x", "en", "s", 0)],
                              "doc_id long, text string, lang string, source string, score int")
    return d, spark.createDataFrame(labels + [(9001, None, None), (9002, 1, 0)], "doc_id long, quality int, toxic int"), dict((i, t) for i, _, t in labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = frames(spark)
    scored, c = T.toxicity_scores(docs, labels)
    rows = scored.select("doc_id", F.col(c).alias("p"), T.held_out("doc_id").alias("held")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.p <= 1
        assert r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    judged = [(r.p >= 0.5, truth[r.doc_id]) for r in rows if r.held and r.doc_id in truth]
    assert len(judged) > 80
    assert np.mean([p == t for p, t in judged]) > 0.97


def test_scores_do_not_read_labels_of_held_out_rows_nor_other_columns(spark):
    docs, labels, _ = frames(spark)
    first, a = T.toxicity_scores(docs, labels, keep_columns=["doc_id"])
    flipped = labels.withColumn("toxic", F.when(T.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    second, b = T.toxicity_scores(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), flipped, keep_columns=["doc_id"])
    assert sorted(map(str, first.select("doc_id", F.round(a, 9)).collect())) == sorted(map(str, second.select("doc_id", F.round(b, 9)).collect()))


def test_filter_keeps_clean_rows_and_columns(spark):
    docs, labels, truth = frames(spark)
    kept = T.toxicity_filter(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    clean = [i for i, t in truth.items() if not t]
    assert sum(i in set(ids) for i in clean) > 0.98 * len(clean)
    assert ids.count(9002) == 2 and None in ids
    assert T.toxicity_filter(docs.where("false"), labels).count() == 0


def test_without_labels_the_plain_lists_vote(spark):
    docs = spark.createDataFrame([(i, "you stupid idiot and moron" if i % 4 == 0 else f"calm words number {i}") for i in range(80)],
                                 "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scored, c = T.toxicity_scores(docs, none)
    assert scored.where(f"`{c}` is null").count() == 0


def brute_posterior(model, fired):
    z = np.log(model.prior / (1 - model.prior))
    if any(fired):
        z += sum(w * np.log(a / b) for w, a, b, f in zip(model.weights, model.rates[1], model.rates[0], fired) if f)
    else:
        z += sum(w * np.log((1 - a) / (1 - b)) for w, a, b in zip(model.weights, model.rates[1], model.rates[0]))
    return 1 / (1 + np.exp(-z))


def test_label_model_finds_rates_and_correlations(spark):
    rnd = np.random.default_rng(5)
    y = rnd.random(20_000) < 0.2
    votes = np.column_stack([rnd.random(len(y)) < np.where(y, a, b) for a, b in ((0.8, 0.01), (0.7, 0.02), (0.9, 0.005))])
    votes = np.column_stack([votes, votes[:, 0]])  # a copy of the first voter
    bits = (votes * (1 << np.arange(4))).sum(axis=1)
    values, counts = np.unique(bits, return_counts=True)
    patterns = spark.createDataFrame([(int(v), int(n)) for v, n in zip(values, counts)], "votes long, n long")
    model = T.fit_label_model(patterns, 4)
    assert abs(model.prior - 0.2) < 0.05
    assert np.abs(model.rates[1][:3] - [0.8, 0.7, 0.9]).max() < 0.15
    assert model.weights[0] < model.weights[1] and model.weights[3] < model.weights[2]
    got = model.posterior(T.unpack(values, 4))
    for v, p in zip(values, got):
        assert abs(p - brute_posterior(model, [v >> i & 1 for i in range(4)])) < 1e-9


def test_cover_is_greedy():
    texts = [{"a", "b"}, {"a"}, {"b", "c"}, {"c"}, {"c", "d"}]
    assert T.cover(texts, 1) == ["c", "a"]
    assert T.cover(texts, 3) == ["c"]
    assert T.cover([], 1) == []


def test_query_covers_the_table(spark):
    rows = T.op9_toxicity(spark, SF_SMALL).collect()
    assert len(rows) == table(spark, SF_SMALL, "documents").count()
    assert {r.predicted for r in rows} <= {0, 1}
