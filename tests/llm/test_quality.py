import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tidepool.llm import quality as q
from tidepool.llm.common import table


def brute_base(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered))


TEXTS = [None, "", "  \n\t", "one two", "a b c d e a b c d e f", "x\nx\n x\n\n\nx", "é ü #*$ %&|<> ç", "w " * 40,
         "\x0b\x0cq\x1cq\xa0q", "a b c d e f g a b c d e z a b c d e"]


def test_base_counters_equal_brute_force():
    rnd = random.Random(4)
    for t in TEXTS + [" ".join(rnd.choices("abc", k=rnd.randint(0, 60))) for _ in range(300)]:
        assert q.base_counts(t or "") == brute_base(t), t
    many = [str(i).encode() for i in range(7000)] * 2  # too many different words for one packed key
    assert q.repeated_words(many) == 14_000


def brute_model(docs, order):
    """Log perplexity per word by modified Kneser-Ney over dictionaries."""
    def symbols(t):
        c = q.char_classes([q.normalise(t)], order)[0].tolist()
        return c
    grams = defaultdict(Counter)
    for t, lang in docs:
        s = symbols(t)
        for i in range(order - 1, len(s)):
            grams[lang][tuple(s[i - order + 1:i + 1])] += 1
    prob, back = {}, {}
    for lang, top in grams.items():
        counts = {order: top}
        for k in range(order - 1, 0, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        for k in range(1, order + 1):
            n = [sum(1 for v in counts[k].values() if v == i) for i in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else None

            def d(i, default):
                ok = y is not None and n[i - 1] > 0
                return max(0.05, min(float(i), i - (i + 1) * y * n[i] / n[i - 1] if ok else default))
            ds = [d(1, 0.5), d(2, 0.75), d(3, 0.9)]
            ctx = defaultdict(lambda: [0.0, 0.0, 0])
            for g, a in counts[k].items():
                c = ctx[g[:-1]]
                c[0] += a
                c[1] += min(ds[min(a, 3) - 1], a)
                c[2] += 1
            for g, a in counts[k].items():
                total, mass, kinds = ctx[g[:-1]]
                low = prob[lang, g[1:]] if k > 1 else 1 / (kinds + 1)
                prob[lang, g] = (a - min(ds[min(a, 3) - 1], a)) / total + mass / total * low
    return lambda t, lang: -sum(math.log(prob[lang, tuple(s[i - order + 1:i + 1])])
                                for s in [symbols(t)] for i in range(order - 1, len(s))) / max(len(t.split()), 1)


def test_model_and_scores_equal_brute_force(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choices(["tea", "cup", "das", "ist", "été", "x1", "日本"], k=rnd.randint(1, 30))),
             rnd.choice(["en", "de", None])) for i in range(60)] + [(60, "", "en"), (61, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = q.fit_perplexity(docs, order=3, hash_bits=28)
    got = {r.doc_id: r.s for r in q.with_scores(docs, model, "s").collect()}
    want = brute_model([(t or "", lang) for _, t, lang in rows], 3)
    for i, t, lang in rows:
        assert got[i].log_ppl == pytest.approx(want(t or "", lang), abs=1e-4)
        assert tuple(got[i])[:5] == brute_base(t)


def test_probabilities_of_a_context_sum_to_one(spark):
    docs = spark.createDataFrame([("abcab", "x"), ("abd", "x"), ("ba", "x")], "text string, lang string")
    m = q.fit_perplexity(docs, order=2, hash_bits=28)
    seen = sorted(set(q.char_classes(["abcabd"], 2)[0].tolist()) - {q.BOS})
    for context in (ord("a"), ord("b"), ord("z")):
        keys = np.array([(context << q.CLASS_BITS) | c for c in seen])
        p = np.exp(m.logp(keys, "x")).sum()
        assert 0.7 < p < 1.0001  # the rest is what unseen characters share


def test_verdicts_reject_noise_and_repetition_and_keep_clean(spark):
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choices(["ta", "lo", "mi", "ne", "ru"], k=rnd.randint(1, 3))) for _ in range(300)]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=80)), "xx", 1) for i in range(300)]
    rows += [(1000 + i, " ".join("".join(rnd.choices("qwxzjkv#%$", k=9)) for _ in range(80)), "xx", 1) for i in range(4)]
    rows += [(2000, "same words again and again " * 30, "xx", 1), (2001, "short", "xx", 1), (2002, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, verdict int")
    kept = q.quality_filter(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {1000, 1001, 1002, 1003, 2000, 2001, 2002}
    assert len(ids) >= 295
    assert q.quality_filter(docs.where("false")).count() == 0


def test_query_covers_the_table(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF_SMALL, "documents").collect()}
    got = q.op2_quality_rules(spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        n = brute_base(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r.base_failed and r.kept)
