import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tidepool.llm import quality as q
from tidepool.llm import wordlm as w
from tidepool.llm.common import table

ORDER = 3


def brute_force(docs):
    """Log perplexity of every (text, lang) over dictionaries of words."""
    grams = defaultdict(set)
    for t, lang in docs:
        own = ["<s>"] * ORDER + t.split() + ["</s>"]
        for i in range(ORDER, len(own)):
            for k in range(1, ORDER + 2):
                grams[lang, k].add(tuple(own[i - k + 1:i + 1]))
    p, out = {}, {}
    for lang in {x for _, x in docs}:
        low = None
        for k in range(1, ORDER + 1):
            a = defaultdict(int)
            for g in grams[lang, k + 1]:
                a[g[1:]] += 1
            n = [sum(v == i for v in a.values()) for i in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else None
            ds = [max(0.05, min(float(i), i - (i + 1) * y * n[i] / n[i - 1] if y is not None and n[i - 1] else d))
                  for i, d in ((1, 0.5), (2, 0.75), (3, 0.9))]

            def cut(c):
                return 0.0 if c <= 0 else min(ds[min(c, 3) - 1], c)
            kinds = defaultdict(list)
            for g, c in a.items():
                kinds[g[:-1]].append(c)
            own = {}
            for g, c in a.items():
                t, m = sum(kinds[g[:-1]]), sum(map(cut, kinds[g[:-1]]))
                pl, ql = low[g[1:]] if low else (1 / (len(a) + 1),) * 2
                lower = pl if c > 1 else ql
                left = lower if t == 1 else (max(c - 1 - cut(c - 1), 0) + (m - cut(c) + cut(c - 1)) * lower) / (t - 1)
                own[g] = ((c - cut(c) + m * pl) / t, left)
            low = own
        p[lang] = low
    for t, lang in docs:
        own = ["<s>"] * (ORDER - 1) + t.split()
        events = {tuple(own[i - ORDER + 1:i + 1]) for i in range(ORDER - 1, len(own)) if any(c.isalnum() for c in own[i])}
        out[t, lang] = -sum(math.log(p[lang][e][1]) for e in events) / len(events) if events else None
    return out


def scores(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "text string, lang string")
    k1, k2 = w.text_keys(F.col("text"), F.col("lang"))
    j = docs.withColumn("k1", k1).withColumn("k2", k2).join(w.log_perplexity(docs, **kw), ["k1", "k2"], "left")
    return {(r.text, r.lang): r.log_ppl for r in j.collect()}


def some_rows(seed, n=60):
    rnd = random.Random(seed)
    words = ["tea", "cup", "das", "ist", "\u00e9t\u00e9", "x1", "\u65e5\u672c", "|", "--"]
    return [(" ".join(rnd.choices(words, k=rnd.randint(1, 30))), rnd.choice(["en", "de", None])) for _ in range(n)]


def test_word_model_equals_brute_force(spark):
    rows = some_rows(3) + [("", "en"), ("| |", "de"), ("only once here", "fr")]
    got, want = scores(spark, rows, bucket_grams=50), brute_force(rows)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] is None if v is None else got[k] == pytest.approx(v, abs=1e-4), k


def test_copies_do_not_change_a_score(spark):
    rows = some_rows(5)
    once, again = scores(spark, rows), scores(spark, rows + rows[:20] * 5)
    assert once == pytest.approx(again, abs=1e-6)


def test_model_entries_grow_with_the_corpus(spark):
    """Words that n-grams of characters do not tell apart: the model has an entry for each word n-gram."""
    docs = table(spark, SF_MID, "documents")
    texts = {(r.text or "", r.lang) for r in docs.select("text", "lang").collect()}
    want = {(x, *e) for t, x in texts for v in [["<s>"] * ORDER + t.encode().split() + ["</s>"]]
            for e in zip(*[v[j:] for j in range(ORDER + 1)])}
    rows = docs.select("text", "lang", F.lit(0).alias("a"), F.lit(0).alias("b"))
    top = rows.mapInArrow(w._distinct(ORDER + 1), "lang string, w0 long, w1 long, w2 long, w3 long").distinct()
    assert top.count() == len(want)
    assert w.left_out(top, ORDER).count() == len({(x[0], *x[2:]) for x in want})


def junk_kind(text):
    own = text.split()
    if sum(x == "|" for x in own) > 0.1 * len(own):
        return "bars"
    if sum(len(x) > 2 and x.upper() == x != x.lower() for x in own) > 0.25 * len(own):
        return "upper case"
    return "symbols" if sum(c in "#*$%&" for c in text) > 0.08 * len(text) else "repeated"


def test_bands_reject_every_class_of_junk_and_keep_clean_rows(spark):
    labels = table(spark, SF_MID, "labels")
    docs = table(spark, SF_MID, "documents").select("doc_id", "text", "lang")
    kept = {r.doc_id for r in q.quality_filter(docs, labels=labels).select("doc_id").collect()}
    rows = docs.join(labels, "doc_id").collect()
    out = defaultdict(list)
    for r in rows:
        failed = len(r.text.split()) < 10 or q.base_counts(r.text)[4] * 5 > len(r.text.split())
        if r.quality == 0 or not failed:
            out["clean" if r.quality == 1 else junk_kind(r.text)].append(r.doc_id in kept)
    assert set(out) == {"clean", "bars", "upper case", "symbols", "repeated"}
    share = {k: sum(v) / len(v) for k, v in out.items()}
    assert share.pop("clean") >= 0.97
    assert all(v <= 0.1 for v in share.values()), share


def test_clean_rows_set_the_bands_of_their_language(spark):
    rows = [(i, "xx" if i < 1000 else "yy", float(i % 1000), i < 1000 and i % 1000 < 900) for i in range(2000)]
    scored = spark.createDataFrame(rows, "id long, lang string, ppl double, clean boolean")
    bands = {round(r._upper): r for r in q.perplexity_bands(scored, "lang", F.col("ppl"), F.col("clean"), 0.98, 8.0, 7.5).collect()}
    labelled = min(bands)
    assert labelled == pytest.approx(881, abs=3) and bands.pop(labelled)._lower == pytest.approx(0, abs=2)
    (other,) = bands.values()
    assert other._upper > 3000 and other._lower < -2000


def test_n_grams_beyond_the_folded_size_are_not_merged(spark):
    rnd = np.random.default_rng(2)
    words = list(rnd.integers(0, 2 ** 63, (3, 2_000_000), dtype=np.uint64))
    assert len(np.unique(w.gram_hash(words))) == 2_000_000
    assert len(np.unique(q.fold(words[0].view(np.int64), 0, 23))) < 1_900_000  # what the character model merges


def test_other_languages_do_not_change_a_score(spark):
    rnd = random.Random(6)
    rows = some_rows(6)
    noise = [(" ".join("".join(rnd.choices("qwxzjkv日本#", k=8)) for _ in range(200)), f"l{i}") for i in range(100)]
    alone, among = scores(spark, rows), scores(spark, rows + noise)
    assert alone == pytest.approx({k: among[k] for k in alone}, abs=1e-6)


def test_turns_do_not_change_a_score(spark):
    rows = some_rows(7) + [("", None), ("-- |", "en"), ("a\x0bb\x0cc\td", "de")]
    want = brute_force(rows)
    for turn_bytes, grams in ((1 << 30, 1000), (100, 5)):
        got = scores(spark, rows, bucket_grams=grams, turn_bytes=turn_bytes)
        for k, v in want.items():
            assert got[k] is None if v is None else got[k] == pytest.approx(v, abs=1e-4), k


def test_n_grams_travel_as_chunks_and_each_in_one_turn(spark):
    rows = [(t, lang, i, 0) for i, (t, lang) in enumerate(some_rows(8, 300))]
    docs = spark.createDataFrame(rows, "text string, lang string, k1 long, k2 long").coalesce(1)
    dealt = [docs.mapInArrow(w._chunks(3, turn, 4, True), w._CHUNK).collect() for turn in range(4)]
    assert sum(r.n for turn in dealt for r in turn) == sum(len(t.split()) + 1 for t, _, _, _ in rows)
    assert all(r.bucket % 4 == turn for turn in range(4) for r in dealt[turn])
    assert sum(map(len, dealt)) <= 3 * 4 * 3  # buckets, turns, languages


def test_word_hashes_tell_words_apart():
    rnd = random.Random(9)
    texts = ["".join(rnd.choices("ab| \t\n\u00e9\u65e5\x00", k=rnd.randint(0, 200))) for _ in range(500)] + ["x" * 100 + " " + "x" * 101, ""]
    raw = [t.encode() for t in texts]
    doc, h = w.word_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    words = [(i, x) for i, t in enumerate(raw) for x in t.split()]
    assert doc.tolist() == [i for i, _ in words]
    assert len(set(h.tolist())) == len({x for _, x in words}) == len({(x, y) for (_, x), y in zip(words, h.tolist())})
    assert [bool(y & 1) for y in h.tolist()] == [bool(x.strip(w.MARKS)) for _, x in words]


def test_a_frequent_word_is_dealt_to_several_buckets_and_scored_the_same(spark):
    rnd = random.Random(11)
    rows = [(" ".join(x for _ in range(20) for x in ("the", f"w{rnd.randrange(30)}")), "en") for _ in range(40)]
    texts = [(t, lang, i, 0) for i, (t, lang) in enumerate(rows)]
    blocks = spark.createDataFrame(texts, "text string, lang string, k1 long, k2 long").coalesce(1).mapInArrow(w._word_blocks, w._WORDS)
    often = w._often_words(blocks, 100)
    assert max(often.parts) >= 16  # "the" has 800 places, parts of 50
    places = defaultdict(int)
    for turn in range(4):
        for r in blocks.mapInArrow(w._chunks(6, turn, 4, True, often), w._CHUNK).collect():
            assert r.bucket % 4 == turn
            places[r.bucket] += r.n
    assert sum(places.values()) == 41 * 40
    assert max(places.values()) < 400  # all 800 of "the" met in one bucket
    want = brute_force(rows)
    got = scores(spark, rows, bucket_grams=100, turn_bytes=2000)
    assert all(got[k] == pytest.approx(v, abs=1e-4) for k, v in want.items())


def test_texts_are_hashed_in_pieces_and_kept_as_places_in_word_lists():
    rnd = random.Random(12)
    texts = [" ".join(rnd.choices(["a", "b", "c", "日", "|", "dd"], k=rnd.randint(0, 300))) for _ in range(200)]
    langs = [rnd.choice(["en", None]) for _ in texts]
    batch = w.pa.RecordBatch.from_arrays([w.pa.array(texts), w.pa.array(langs, w.pa.string()), *[w.pa.array(range(200))] * 2],
                                         ["text", "lang", "k1", "k2"])
    (whole,) = w._word_blocks(iter([batch]))
    before, w.PIECE_BYTES = w.PIECE_BYTES, 500
    try:
        (pieces,) = w._word_blocks(iter([batch]))
    finally:
        w.PIECE_BYTES = before
    assert whole.column(1)[0].as_py() == sum(len(t.split()) + 4 for t in texts)

    def events(block):
        out = defaultdict(int)
        for c in w._chunks(3, 0, 1, True)(iter([block])):
            for r in c.to_pylist():
                words = w._unpacked(r["words"], r["w"])
                grams = words[w._wide(r["grams"], 4 * r["m"]).reshape(4, -1)]
                docs = np.frombuffer(r["keys"], dtype=np.uint32)[w._wide(r["docs"], r["n"])]
                for d, e in zip(docs, w._wide(r["events"], r["n"])):
                    out[(int(d), r["lang"], *grams[:, e].tolist())] += 1
        return out
    assert events(whole) == events(pieces)
    assert sum(events(whole).values()) == sum(len(t.split()) + 1 for t in texts)
