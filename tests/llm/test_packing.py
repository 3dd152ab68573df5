import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidepool.llm import packing


def test_encoder_equals_the_tokenizer():
    path = public_tokenizers.path(packing.TOKENIZER)
    plain, mine = Tokenizer.from_file(path), packing.Encoder(path)
    chars = list("abcdeEZzéÉßÿ÷×ªµ'’sStTreRE.,!?_-~`^*#$&|<>@0123 \n\t\r\x0b\x1c\x85\xa0") + [
        "́", "İ", "Σ", "ς", "日", "😀", "<|endoftext|>", "<|", "ﬁ", "Å", "​", "̀"]
    rnd = random.Random(3)
    texts = ["".join(rnd.choices(chars, k=rnd.randint(0, 60))) for _ in range(3000)] + ["a" * 10_000, "word " * 10_000]
    for _ in range(2):
        for want, got in zip(plain.encode_batch(texts, add_special_tokens=False), mine.encode(texts)):
            assert want.ids == got.tolist()


def _brute_level(count, size, n):
    """The level whose choice gives the smallest sum of squares (0: a new window), fullest first."""
    def total(level):
        c = dict(count)
        if level:
            c[level] -= 1
        if level + n < size:
            c[level + n] = c.get(level + n, 0) + 1
        return sum(v * v for v in c.values())
    choices = [0] + [h for h in range(1, size - n + 1) if count.get(h)]
    return min(choices, key=lambda h: (total(h), -h))


def test_levels_equal_brute_force():
    rnd, size = random.Random(1), 20
    p, count = packing.SumOfSquares(size), defaultdict(int)
    for i in range(600):
        n = rnd.randint(1, size - 1)
        level = _brute_level(count, size, n)
        assert p.level_for(n) == level
        list(p.add(i, np.zeros(n, dtype=np.uint32)))
        if level:
            count[level] -= 1
        if level + n < size:
            count[level + n] += 1
    assert {h: int(c) for h, c in enumerate(p.count) if c} == {h: c for h, c in count.items() if c}


def check_pieces(rows, ids_of, size):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == ids_of.keys()
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_pieces_hold_every_id_once_without_padding(spark):
    rnd = random.Random(2)
    texts = [None, "", " ", "the cat", "x" * 30_000] + [" ".join(rnd.choices(["tea", "oneword", "ünd", "12", "a,b"], k=rnd.randint(0, 900)))
                                                   for _ in range(120)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, offset int")
    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in enumerate(texts)}
    for parts in (1, 7):
        rows = packing.pack_documents(docs.repartition(parts), size=256, with_ids=True).collect()
        assert check_pieces(rows, ids, 256) == 0
        assert all(r.ids == ids[r.doc_id][r.start:r.start + r.length] for r in rows)
    assert packing.pack_documents(docs.where("false")).count() == 0
    twice = packing.pack_documents(docs.limit(4).union(docs.limit(4)))
    assert sum(r.length for r in twice.collect()) == 2 * sum(len(ids[i]) for i in range(4))
    nulls = spark.createDataFrame([(None, "a"), (2 ** 62 + 1, "b")], "doc_id long, text string")
    assert {r.doc_id for r in packing.pack_documents(nulls).collect()} == {None, 2 ** 62 + 1}


def test_words_of_plain_letters_pass_the_model_alone():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path(packing.TOKENIZER)
    enc, whole = packing.Encoder(path), Tokenizer.from_file(path)
    assert enc.plain is not None
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(1, 70))) for _ in range(3000)]
    words += [w[:4] + rnd.choice(["", ".", "?!", "-", ",a", "'s", "é", "\u0131", "K", "7", "\u00b5"]) for w in words]
    words += ["", ".", "'", "<|endoftext|>", "a'", "'a", "\u00e9\u0301.", "\u017f"]
    for got, w in zip(enc.encode(words), words):
        assert got.tolist() == whole.encode(w, add_special_tokens=False).ids, w


def test_a_failed_group_leaves_no_empty_ids(monkeypatch):
    import pytest
    enc = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    want = enc.encode(["the cat sat."])[0].tolist()
    monkeypatch.setattr(enc, "_learn", lambda chunks: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        enc.encode(["a new word"])
    monkeypatch.undo()
    assert enc.encode(["the cat sat.", "a new word"])[0].tolist() == want
    assert len(enc.encode(["a new word"])[0]) == 3


def test_each_chunk_is_looked_up_once(monkeypatch):
    class Counted(packing.Chunks):
        looked = 0

        def __getitem__(self, chunk):
            Counted.looked += 1
            return super().__getitem__(chunk)
    enc = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    enc.encode(["one two three"])
    known = Counted()
    known.update(enc.known)
    enc.known = known
    enc.encode(["one two three one"])
    assert Counted.looked == 4 and not known.new
