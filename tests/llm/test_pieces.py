import random

import public_tokenizers
import pytest

from tidepool.llm import pieces as P


def brute(m, s):
    best, back = [0.0] + [None] * len(s), [None] * (len(s) + 1)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - m.longest), j):
            f = m.pieces.get(s[i:j])
            if f and (best[j] is None or best[i] + f[1] > best[j]):
                best[j], back[j] = best[i] + f[1], (i, (f[0],))
        if s[j - 1] not in m.pieces:
            v = best[j - 1] + m.unknown
            if best[j] is None or v > best[j]:
                best[j], back[j] = v, (j - 1, tuple(m.byte_ids[b] for b in s[j - 1].encode()))
    out, j = [], len(s)
    while j:
        i, ids = back[j]
        out, j = list(ids) + out, i
    return out


@pytest.fixture(scope="module")
def model():
    return P.PieceModel.load(public_tokenizers.path(P.MODEL))


def texts():
    rnd = random.Random(8)
    chars = list("abcdeth  \n\t.,é日😀▁")
    return ["", " ", "  a  b ", "a" * 900, "日本語😀 x", "x▁▁ y", "ab" * 300, "the cat sat on the mat"] + [
        "".join(rnd.choices(chars, k=rnd.randint(0, 200))) for _ in range(200)]


def test_equals_plain_viterbi_and_streams_in_bounded_memory(model):
    enc = P.PieceEncoder(model)
    for t in texts():
        marked = "▁" + t.replace(" ", "▁") if t else ""
        want = brute(model, marked)
        assert enc.encode(t).tolist() == want
        v = P.StreamingViterbi(model)
        early = list(v.push(marked))
        assert early + list(v.finish()) == want
        assert enc.decode(want) == t.replace("▁", " ")
    v = P.StreamingViterbi(model)
    early = list(v.push("the cat sat ".replace(" ", "▁") * 3000))
    assert len(early) > 0 and v.held < 200 and len(v.window) <= model.longest


def test_a_model_that_does_not_cut_at_marks(model):
    other = P.PieceModel({"a": (0, -1.0), "▁": (1, -1.0), "a▁b": (2, -1.5), "b": (3, -1.0)}, [9] * 256, [b"a", b" ", b"a b", b"b"])
    assert not other.cuts_at_marks
    assert P.PieceEncoder(other).encode("a b").tolist() == [1, 2]


def test_round_trip_in_spark(spark, model):
    rows = [(i, t) for i, t in enumerate(texts())] + [(9000, None), (9001, "a b"), (9001, "a b")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    enc = P.encode_pieces(docs)
    back = sorted((r.id, r.text) for r in P.decode_pieces(enc).collect())
    assert back == sorted((i, (t or "").replace("▁", " ")) for i, t in rows)
    assert all(r.round_trip == ("▁" not in (dict(rows)[r.id] or "")) for r in enc.collect())
    assert P.encode_pieces(docs.where("false")).count() == 0


def test_short_runs_go_through_the_stream_too(model, monkeypatch):
    seen, push = [], P.StreamingViterbi.push

    def counted(self, chars):
        seen.append(chars)
        return push(self, chars)
    monkeypatch.setattr(P.StreamingViterbi, "push", counted)
    P.PieceEncoder(model).encode("the cat the dog")
    assert seen == ["▁the", "▁cat", "▁dog"]
