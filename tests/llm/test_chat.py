import random

from tidepool.llm import chat


def brute(rows):
    out = []
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is None, turn or 0, (role or "unknown").replace("<|", "< |"),
                                        (text or "").replace("<|", "< |"), turn))
    for c, turns in convs.items():
        for speaker in {t[2] for t in turns} - {"system"}:
            at = 0
            for _, _, role, body, turn in sorted(turns, key=lambda t: t[:4]):
                head = "<|assistant|>\n" if role == speaker else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
                seg = head + body + "<|end|>\n"
                own = role == speaker
                out.append((c, speaker, turn, role, seg, at, at + len(seg), at + len(head) if own else None, at + len(seg) if own else None))
                at += len(seg)
    return sorted(out, key=str)


def test_segments_equal_brute_force(spark):
    rnd = random.Random(6)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "Ann", "Bob"]), rnd.choice(["hi", "", None, "é😀 <|end|>", "long " * 50]))
            for c in range(12) for t in range(rnd.randint(1, 9))]
    rows += [(50, t, ["a", "b"][t % 2], f"turn {t}") for t in range(0, 5000, 3)]  # several blocks of one conversation
    rows += [(60, 0, "system", "alone"), (61, None, None, None), (61, 1, "user", "x"), (62, 0, "user", "same"), (62, 0, "user", "same"),
             (None, 0, "user", "n"), (None, 1, "assistant", "m")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, speaker string")
    got = chat.perspectives(df)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert "Python" not in got._jdf.queryExecution().toString()
    assert chat.perspectives(df.where("false")).count() == 0


def test_segments_join_to_the_rendering(spark):
    df = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "Ann", "hello"), (1, 2, "Bob", "hi Ann")],
                               "conv_id long, turn long, role string, text string")
    rows = chat.perspectives(df).where("speaker = 'Bob'").orderBy("start").collect()
    text = "".join(r.segment for r in rows)
    assert text == "<|system|>\nbe kind<|end|>\n<|user name=Ann|>\nhello<|end|>\n<|assistant|>\nhi Ann<|end|>\n"
    assert [text[r.mask_start:r.mask_end] for r in rows if r.mask_start is not None] == ["hi Ann<|end|>\n"]
