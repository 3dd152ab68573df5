import hashlib
import random
import re

from tests.conftest import SF_SMALL
from pyspark.sql import functions as F
from tidepool.llm import pii
from tidepool.llm.common import table


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def brute(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


HARD = [None, "", "a@b.c_d@e.f", "x" * 50_000, "1" * 50_000, "1 " * 30_000, "a.b@c.d.e@f.g, +1 (555) 123-4567 +49 170 1234567.",
        "1.2.3.4.5.6.7.8 0255.1.1.000000001 256.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111é", "4111 1111 1111 1111.",
        "@" * 20_000, "a@" * 5000, "a@b." * 5000, "+1" * 5000, "😀😀 x@y.zz 😀 10.0.0.1", "99999999999.1.1.1",
        "+12345678901234567890 +1234567890", "4111111111111111 +4111111111111111"]


def base(df):
    found = df.select("doc_id", F.transform(F.filter("f", lambda s: s["rank"] < 4), lambda s: F.struct(
        s["start"], s["rank"], s["end"], s["kind"])).alias("f"))
    return {r.doc_id: [tuple(s) for s in r.f] for r in found.collect()}


def test_base_spans_equal_brute_force(spark):
    rnd = random.Random(2)
    texts = HARD + ["".join(rnd.choices(list("aZ09.@+- ()_%é1234"), k=rnd.randint(0, 80))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, email string")
    got = base(pii.pii_spans(df, "f"))
    for i, t in enumerate(texts):
        assert got[i] == brute(t or ""), t
    assert pii.pii_spans(df.where("false"), "f").count() == 0


def test_checksums_and_context_decide_on_further_kinds(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00.", "IBAN DE88 3704 0044 0532 0130 00.", "GB82WEST12345698765432",
             "SSN 123-45-6789", "part 123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {s.kind: s.score for s in r.f} for r in pii.pii_spans(df, "f").collect()}
    assert set(got[0]) == {"iban"} and got[1] == {} and set(got[2]) == {"iban"}
    assert set(got[3]) == {"ssn"} and got[4] == {}
    assert got[0]["iban"] > got[2]["iban"]  # a context word raises the score


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a@b.cd and 10.0.0.1!", 20, 7), (2, "none", 4, 7), (3, None, None, 7),
                                (4, "+4111111111111111", 17, 7), (5, "😀 x@y.zz", 8, 7)],
                               "doc_id long, text string, n_chars long, spans int")
    out = pii.redact(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("[EMAIL] and [IP]!", 17), 2: ("none", 4), 3: (None, None), 4: ("+[CARD]", 7), 5: ("😀 [EMAIL]", 9)}


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF_SMALL, "documents").collect()}
    got = pii.op5_pii(spark, SF_SMALL)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == i for x in want) for i in range(4)]
