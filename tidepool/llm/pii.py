"""Personal data: regular expressions propose spans, validators confirm, context adjusts a score.

Built from SQL functions only.  For each kind, ``regexp_extract_all`` gives the
leftmost non-overlapping matches and ``split`` the gaps between them, so running
sums of their lengths are the spans' places (code points, end exclusive).

The patterns are written so that they run in linear time on any text and cannot
overflow the regex engine's stack: repeats that cannot give back are possessive, and
a match may begin only at the start of a run (or where the last match ended), which
is where the leftmost match of the plain pattern begins.  Card matches of fewer than
14 digits, which are dropped anyway, are not matched at all.

Kinds: ``email``, ``ip`` (parts at most 255), ``card`` (14 to 19 digits, Luhn), ``phone``
(10 to 15 digits), which stand on their own, and ``iban`` (mod-97) and ``ssn``, which
stand when their score reaches ``threshold``.  A score is the kind's prior, plus
``CONTEXT_BONUS`` if a context word of the kind is among the ``CONTEXT_CHARS`` characters
before the span; a passed checksum is part of the prior.

Defined cases: NULL text is empty (no spans; redaction keeps it NULL); spans of
different kinds may overlap and are all reported, redaction merges them; repeated
rows are scanned row by row; an empty table gives an empty result; other columns are
passed through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import fresh, table, text_of

LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: Score of a valid match of each kind before its context is looked at.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
CONTEXT = {
    "email": r"\b(e-?mail|contact|mailto)\b",
    "ip": r"\b(ip|host|server|address)\b",
    "card": r"\b(card|credit|visa|mastercard|amex|payment)\b",
    "phone": r"\b(phone|tel|call|mobile|fax|whatsapp)\b",
    "iban": r"\b(iban|bank|account|konto|cuenta|compte)\b",
    "ssn": r"\b(ssn|social security|taxpayer|tax id)\b",
}
CONTEXT_BONUS = 0.3
CONTEXT_CHARS = 40


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = 2 * d
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i))
    return (n > 0) & (total % 10 == 0)


def mod97(s: Column) -> Column:
    """Whether an IBAN (spaces ignored) has remainder 1."""
    compact = F.replace(s, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))

    def step(a: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c <= 57, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def valid(kind: str, m: Column) -> Column:
    """Whether a match of the kind's pattern passes its validator."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(F.lit("0"), p)) <= 3) & \
            F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        d = digits_of(m)
        return F.length(d).between(14, 19) & luhn(d)
    if kind == "phone":
        return F.length(digits_of(m)).between(10, 15)
    if kind == "iban":
        return mod97(m)
    return F.lit(True)


def _span(kind: str, start: Column, end: Column, score: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"),
                    F.lit(kind).alias("kind"), score.alias("score"))


def kind_spans(text: Column, kind: str) -> Column:
    """Array of the kind's valid spans in ``text`` (not NULL)."""
    pattern = F.lit(PATTERNS[kind])
    pieces = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"),
                          F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"))
    span = "start:int,rank:int,end:int,kind:string,score:double"
    none = F.from_json(F.lit("[]"), f"array<struct<{span}>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        before = F.greatest(start - CONTEXT_CHARS, F.lit(0))
        near = F.lower(F.substring(text, before + 1, start - before))
        score = F.lit(PRIOR[kind]) + F.when(near.rlike(CONTEXT[kind]), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        found = F.when(x["match"].isNotNull() & valid(kind, x["match"]),
                       F.concat(acc["found"], F.array(_span(kind, start, end, score)))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))
    hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    some = hint.get(kind, F.rlike(text, pattern))
    return F.when(some, F.aggregate(pieces, zero, step, lambda acc: acc["found"])).otherwise(none)


def pii_spans(docs: DataFrame, out_col: str, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with an array of spans (start, rank, end, kind, score) in order of start, then kind."""
    t, *found = fresh(docs, "t", *KINDS)
    d = docs.withColumn(t, text_of(F.col(f"`{text_col}`")))
    d = d.withColumns({c: kind_spans(F.col(t), k) for c, k in zip(found, KINDS)})
    scored = [F.col(c) if k in BASE_KINDS else F.filter(c, lambda s: s["score"] >= threshold)
              for c, k in zip(found, KINDS)]
    return d.withColumn(out_col, F.array_sort(F.concat(*scored))).drop(t, *found)


def digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span's characters replaced by its kind in brackets.

    Overlapping spans become one, named after the first.  ``length_col``, if there is one, gets
    the new text's length in code points where the text changed.
    """
    s, merged, text = fresh(docs, "spans", "merged", "text")
    d = pii_spans(docs, s, text_col, threshold)
    original = F.col(f"`{text_col}`")

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.struct(last["start"].alias("start"), last["rank"].alias("rank"),
                         F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"),
                         last["score"].alias("score"))
        return F.when(F.size(acc) == 0, F.array(x)).when(
            x["start"] < last["end"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))
        ).otherwise(F.concat(acc, F.array(x)))
    d = d.withColumn(merged, F.aggregate(s, F.slice(F.col(s), 1, 0), merge))
    m = F.col(merged)

    def piece(x: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(m, i - 1)["end"])
        return F.concat(F.substring(original, begin + 1, x["start"] - begin), F.lit("["), F.upper(x["kind"]), F.lit("]"))
    tail = F.substring(original, F.element_at(m, -1)["end"] + 1, F.length(original))
    d = d.withColumn(text, F.when(F.size(m) == 0, original).otherwise(
        F.concat(F.array_join(F.transform(m, piece), ""), tail)))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col(text).alias(c))
        elif c == length_col:
            out.append(F.when(F.size(m) > 0, F.length(text).cast(docs.schema[c].dataType))
                       .otherwise(F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return d.select(*out)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "found").select("doc_id", "found")
    base = F.filter("found", lambda s: s["rank"] < len(BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in BASE_KINDS]
    return d.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"),
                    digest(F.col("found")).alias("spans"))
