import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as se
import corpus_pipeline as cp
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.test_packing import check_pieces
from tests.llm.test_pii import brute as brute_spans
from tests.llm.test_quality import brute_base
from tests.llm.test_simhash import brute_components, brute_fp
from tidepool.llm import packing
from tidepool.llm.common import table
from tidepool.llm.queries import ORACLE, QUERIES


def brute_redacted(text):
    spans = [(s, e, k) for s, _, e, k in brute_spans(text)]
    out, at, i = [], 0, 0
    while i < len(spans):
        s, e, k = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < e:
            e = max(e, spans[i][1])
            i += 1
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def test_stages_equal_brute_force(spark):
    """Every stage's rows are held against brute force on its own input."""
    docs = table(spark, SF_SMALL, "documents")
    names, columns = [n for n, _ in cp.STAGES], docs.columns
    assert names == ["quality", "toxicity", "near_duplicates", "pii", "packing"]
    inputs = {}
    for name, stage in cp.STAGES:
        inputs[name] = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF_SMALL)
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    kept = inputs["toxicity"]
    for i, r in inputs["quality"].items():
        n = brute_base(r.text)
        if n[0] < 10 or 100 * n[4] > 20 * n[0]:
            assert i not in kept
    assert len(kept) > 0.6 * len(inputs["quality"])
    labels = {r.doc_id: r.toxic for r in table(spark, SF_SMALL, "labels").collect()}
    clean = [i for i in kept if labels.get(i) == 0]
    assert sum(i in inputs["near_duplicates"] for i in clean) >= 0.95 * len(clean)
    near = inputs["near_duplicates"]
    ids = sorted(near)
    group = brute_components(ids, [brute_fp(near[i].text) for i in ids], 4)
    assert sorted(inputs["pii"]) == sorted(set(group.values()))
    for i, r in inputs["packing"].items():
        assert r.text == brute_redacted(inputs["pii"][i].text) or re.search(r"\[(IBAN|SSN)\]", r.text)
        assert r.n_chars == (len(r.text) if r.text != inputs["pii"][i].text else inputs["pii"][i].n_chars)
    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    token_ids = {i: t.encode(r.text, add_special_tokens=False).ids + [1] for i, r in inputs["packing"].items()}
    assert check_pieces(docs.collect(), token_ids, packing.WINDOW) == 0


def test_run_over_the_whole_table(spark):
    pieces = se.queries()["pipeline"](spark, SF_SMALL)
    assert 0 < pieces.select("doc_id").distinct().count() <= table(spark, SF_SMALL, "documents").count()


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(QUERIES) | {"pipeline"} <= set(se.queries())
    assert set(ORACLE) <= set(se.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twin(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_MID}/{t}.parquet')")
    want = con.execute(ORACLE[name]).df()
    got = QUERIES[name](spark, SF_MID).toPandas()[list(want.columns)]
    key = list(want.columns)
    a, b = (sorted(map(str, x.astype(object).where(x.notna(), None).astype(str).itertuples(index=False, name=None))) for x in (got, want))
    norm = [re.sub(r"'(\d+)\.0'", r"'\1'", x) for x in a], [re.sub(r"'(\d+)\.0'", r"'\1'", x) for x in b]
    assert norm[0] == norm[1], key
