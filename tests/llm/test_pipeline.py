"""All five stages of the pipeline against a whole expectation put together from brute forces."""

import collections
import hashlib

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from millrace.llm import bpe, mixing, pii, quality
from oracle import connect
from test_llm_queries import SMALL, WORD, brute_components


def redacted(text, spans):
    """Covered runs replaced by the kind of the span that starts first."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def expected(spark):
    """(doc_id, text) after each stage, and the digests of the last one, of sf0.001."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    stages = []
    # Quality: the query's SQL.
    sql = connect(SMALL).sql(quality.ORACLE["op9_quality"]).df()
    keep = set(sql[sql["kept"].astype(bool)]["doc_id"])
    rows = [(d, r["text"]) for d, r in docs.items() if d in keep]
    stages.append(rows)
    # Near duplicates: all pairs of shingle sets.
    parts = brute_components(rows, 5)
    rows = [(d, t) for d, t in rows if parts[d][1] == d and parts[d][0]]
    stages.append(rows)
    # Personal data: the network reads each text by itself.
    net = pii.trained(spark.createDataFrame(rows, "doc_id long, text string"))
    done = []
    for d, t in rows:
        base = pii.base_spans(t)
        spans = base + pii.added_spans(net, [t], [base])[0]
        done.append((d, redacted(t, sorted(spans, key=lambda s: (s[1], pii.ALL_KINDS.index(s[0]))))))
    stages.append(done)
    # Mixing: the query's SQL on what is left, then copies and cuts by hand.
    con = duckdb.connect()
    con.register("left_", pd.DataFrame([(d, t, docs[d]["source"]) for d, t in done], columns=["doc_id", "text", "source"]))
    con.execute("CREATE TABLE documents AS SELECT * FROM left_")
    taken = dict(con.sql(mixing.ORACLE["op7_mixing"]).df().set_index("doc_id")["taken"])
    rows = []
    for d, t in done:
        words = WORD.findall(t)
        if words:
            full, part = divmod(int(taken[d]), len(words))
            rows += [(d, t)] * full + ([(d, " ".join(words[:part]))] if part else [])
    stages.append(rows)
    # Encoding: the tokenizer itself.
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.tokenizer_path())
    tok.no_padding()
    tok.no_truncation()
    last = collections.Counter()
    for d, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids
        last[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    return stages, last


def test_every_stage_equals_brute_force(spark, expected):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for want, (name, stage) in zip(expected[0], corpus_pipeline.STAGES[:-1], strict=True):
        out = stage(spark, docs, SMALL)
        assert out.columns == columns, name
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        assert collections.Counter((r["doc_id"], r["text"]) for r in docs.collect()) == collections.Counter(want), name


def test_run_equals_brute_force(spark, expected):
    assert collections.Counter(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == expected[1]
    assert sum(expected[1].values()) > 100
