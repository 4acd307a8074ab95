"""The corpus pipeline against a brute-force version, and its stages on odd rows."""

import hashlib
import sys

import duckdb
import pandas as pd
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from plinth.llm import bpe, mixing, quality_rules
from tests.conftest import ROOT
from tests.llm.conftest import ordered
from tests.llm.test_models import brute_components, brute_fingerprint
from tests.llm.test_native import brute_pii

sys.path.insert(0, ROOT)


def brute(sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    con = duckdb.connect()

    def ask(sql, table):
        con.register("documents", table)
        return con.execute(sql).fetch_df()

    kept = ask(quality_rules.SQL, docs)
    docs = docs[docs.doc_id.isin(kept[kept.kept].doc_id)]
    fps = [(d, brute_fingerprint(t.encode())) for d, t in zip(docs.doc_id, docs.text, strict=True)]
    docs = docs[docs.doc_id == brute_components(fps)].copy()

    def redact(text):
        found = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in brute_pii(text)))
        out, at = "", 0
        for s, e, k in found:
            if s >= at:
                out += text[at:s] + f"[{k.upper()}]"
            at = max(at, e)
        return out + text[at:]

    docs["text"] = docs.text.map(redact)
    taken = ask(mixing.SQL, docs).set_index("doc_id")
    own = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    out = []
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        ids = own.encode_ordinary(t)
        row = (d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        out += [row] * (int(taken.taken[d]) // max(1, int(taken["size"][d])))
    return out


def test_pipeline(spark, sf_dir):
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert ordered(got) == ordered(brute(sf_dir)) and len(got) > 100


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_tables(spark, odd, empty, sf_dir, k):
    stage = corpus_pipeline.STAGES[k][1]
    last = k == len(corpus_pipeline.STAGES) - 1
    got = stage(spark, odd, sf_dir)
    assert got.count() and (last or got.columns == odd.columns)
    assert stage(spark, empty, sf_dir).count() == 0


def test_stages_do_not_change_their_input(spark, odd, sf_dir):
    for name, stage in corpus_pipeline.STAGES[:2]:
        rows = {tuple(r) for r in odd.collect()}
        assert {tuple(r) for r in stage(spark, odd, sf_dir).collect()} <= rows, name
