"""Every registered query of this part on the test tables: against its SQL, or against the libraries and plain rules."""

import glob
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from quern.llm import queries as own


def plain(v):
    if pd.isna(v):
        return None
    return int(v) if isinstance(v, float | np.floating) and float(v).is_integer() else v


def rows_of(df):
    return sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_against_sql(spark, sf_dir, duck, name):
    got, want = own.queries()[name](spark, sf_dir).toPandas(), duck.sql(own.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_op3(spark, sf_dir, texts):
    out = {r.doc_id: r for r in own.queries()["op3_quality_classifier"](spark, sf_dir).collect()}
    assert set(out) == set(texts)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in out.items())


def test_op3_held_out_accuracy(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")  # the smallest table holds out 19 labels only
    out = {r.doc_id: r for r in own.queries()["op3_quality_classifier"](spark, larger).collect()}
    judged = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{larger}/labels.parquet").collect() if r.quality is not None and r.doc_id in out and out[r.doc_id].held_out]
    print(len(judged), np.mean([out[i].predicted == q for i, q in judged]))
    assert len(judged) > 50 and np.mean([out[i].predicted == q for i, q in judged]) >= 0.9


def test_op4(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = own.queries()["op4_best_fit_packing"](spark, sf_dir).collect()
    want = {}
    for i, t in texts.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        for n, b in enumerate(range(0, len(ids), 4096)):
            want[i, n] = (b, len(ids[b : b + 4096]), zlib.crc32(np.array(ids[b : b + 4096], "<u4")))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(by) <= 1.02 * sum(r.length for r in rows) / 4096 + 1


def test_op5(spark, sf_dir, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in own.queries()["op5_sentencepiece"](spark, sf_dir).collect():
        ids = sp.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_op6(spark, sf_dir, texts):
    from test_licenses_passages import flagged

    rows = own.queries()["op6_substring_dedup"](spark, sf_dir).collect()
    assert flagged(texts.items()) <= {r.doc_id for r in rows}
    for r in rows:
        a = texts[r.doc_id].encode()[r.start : r.end].decode().split()
        assert r.first_doc_id < r.doc_id and len(a) == r.n_words >= 50 and r.equal_words >= 0.8 * r.n_words
        assert r.equal_words <= len(texts[r.first_doc_id].encode()[r.first_start : r.first_end].decode().split())


def test_op9(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    tok, totals = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for r in own.queries()["op9_token_counts"](spark, sf_dir).collect():
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.n_tokens
    assert totals == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_op10(spark, sf_dir, duck):
    from quern.llm.urls import RULES

    urls = dict(duck.sql("SELECT page_id, url FROM pages").fetchall())
    for r in own.queries()["op10_url_filter"](spark, sf_dir).collect():
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [x for x in RULES for h, p in [x.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r["rule"]) == (host, path, rule) and r.verdict == RULES.get(rule, r.verdict) and r.verdict in ("allow", "block")
