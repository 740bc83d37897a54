"""Analysis, stemming, scoring and codecs against hand-made cases."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quern.functions import codecs
from quern.functions.analysis import STOPWORDS, elapsed, remove_stopwords, tokens_of, truncated
from quern.functions.stemmer import stem, vocabulary

TOKENS = {
    "See https://a.b/c?d=1 now": ["see", "now"],
    "HTTP://A.B x": ["http", "a", "b", "x"],
    "a<b>c</b> d": ["ac", "d"],
    "x < y and z > w": ["x", "w"],
    "don't_stop": ["don", "t", "stop"],
    "café": ["caf"],
    "": [],
    " \t\n ": [],
    "!?": [],
    None: [],
}
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled",
    "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss",
    "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc",
    "digitizer": "digit", "radicalli": "radic", "differentli": "differ", "vileli": "vile", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal",
    "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic",
    "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow",
    "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend",
    "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "yes": "ye", "say": "sai", "by": "by", "youth": "youth", "as": "a",
}


def test_tokens(spark):
    rows = spark.createDataFrame([(t,) for t in TOKENS], "text string")
    assert {r.text: r.t for r in rows.select("text", tokens_of(F.col("text")).alias("t")).collect()} == TOKENS


def test_stopwords_keep_repeats(spark):
    df = spark.createDataFrame([(["the", "cat", "the", "cat", "of"],), ([],)], "t array<string>")
    assert [r.t for r in df.select(remove_stopwords(F.col("t"), STOPWORDS).alias("t")).collect()] == [["cat", "cat"], []]
    assert df.select(remove_stopwords(F.col("t"), ()).alias("t")).first().t[0] == "the"


def test_stems(spark):
    df = spark.createDataFrame([(w,) for w in STEMS], "w string")
    got = {r.w: r.s for r in stem(df, "w", "s").collect()}
    assert got == STEMS
    assert {r.w: r.s for r in vocabulary(df.unionAll(df), "w", "s").filter("s <> 'x'").collect()} == STEMS


def test_stems_beside_clashing_columns(spark):
    df = spark.createDataFrame([("hopping", "a", "b", "c", 1), (None, "a", "b", "c", 2), ("", None, None, None, 3)], "word string, w string, stem_step string, s string, `x ``y` int")
    out = stem(df, "word", "S")
    assert sorted(out.columns) == sorted(["word", "w", "stem_step", "x `y", "S"])
    assert {(r.word, r.w, r.stem_step, r["x `y"], r.S) for r in out.collect()} == {("hopping", "a", "b", 1, "hop"), (None, "a", "b", 2, None), ("", None, None, 3, "")}
    assert stem(df.limit(0), "word", "s").count() == 0 and [r.s for r in stem(df.filter("word = 'hopping'").select("word", "w"), "word", "s").collect()] == ["hop"]
    with pytest.raises(ValueError):
        vocabulary(df, "word", "word")


def test_small_functions(spark):
    row = spark.createDataFrame([("a" * 30, 3661)], "t string, s long").select(truncated(F.col("t")).alias("t"), elapsed(F.col("s")).alias("e")).first()
    assert row.t == "a" * 20 and row.e == "01:01:01"


VECTOR = [1, 1, 2, 1, 35, 204, 30531, 1]


def test_codec_vectors():
    assert codecs.vbyte_bytes(np.array(VECTOR)).hex() == "0101020123cc01c3ee0101"
    assert len(codecs.unary_bytes(np.array(VECTOR))) == 3847
    assert codecs.unary_bytes(np.array([1, 2, 3])).hex() == "5800"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 2000), max_size=40), st.lists(st.integers(1, 2**40), max_size=40))
def test_codec_round_trips(small, large):
    raw = codecs.unary_bytes(np.array(small, np.int64))
    assert codecs.unary_values(raw, len(small)).tolist() == small
    assert len(raw) == -(-sum(small) // 8) + (1 if sum(small) % 8 else 0)
    raw = codecs.vbyte_bytes(np.array(large, np.int64))
    assert codecs.vbyte_values(raw).tolist() == large
    assert len(raw) == sum((x.bit_length() + 6) // 7 for x in large)


def test_codecs_in_frames(spark):
    rows = [([random.randrange(1, 500) for _ in range(n)],) for n in (0, 1, 7, 100)] + [(None,)]
    df = spark.createDataFrame(rows, "v array<long>")
    out = df.select("v", codecs.vbyte_decode(codecs.vbyte_encode("v")).alias("a"), codecs.unary_decode(codecs.unary_encode("v"), F.size("v")).alias("b")).collect()
    assert all((r.a or []) == (r.v or []) and (r.b or []) == (r.v or []) for r in out)
    sizes = spark.createDataFrame([(0,), (1,), (127,), (128,), (2**35,)], "n long").select(codecs.vbyte_size(F.col("n")).alias("s")).collect()
    assert [r.s for r in sizes] == [0, 1, 1, 2, 6]


def test_scores_by_hand(spark):
    from quern.functions import scoring

    row = spark.range(1).select(
        scoring.bm25(F.lit(1), F.lit(5), F.lit(0.30103), F.lit(4), F.lit(14.0)).alias("b"), scoring.tfidf(F.lit(10), F.lit(2.0)).alias("t"), scoring.idf(F.lit(4), F.lit(2)).alias("i")
    ).first()
    assert math.isclose(row.b, 0.30103 / (1.2 * (0.25 + 0.75 * 5 / 3.5) + 1)) and row.t == 4.0 and math.isclose(row.i, math.log10(2))


@pytest.mark.parametrize("words", [("x",), ()])
def test_config_stopwords(words):
    from quern.operators.index import IndexConfig

    assert IndexConfig(stopwords=words).removed == ()
    assert IndexConfig(stopwords_and_stemming=True, stopwords=words).removed == words
    with pytest.raises(ValueError):
        IndexConfig(skip_threshold=0)
