"""Packing, piece coding and token counts against the tokenizers' own libraries."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quern.llm import packing, pieces, tokencounts

WORDS, PIECES, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"))
SPECIAL = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", " ", "\n", "a", "The end.", "é", ","]), max_size=12).map("".join)
MIXED = SPECIAL | st.text(alphabet=st.sampled_from("abcdeéthe inons \n\t.,.!'’st日本€\x00AB12<|_>ß　\x85\x1c\r٣ ▁İΣς"), max_size=40) | st.text(max_size=30)


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS), sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BYTES)


@settings(max_examples=300, deadline=None)
@given(st.lists(MIXED, min_size=1, max_size=6))
def test_word_tokens(texts):
    from tokenizers import Tokenizer

    own = packing.WordTokens.of(WORDS)
    t = Tokenizer.from_file(WORDS)
    assert [x.tolist() for x in own.encode([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@settings(max_examples=300, deadline=None)
@given(MIXED)
def test_pieces(text):
    import sentencepiece

    own = pieces.Encoder.of(PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = own.encode(text)
    assert ids.tolist() == sp.encode(text) and own.decode(ids) == sp.decode(sp.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(MIXED, min_size=1, max_size=6))
def test_byte_tokens(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    own = tokencounts.TokenSizes.of(BYTES).encode([x.encode() for x in texts])
    assert [s.tolist() for s in own] == [[len(x) for x in t.encode(x, add_special_tokens=False).tokens] for x in texts]


def test_pieces_backtrack(library):
    own = pieces.Encoder.of(PIECES)
    for text in ("the" * 3000, "a" * 5000, " " * 777, "x  y   z ", "<s></s><0x0A>", "aaaaab" * 400):
        assert own.encode(text).tolist() == library[1].encode(text)


def test_small_tables_forget(library, monkeypatch):
    """What is kept may be dropped at any time."""
    monkeypatch.setattr("quern.llm.pieces.KEPT_CHUNKS", 4)
    monkeypatch.setattr("quern.llm.tokenruns.KEPT", 3)
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["ab", "cde", "xyz.", "q,", "hello", "World"]) for _ in range(9)) for _ in range(40)]
    enc, words = pieces.Encoder(PIECES), packing.WordTokens(WORDS)
    for t in texts:
        assert enc.encode(t).tolist() == library[1].encode(t)
        assert words.encode([t.encode()])[0].tolist() == library[0].encode(t, add_special_tokens=False).ids


def squares(sizes, capacity):
    """The packing rule, tried out in full for every piece."""
    gaps, out = [], []
    for s in sizes:
        choices = []
        for g in [*sorted({g for g in gaps if g >= s}), capacity]:
            after = list(gaps)
            if g == capacity:
                after.append(capacity - s)
            else:
                after[after.index(g)] -= s
            n = defaultdict(int)
            for x in after:
                n[x] += 0 < x < capacity
            choices.append((sum(v * v for v in n.values()), g))
        g = min(choices)[1]
        out.append(capacity - g)
        gaps = [*gaps, capacity - s] if g == capacity else [x - s if i == gaps.index(g) else x for i, x in enumerate(gaps)]
    return out, len(gaps)


def test_sum_of_squares_rule():
    rng = np.random.default_rng(5)
    for _ in range(15):
        sizes = rng.integers(1, 21, 60)
        seq, offset, gaps = packing.pack(sizes, 20)
        want, bins = squares(sizes.tolist(), 20)
        assert offset.tolist() == want and len(gaps) == bins


def held(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces_ in by.values():
        at = 0
        for o, n in sorted(pieces_):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packs_all_pieces(spark, scratch, library, hard_docs):
    made = packing.token_pieces(hard_docs, WORDS, length=64, with_ids=True)
    rows = packing.pack_pieces(made, scratch, capacity=64, group_rows=100).collect()
    held(rows, 64)
    texts = [(r.doc_id, [*library[0].encode(r.text or "", add_special_tokens=False).ids, 1]) for r in hard_docs.collect()]
    want = sorted((d is None, d or 0, n, ids[b : b + 64]) for d, ids in texts for n, b in enumerate(range(0, len(ids), 64)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.ids) for r in rows) == want
    assert all(r.length == len(r.ids) and r.start == 64 * r.piece and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4")) for r in rows)


def test_few_sequences(spark, scratch):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.choice([rng.randrange(1, 200), rng.randrange(1, 4097)])) for i in range(3000)], "doc_id long, length long").withColumn("key", F.lit("x"))
    rows = packing.pack_pieces(df, scratch, group_rows=500).collect()
    assert len(rows) == 3000 and held(rows, 4096) <= 1.02 * sum(r.length for r in rows) / 4096 + 1 and rows[0].key == "x"


def test_packing_empty(spark, scratch, no_docs):
    assert packing.pack_pieces(packing.token_pieces(no_docs, WORDS), scratch).count() == 0


def test_round_trip_of_hard_rows(spark, library, hard_docs, no_docs):
    both = pieces.decode_documents(pieces.encode_documents(hard_docs, PIECES), PIECES).collect()
    once = pieces.encode_documents(hard_docs, PIECES, decoded=True).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.decoded, r.ids)
    want = sorted((r.doc_id is None, r.doc_id or 0, library[1].decode(library[1].encode(r.text or "")), library[1].encode(r.text or "")) for r in hard_docs.collect())
    assert sorted(map(key, both)) == want == sorted(map(key, once))
    assert pieces.encode_documents(no_docs, PIECES).count() == 0


RULES = tokencounts.RULES


@pytest.mark.parametrize("rule", RULES)
def test_allot(rule):
    rng = random.Random(7)
    for _ in range(300):
        sizes = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(8))], np.int64)
        n = int(sizes.sum())
        cuts = sorted(rng.sample(range(n + 1), min(n + 1, rng.randrange(6))))
        spans = [s for s in zip(cuts, cuts[1:]) if rng.random() < 0.8]
        ends = np.cumsum(sizes)
        count, crossing, outside = tokencounts.allot(sizes, *np.array(spans, np.int64).reshape(-1, 2).T, rule)
        want, cross, out = [0.0] * len(spans), [0] * len(spans), 0.0
        for p, q in zip(ends - sizes, ends):
            share = [max(0, min(q, e) - max(p, a)) for a, e in spans]
            cross = [c + (0 < s < q - p) for c, s in zip(cross, share)]
            if rule == "split":
                want = [w + s / (q - p) for w, s in zip(want, share)]
                out += 1 - sum(share) / (q - p)
                continue
            byte = {"first": p, "last": q - 1}.get(rule)
            j = (share.index(max(share)) if any(share) else -1) if byte is None else next((i for i, (a, e) in enumerate(spans) if a <= byte < e), -1)
            if j < 0:
                out += 1
            else:
                want[j] += 1
        assert np.allclose(count, want) and crossing.tolist() == cross and abs(outside - out) < 1e-9


def test_counts_of_hard_rows(spark, library, hard_docs, no_docs):
    rows = tokencounts.token_counts(hard_docs, BYTES).collect()
    texts = {r.doc_id: r.text or "" for r in hard_docs.collect() if r.doc_id is not None}
    for d, t in texts.items():
        own = [r for r in rows if r.doc_id == d]
        copies = 2 if d == 2 else 1
        assert sum(r.n_tokens for r in own) == copies * len(library[2].encode(t, add_special_tokens=False).ids)
        assert {r.doc_tokens for r in own} == {len(library[2].encode(t, add_special_tokens=False).ids)}
        assert sorted({r.section for r in own if r.section is not None}) == list(range(len(t.split("\n")) - (t[-1:] == "\n" or not t)))
    assert tokencounts.token_counts(no_docs, BYTES).count() == 0


def test_given_sections(spark):
    docs = spark.createDataFrame([(1, "Hello world. Next one"), (2, "abc"), (3, None), (None, "x y")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 7, 0, 12), (1, 8, 10, 99), (1, 9, -5, 3), (2, 0, 5, 9), (9, 0, 0, 1), (1, None, 0, 1), (None, 0, 0, 1)], "doc_id long, section int, start long, end long")
    rows = {(r.doc_id, r.section): (r.start, r.end, r.n_tokens) for r in tokencounts.token_counts(docs, BYTES, sections=spans).collect()}
    # the span that starts first keeps shared bytes; tokens: Hello| world|.| Next| one
    assert rows[1, 9] == (0, 3, 1) and rows[1, 7] == (3, 12, 2) and rows[1, 8] == (12, 21, 2) and rows[2, None][2] == 1 and rows[3, None][2] == 0 and rows[None, None][2] == 2
    with pytest.raises(ValueError):
        tokencounts.token_counts(docs, BYTES, rule="none")
