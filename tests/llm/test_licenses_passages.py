"""License scans and repeated passages against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from quern.llm.licenses import PHRASES, TEMPLATES, Join, scan, stride_of, words_of
from quern.llm.substrings import PASSAGE, align, chain, needed, remove_passages, repeated_passages

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_scan(text):
    words = WORD.findall(low(text))
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    base = sorted({label for _, label in places})
    best, own, stride = 0.0, set(), stride_of(TEMPLATES)
    for at in range(0, max(len(words), 1), stride):
        for label, t in TEMPLATES:
            want = {x.decode() for x in words_of(t)}
            c = len(want & set(words[at : at + 2 * stride])) / len(want)
            if c >= 0.8 - 1e-12:
                best, own = max(best, c), own | {label}
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *own})), 1.0 if base else best


def license_texts():
    rng = random.Random(3)
    filler = ["lorem", "software", "the", "of", "license", "mit", "gpl", "under", "cc", "public", "general", "é", "apache", "Licensed", "4", "0"]
    out = [t for _, t in TEMPLATES] + ["MIT License, mit\nlicense; MIT-LICENSE", "general public license" * 2, "", None, "\n\n", "licensed under cc by nc 4", "Licensed UNDER cc-by nc"]
    for _ in range(150):
        w = [rng.choice(filler) for _ in range(rng.choice([5, 40, 200]))]
        k = rng.randrange(len(w))
        w[k:k] = [x for x in rng.choice(TEMPLATES)[1].split() if rng.random() < 0.9]
        out.append(rng.choice([" ", " - ", "\n" if rng.random() < 0.1 else " "]).join(w))
    return out


def test_scan_against_brute_force(spark):
    texts = license_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit("x"))
    got = {r.doc_id: r for r in scan(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        have = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
        assert have[:6] == brute_scan(t)[:6] and math.isclose(have[6], brute_scan(t)[6]), (t, have, brute_scan(t))


def test_scan_hard_rows(spark, hard_docs, no_docs):
    rows = scan(hard_docs).collect()
    assert len(rows) == hard_docs.count() and all(r.score == 0 and r.labels == "" and r.first_word is None for r in rows)
    assert scan(no_docs).count() == 0


def test_wrapped_notices(spark):
    """Every template is found when it is hard-wrapped, or deep in a text, and a long one of one's own has blocks that hold it."""
    rng = random.Random(8)
    rows = []
    for n, (_, t) in enumerate(TEMPLATES):
        w = t.split()
        wrapped = "\n".join(" ".join(w[i : i + 5]) for i in range(0, len(w), 5))
        rows += [(2 * n, wrapped), (2 * n + 1, " ".join(words(rng, 77 + n, "x") + [wrapped] + words(rng, 50, "y")))]
    got = {r.doc_id: r.labels.split(",") for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(TEMPLATES[i // 2][0] in labels for i, labels in got.items()) and "bsd" in got[2 * 7]
    long = [("own", " ".join(f"t{i}" for i in range(90)))]
    rows = [(i, " ".join(words(rng, i, "x") + long[0][1].split())) for i in range(0, 200, 7)]
    assert all(r.labels == "own" and r.score == 1 for r in scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=long).collect())
    assert all(r.labels == "" for r in scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=[], phrases={}).collect())


def test_prefix_filter_is_exact():
    rng = random.Random(1)
    vocab = [f"t{i}" for i in range(30)]
    for _ in range(50):
        templates = [(str(i), " ".join(rng.sample(vocab, rng.randrange(1, 9)))) for i in range(5)]
        join = Join(templates, {w.encode(): rng.randrange(100) for w in vocab}, 0.7)
        block = [rng.choice(vocab) for _ in range(12)]
        from quern.llm.licenses import _hash

        ranks = join.rank(_hash([w.encode() for w in block]))
        want = {i for i, (_, t) in enumerate(templates) if len(set(t.split()) & set(block)) >= 0.7 * len(t.split()) - 1e-9}
        assert {t for t, _ in join.find(ranks, len(block))} == want


# ---- passages


def words(rng, n, tag=""):
    return [f"{tag}{rng.randrange(5000)}" for _ in range(n)]


def flagged(rows, run=50):
    """Ids whose text has a run of words that a smaller id has."""
    seen, out = {}, set()
    for i, t in sorted(rows):
        w = low(t).split()
        grams = [tuple(w[j : j + run]) for j in range(len(w) - run + 1)]
        if any(seen.get(g, i) != i for g in grams):
            out.add(i)
        for g in grams:
            seen.setdefault(g, i)
    return out


def test_equal_passages_are_found_and_cut(spark, scratch):
    rng = random.Random(9)
    shared = [words(rng, n, "p") for n in (51, 60, 90, 300)]
    rows = []
    for i in range(120):
        parts = [words(rng, rng.randrange(1, 60), f"d{i}_") for _ in range(5)]
        for k, p in enumerate(rng.sample(shared, 4)):  # side by side: cutting one out of the middle of another would join its ends
            if rng.random() < 0.25:
                parts[k] = parts[k] + p
        rows.append((i * 3, rng.choice([" ", "  ", "\n"]).join(w for x in parts for w in x)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeated_passages(docs, scratch)
    texts = dict(rows)
    got = found.collect()
    assert {r.doc_id for r in got} == flagged(rows)
    for r in got:
        a, b = texts[r.doc_id].encode()[r.start : r.end].decode(), texts[r.first_doc_id].encode()[r.first_start : r.first_end].decode()
        assert r.first_doc_id < r.doc_id and len(a.split()) == r.n_words >= 50 and r.equal_words >= 0.8 * r.n_words and set(a.split()) & set(b.split())
    left = [(r.doc_id, r.text) for r in remove_passages(docs, found, scratch).collect()]
    assert len(left) == len(rows) and not flagged(left)
    for i, t in left:  # nothing but passages goes
        mine = [w for w in texts[i].split() if w[0] == "d"]
        assert [w for w in t.split() if w[0] == "d"] == mine


def test_fuzzy_passages(spark, scratch):
    rng = random.Random(2)
    base = words(rng, 120)
    rows = [(1, " ".join(words(rng, 30, "a") + base + words(rng, 30, "b")))]
    for i in range(2, 12):
        w = list(base)
        for j in range(7 + i, 120, 23):
            w[j : j + 1] = rng.choice([[], ["new"], [w[j], "more"]])
        rows.append((i, " ".join(words(rng, 40, f"c{i}_") + w + words(rng, 9, f"e{i}_"))))
    rows.append((50, " ".join(words(rng, 400, "z"))))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    assert {r.doc_id for r in got} == set(range(2, 12))
    assert all(100 <= r.n_words <= 130 for r in got)


def test_passages_of_hard_rows(spark, scratch, hard_docs, no_docs):
    got = sorted((r.doc_id, r.start, r.end, r.n_words, r.first_doc_id) for r in repeated_passages(hard_docs, scratch, name="h").collect())
    size = len(" ".join(f"w{i}" for i in range(80)))
    assert got == [(2, 0, size, 80, 1), (11, 0, size, 80, 1)]
    found = repeated_passages(hard_docs, scratch, name="i")
    cut = remove_passages(hard_docs, found, scratch)
    assert cut.columns == hard_docs.columns and cut.count() == hard_docs.count()
    assert {r.text for r in cut.filter("doc_id in (2, 11)").collect()} == {""}
    assert repeated_passages(no_docs, scratch, name="j").count() == 0
    with pytest.raises(ValueError):
        repeated_passages(no_docs, scratch, min_words=10)


def test_chain_is_optimal():
    from quern.llm.substrings import GAP_COST, SEED_SCORE

    rng = random.Random(5)
    for _ in range(100):
        m = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(1, 15))})
        pos, other = np.array(m).T
        best = [SEED_SCORE] * len(m)
        for i in range(len(m)):
            for j in range(i):
                if m[j][0] < m[i][0] and m[j][1] < m[i][1]:
                    best[i] = max(best[i], SEED_SCORE + best[j] - GAP_COST * (sum(m[i]) - sum(m[j])))
        top = chain(pos, other)[0]
        assert all(m[a][0] < m[b][0] and m[a][1] < m[b][1] for a, b in zip(top, top[1:]))
        value = SEED_SCORE * len(top) - GAP_COST * (sum(m[top[-1]]) - sum(m[top[0]]))
        assert math.isclose(value, max(best))


def test_align_splits_at_wide_gaps():
    x = np.arange(200)
    y = np.concatenate([np.arange(60), np.arange(1000, 1100), np.arange(60, 200)])
    assert align(x, y, [(5, 5), (100, 200)], 5, 0.8) == [(0, 60, 0, 60, 60), (60, 200, 160, 300, 140)]


@pytest.mark.parametrize("run, gap, more", [(60, 24, 12), (52, 24, 12), (50, 20, 5), (200, 24, 5)])
def test_align_keeps_a_run_with_a_phrase_behind_it(run, gap, more):
    x = np.arange(run + gap + more)
    y = np.concatenate([np.arange(run), np.arange(1000, 1000 + gap), np.arange(run + gap, run + gap + more)])
    for u, v, seeds in ((x, y, [(5, 5), (run + gap, run + gap)]), (x[::-1], y[::-1], [(0, 0), (more + gap + 3, more + gap + 3)])):
        got = align(u, v, seeds, 5, 0.8)
        assert any(b - a >= run and same >= 0.8 * max(b - a, d - c) for a, b, c, d, same in got)


def covered(rows, found):
    """Words of each document that stand in its passages."""
    texts, spans = {i: t.encode() for i, t in rows}, {}
    for r in found.collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    return {i: sum(any(a <= m.start() < b for a, b in s) for m in re.finditer(rb"\S+", texts[i])) for i, s in spans.items()}


@pytest.mark.parametrize("size", [6, 31, 60, 400])
def test_passages_of_long_words(spark, scratch, size):
    rng = random.Random(size)
    long = lambda n, tag: [f"{tag}{rng.randrange(10**6)}".ljust(size, "x") for _ in range(n)]
    shared = long(52, "p") + long(200, "q")
    rows = [(i, " ".join(long(150, f"a{i}_") + (shared[:52] if i < 4 else shared) + long(150, f"b{i}_"))) for i in (1, 2, 3, 5, 6)]
    assert covered(rows, repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), scratch)) == {2: 52, 3: 52, 5: 52, 6: 252}


def changed(rng, text, share):
    """The words with so many of them replaced at random places."""
    w = list(text)
    for j in rng.sample(range(len(w)), round(share * len(w))):
        w[j] = f"new{rng.randrange(10**6)}"
    return w


def test_fuzzy_passages_with_many_changes(spark, scratch):
    rng = random.Random(11)
    rows, n = [], 0
    for size, share in [(50, 0.06), (50, 0.1), (60, 0.1), (60, 0.15), (100, 0.15)]:
        for _ in range(40):
            base = words(rng, size, f"s{n}_")
            inner = base[:1] + changed(rng, base[1:-1], share) + base[-1:]
            rows += [(n, " ".join(words(rng, 40, f"a{n}_") + base + words(rng, 40, f"b{n}_"))), (n + 1, " ".join(words(rng, 40, f"c{n}_") + inner + words(rng, 40, f"e{n}_")))]
            n += 2
    got = covered(rows, repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), scratch))
    found = [sum(i + 1 in got for i in range(a, a + 80, 2)) for a in range(0, n, 80)]
    print(found)
    assert min(found[2:]) >= 36 and not any(i in got for i in range(0, n, 2))


def test_needed_places_cover_the_same_words():
    rng = np.random.default_rng(2)
    for _ in range(200):
        rows = {(int(h), int(d), int(w)) for h, d, w in zip(rng.integers(0, 2, 40), rng.integers(0, 2, 40), rng.integers(0, 80, 40))}
        t = np.array(sorted(rows, key=lambda r: (r[1], r[0], r[2])))
        kept = needed(t, 9)
        words = lambda x: {(h, d, w + i) for h, d, w in x.tolist() for i in range(9)}
        assert words(kept) == words(t) and {tuple(r) for r in kept.tolist()} <= rows
    dense = np.column_stack([np.zeros(1000), np.zeros(1000), np.arange(1000)]).astype(np.int64)
    assert len(needed(dense, 50)) <= 22 and len(needed(dense[:0], 50)) == 0


def test_runs_of_one_word(spark, scratch):
    """Text that repeats itself word for word."""
    rng = random.Random(14)
    rows = [(1, " ".join(words(rng, 30, "a") + ["the"] * 70 + words(rng, 30, "b"))), (2, " ".join(words(rng, 30, "c") + ["the"] * 300 + words(rng, 30, "d") + ["the"] * 20))]
    rows += [(3, " ".join(words(rng, 30, "e") + ["one", "two", "three"] * 30 + words(rng, 30, "f"))), (4, " ".join(words(rng, 30, "g") + ["one", "two", "three"] * 90))]
    assert covered(rows, repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), scratch)) == {2: 300, 4: 270}


def test_passages_that_stand_twice_in_a_document(spark, scratch):
    rng = random.Random(12)
    shared = words(rng, 50, "p")
    rows = [(i, " ".join(shared[i * 5 : i * 5 + 9])) for i in range(10)]  # smaller ids have the short phrases
    rows += [(20, " ".join(words(rng, 60, "a") + shared)), (21, " ".join(w for c in "bcde" for w in [*words(rng, 60, c), *shared]))]
    got = covered(rows, repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), scratch))
    assert got == {21: 200}


def test_passages_with_partial_holders(spark, scratch):
    rng = random.Random(13)
    rows, want = [], {}
    for n in range(0, 200, 10):
        p = words(rng, 60, f"p{n}_")
        for i, part in enumerate([p[:49], p[:40], p[20:], p, p, p[5:]]):
            rows.append((n + i, " ".join(words(rng, 30, f"a{n + i}_") + part + words(rng, 30, f"b{n + i}_"))))
        want |= {n + 4: 60, n + 5: 55}
    assert covered(rows, repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), scratch)) == want


def test_cuts_against_a_plain_rule(spark, scratch):
    """Overlapping, repeated and touching spans in texts of several scripts, with an extra column of a helper's name."""
    r = random.Random(3)
    docs, spans, want = [], [], {}
    for i in range(300):
        text = None if i % 37 == 0 else "".join(r.choice(["é", "ab", " ", "\n ", " ", "漢", "x", "\x0b", "　"]) for _ in range(r.randint(0, 60)))
        raw = (text or "").encode()
        words = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\v\f\r]+", raw)]
        mine = []
        for _ in range(r.randint(0, 4) if words else 0):
            a = r.randrange(len(words))
            mine.append((words[a][0], words[r.randrange(a, len(words))][1]))
        docs.append((i, text, i % 5))
        spans += [(i, a, b, 1, 0, 0, 0, 1) for a, b in mine]
        gone = [False] * len(raw)
        for a, b in mine:
            while b < len(raw) and raw[b] in b" \t\n\v\f\r":
                b += 1
            gone[a:b] = [True] * (b - a)
        left = bytes(c for c, g in zip(raw, gone) if not g).decode()
        want[i] = text if not mine else left if left.split() else ""
    docs = spark.createDataFrame(docs, "doc_id long, text string, cut_gaps int")
    out = remove_passages(docs, spark.createDataFrame(spans, ", ".join(f"{c} long" for c in PASSAGE)), scratch)
    assert out.columns == docs.columns
    assert {x.doc_id: x.text for x in out.collect()} == want


def test_no_seed_is_left_out(spark, scratch):
    """Every seed counts: passages with every sixth word changed, text that repeats itself after nine words, and runs of one word in longer runs are all found."""
    rng = random.Random(31)
    rows, want = [], {}
    for i in range(0, 240, 2):
        size = 60 + i % 3
        if i % 4:
            base = (words(rng, 9, f"r{i}_") * 7)[:size]
            other = base
        else:
            base = words(rng, size, f"c{i}_")
            other = [f"z{i}_{j}" if j % 6 == 5 and j < size - 1 else w for j, w in enumerate(base)]
        rows += [(i, " ".join(words(rng, 40, f"a{i}_") + base + words(rng, 40, f"b{i}_"))), (i + 1, " ".join(words(rng, 40, f"d{i}_") + other + words(rng, 40, f"e{i}_")))]
        want[i + 1] = size
    rows += [(1000, " ".join(words(rng, 40, "m") + ["run"] * 60 + words(rng, 40, "n"))), (1001, " ".join(words(rng, 40, "o") + ["run"] * 333 + words(rng, 40, "p")))]
    want[1001] = 333
    got = covered(rows, repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), scratch))
    assert {i: got.get(i, 0) for i in want if got.get(i, 0) < want[i] - (5 if i < 1000 and i % 4 == 1 else 0)} == {}


@pytest.mark.parametrize("decoys", [0, 6])
def test_passages_whose_holder_is_neither_first_nor_last(spark, scratch, decoys):
    """Each seed of a changed passage stands in documents with a short piece of it before and after the one that has it in full; decoys have two runs of it side by side."""
    rng = random.Random(41)
    rows, want = [], {}
    for n in range(0, 1000, 100):
        p = words(rng, 60, f"p{n}_")
        changed_one = [f"n{n}_{j}" if j % 9 == 8 else w for j, w in enumerate(p)]
        phrases = [p[a : a + 9] for a in range(0, 56, 5)]
        doubles = [[*p[a : a + 8], f"y{n}_{a}_{i}", *p[a + 9 : a + 17]] for a in range(0, 44, 9) for i in range(decoys)]
        for i, part in enumerate([*phrases, *doubles, p, *phrases, changed_one]):
            rows.append((n + i, " ".join(words(rng, 30, f"a{n + i}_") + part + words(rng, 30, f"b{n + i}_"))))
        want[rows[-1][0]] = 60
    assert covered(rows, repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), scratch)) == want


def test_partners_part_on_both_sides():
    """Of many documents with two seeds side by side only those are paired that differ both after the first and before the second; rows stay few where all words between are the same."""
    import pyarrow as pa
    from quern.llm.substrings import _partners, _useful

    rng, rows = random.Random(7), []
    for key in range(40):
        for doc in range(60):
            sides = (rng.choice([5, 5, 5, 6, 7]) << 32) | rng.choice([8, 8, 9]) if key % 2 else 5 << 32 | 8
            rows.append((key, doc, sides, key, key + 7, [doc << 32 | doc] if doc % 3 else []))
    columns = ["key", "doc", "sides", "p", "q"]
    batch = pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], pa.int64()) for c in range(5)), pa.array([r[5] for r in rows], pa.list_(pa.int64()))], [*columns, "at"])
    kept = pa.Table.from_batches(list(_useful(iter([batch.slice(0, 1000), batch.slice(1000)]))))
    assert set(kept["key"].to_pylist()) == set(range(1, 40, 2)) and kept.num_rows == 20 * 60
    live = [len(x) > 0 for x in kept["at"].to_pylist()]
    asked = pa.Table.from_arrays([*(kept[c] for c in columns), pa.array(live)], [*columns, "live"]).combine_chunks().to_batches()
    every = {(d, a, p, q) for k, d, x, _, _, at in rows for j, a, y, p, q, _ in rows if j == k and at and a < d and x >> 32 != y >> 32 and x & 0xFFFFFFFF != y & 0xFFFFFFFF}
    got = [tuple(r.values()) for b in _partners(None)(iter(asked)) for r in b.to_pylist()]
    assert set(got) == every and len(got) == len(every)
    first = [tuple(r.values()) for b in _partners(4)(iter(asked)) for r in b.to_pylist()]
    assert set(first) <= every and len(first) <= 20 * 60 * 8


def test_places_shared_by_two_documents():
    import pyarrow as pa
    from quern.llm.substrings import _shared

    h = lambda x: [v << 16 | 1 for v in x]
    many = pa.list_(pa.int64())
    names = ["doc", "at", "aat", "adoc", "bt", "bat", "places"]
    values = [[5, 5], [[1, 2, 9], [1, 2]], [h([7, 8, 7]), h([7, 8])], [2, 3], [[0, 1, 2, 3, 90], [4, 5]], [h([7, 7, 7, 9, 7]), h([1, 8])], [[], []]]
    batch = pa.RecordBatch.from_arrays([pa.array(v, many if isinstance(v[0], list) else pa.int64()) for v in values], names)
    got = sorted(tuple(r.values()) for b in _shared(iter([batch]), 29) for r in b.to_pylist())
    assert got == [(5, 1, 2, 0, 0), (5, 1, 2, 2, 0), (5, 1, 2, 90, 0), (5, 2, 3, 5, 0), (5, 9, 2, 0, 0), (5, 9, 2, 2, 0), (5, 9, 2, 90, 0)]
