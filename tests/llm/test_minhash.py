"""Near-duplicates against brute force, and edge cases."""

import random
import re

import numpy as np
from quern.llm.minhash import half_keys, near_duplicates, overlaps
from quern.llm.textvec import Words


def brute(rows, percent, k=5):
    """Each id's set size and component, all pairs compared."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def varied(seed, n=120, words=60, changes=6):
    rng = random.Random(seed)
    base = [[f"v{rng.randrange(4000)}" for _ in range(words)] for _ in range(n // 8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(changes)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i * 7 + 3, " ".join(w[: rng.choice([len(w), len(w) - 2, 3])])))
    return rows


def check(spark, scratch, rows, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch, percent=percent).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(rows, percent).items()}


def test_against_brute_force(spark, scratch):
    check(spark, scratch, varied(1), 85)


def test_large_cluster_in_several_components(spark, scratch, monkeypatch):
    """Blocks far smaller than the cluster still find every link."""
    monkeypatch.setattr("quern.llm.minhash.BLOCK", 8)
    check(spark, scratch, varied(2, n=90), 80)


def test_few_very_long_texts(spark, scratch, monkeypatch):
    """Blocks are bounded in bytes: long texts that are all alike still link, a pair at a time."""
    monkeypatch.setattr("quern.llm.minhash.BLOCK_BYTES", 40_000)
    check(spark, scratch, varied(4, n=16, words=9000, changes=400), 85)


def test_a_cluster_of_thousands(spark, scratch):
    """One document with thousands of near copies, each of its own."""
    rng = random.Random(6)
    base = [f"v{i}" for i in range(200)]
    rows = [(3, " ".join(base))]
    for i in range(4, 2504):
        w = list(base)
        w[rng.randrange(200)] = f"z{i}"
        rows.append((i, " ".join(w)))
    rows += [(9000 + i, " ".join(f"q{i}_{j}" for j in range(50))) for i in range(50)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch, percent=85).collect()
    assert all(r.component_id == (3 if r.doc_id < 9000 else r.doc_id) for r in got) and len(got) == len(rows)


def test_recall_at_the_threshold(spark, scratch):
    """Pairs that share 170 of 200 shingles, and pairs that share one less."""
    rows = []
    for i in range(400):
        n = 174 - i % 2
        w = [f"w{i}_{j}" for j in range(189)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:n] + [f"x{i}_{j}" for j in range(189 - n)]))]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch, percent=85).collect()}
    linked = [got[2 * i + 1] == 2 * i for i in range(400)]
    assert sum(linked[::2]) >= 199 and not any(linked[1::2])


def test_hard_rows(spark, scratch, hard_docs):
    rows = near_duplicates(hard_docs, scratch, percent=85).collect()
    assert len(rows) == hard_docs.count()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert [got[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, -10)] == [1, 1, 3, 4, 5, 6, 6, 8, 9, -10]
    assert got[4].n_shingles == 0 and got[6].n_shingles == 1 and sum(r.doc_id == 2 for r in rows) == 2


def test_empty(spark, scratch, no_docs):
    assert near_duplicates(no_docs, scratch).count() == 0


def test_half_keys_and_recall():
    for t, band in ((0.85, 2), (0.8, 2), (0.9, 3)):
        m, p = half_keys(t, band, 1e-4), t**band
        miss = lambda m: (1 - p) ** m + m * p * (1 - p) ** (m - 1)  # noqa: E731, B023
        assert miss(m) <= 1e-4 < miss(m - 1)


def test_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(20)]
    assert (overlaps(sets) == [[len(np.intersect1d(a, b)) if i != j else overlaps(sets)[i][i] for j, b in enumerate(sets)] for i, a in enumerate(sets)]).all()


def test_word_places():
    texts = ["Ab  cd\nÉf", "", "x", "a\x0bb"]
    w = Words([t.encode() for t in texts])
    raw = [t.encode() for t in texts]
    owner = np.repeat(np.arange(4), np.diff(w.first))
    assert [raw[o][a:b].decode() for o, a, b in zip(owner, w.start, w.end)] == ["Ab", "cd", "Éf", "x", "a", "b"]


def test_stretches(monkeypatch):
    """Long texts hash the same whether or not they are worked off in stretches."""
    text = [" ".join(f"word{i}" * (i % 7 + 1) for i in range(3000)).encode(), b"", b"x" * 5000, b"a b"]
    whole = Words(text).hash
    monkeypatch.setattr("quern.llm.textvec.STRETCH", 100)
    assert (Words(text).hash == whole).all()
