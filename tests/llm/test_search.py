"""Top-k search and embedding near-duplicates against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F
from quern.llm.topk import quantised, top_k
from quern.llm.vectors import near_vectors, plan, same_cell

V = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], V)


def test_top_k_in_many_shards(spark, scratch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)).astype(np.float32).round(2)  # rounded: ties happen
    df = vectors(spark, list(enumerate(x))).select("vec_id", quantised(F.col("embedding")).alias("v"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(df, df.filter("vec_id % 50 = 0"), scratch, shard_rows=60, block_queries=3).collect()}
    q = np.floor(256 * x.astype(float)).astype(int)
    want = {}
    for i in range(0, 400, 50):
        s = q @ q[i]
        for k, j in enumerate([j for j in np.lexsort((np.arange(400), -s)) if j != i][:5]):
            want[i, k + 1] = (j, s[j])
    assert got == want


def test_top_k_hard_rows(spark, scratch):
    df = vectors(spark, [(0, [1, 1]), (1, [1, 1]), (2, [1, 1]), (3, None), (4, [1, None]), (5, [math.nan, 1]), (6, [math.inf, 1]), (7, [0, 0]), (None, [1, 1]), (50, [3, 1, 2]), (2, [1, 1])])
    q = df.select("vec_id", quantised(F.col("embedding")).alias("v"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(q, q.filter("vec_id = 0 or vec_id = 50"), scratch, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 131072), (0, 2, 2, 131072), (0, 3, 2, 131072)]
    large = vectors(spark, [(0, [1e9, 1e9]), (1, [1e9, 1]), (2, [1, 1e9])])
    q = large.select("vec_id", quantised(F.col("embedding")).alias("v")).withColumn("v", F.transform("v", lambda x: (x / 1000).cast("long")))
    assert top_k(q, q.filter("vec_id = 0"), scratch).count() == 2
    assert top_k(q.limit(0), q.limit(0), scratch).count() == 0


def brute(rows, threshold):
    ok = [(i, np.asarray(v, float)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: 0 for i, _ in rows}
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (a, x) in enumerate(ok):
        for b, y in ok[:n]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                r, s = root(a), root(b)
                up[max(r, s)] = min(r, s)
    return {i: (links[i], root(i), root(i) == i) for i in links}


def test_near_vectors_in_many_cells(spark, scratch, monkeypatch):
    monkeypatch.setattr("quern.llm.vectors.TARGET", 16)
    monkeypatch.setattr("quern.llm.vectors.BLOCK", 12)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows = [(int(i) * 3, (base[i % 30] + rng.normal(size=16) * rng.choice([0, 0.1, 0.2])).astype(np.float32).tolist()) for i in range(240)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(vectors(spark, rows), scratch).collect()}
    assert got == brute(rows, 0.95)


def test_near_vectors_hard_rows(spark, scratch):
    rows = [(5, [1.0, 0.0]), (3, [2.0, 0.0]), (9, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (4, [math.nan, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 0.0, 0.0]), (10, [math.inf, 0.0])]
    df = vectors(spark, rows).withColumn("rep", F.lit("x")).withColumn("cells", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, scratch).collect()}
    assert got == brute(rows, 0.95)
    again = near_vectors(vectors(spark, [(1, [1.0]), (1, [1.0]), (None, [1.0])]), scratch).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in again)[1:] == [(1, 2, 1, True), (1, 2, 1, True)]
    assert near_vectors(vectors(spark, [(1, None)]), scratch).collect()[0][:] == (1, 0, 1, True)
    assert near_vectors(df.limit(0), scratch).count() == 0


def test_candidates(monkeypatch):
    """Counts of window collisions, whole and across a split, whatever the slab; a block of near-identical vectors stays small."""
    import tracemalloc

    from quern.llm.vectors import _candidates

    rng = np.random.default_rng(4)
    p = rng.normal(size=(60, 6))
    near = (np.abs(p[:, None] - p[None, :]) <= 0.5).sum(2)
    for slab in (7, 1 << 19):
        monkeypatch.setattr("quern.llm.vectors.SLAB", slab)
        for split in (0, 25):
            want = {(i, j) for i in range(60) for j in range(i + 1, 60) if near[i, j] >= 3 and (not split or i < split <= j)}
            assert set(zip(*(x.tolist() for x in _candidates(p, 0.5, 3, split)))) == want
    tracemalloc.start()
    i, _ = _candidates(rng.normal(size=(1, 16)) + 1e-3 * rng.normal(size=(2048, 16)), 0.47, 9, 0)
    assert len(i) == 2048 * 2047 // 2 and tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


def test_near_vectors_through_cells(spark, scratch):
    """Some thousand rows: several cells and tables with the production plan."""
    assert plan(4000, 0.95, 1e-4)[0] >= 1
    rng = np.random.default_rng(6)
    base = rng.normal(size=(1500, 24))
    rows = [(i, (base[i % 1500] + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.4])).astype(np.float32).tolist()) for i in range(4000)]
    x = np.array([r[1] for r in rows])
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in near_vectors(vectors(spark, rows), scratch).collect()}
    assert sum(got[i] for i in range(4000)) >= 0.999 * near.sum() and all(got[i] <= near[i].sum() for i in range(4000))


def test_plan():
    assert plan(100, 0.95, 1e-4)[:2] == (0, 1)
    k, tables, window, least = plan(10**6, 0.95, 1e-4)
    near = math.sqrt(0.1)
    assert (1 - same_cell(near, 2.0) ** k) ** tables <= 5e-5
    rng = np.random.default_rng(0)
    hits = (np.abs(rng.normal(size=(200_000, 16)) * near) <= window).sum(1)
    assert (hits < least).mean() < 2e-4


def test_candidates_cost():
    """Work per pair stays small: a block of 4,096 rows in little CPU time and memory, its pairs the same as by comparing every window."""
    import time
    import tracemalloc

    from quern.llm.vectors import _candidates

    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(size=(2048, 16)) * 1.4] * 2) + 0.02 * rng.normal(size=(4096, 16))
    began = time.process_time()
    i, j = _candidates(p, 0.47, 9, 0)
    assert time.process_time() - began < 1.5
    got = np.zeros((4096, 4096), bool)
    got[i, j] = True
    near = sum((np.abs(c[:, None] - c[None, :]) <= 0.47).astype(np.uint8) for c in p.T)
    assert (got == np.triu(near >= 9, 1)).all()
    tracemalloc.start()
    _candidates(p, 0.47, 16, 0)
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()
