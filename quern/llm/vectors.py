"""Embedding near-duplicates by collision counting on sorted projections.

Equal vectors are folded. Unit vectors are then dealt to blocks: in each of several tables, the cells
of a few quantised random projections. Within a block, many one-dimensional projections are
sorted, every vector's window around its own place is read from each, and per pair the windows
it collides in are counted. Pairs with enough collisions are verified by their cosine in double
precision. Window width and count, and the number of tables, follow from the miss
probability of a pair that lies exactly on the threshold; the number of cell projections grows with
the logarithm of the rows, so blocks keep their size and the work grows little faster than the rows.

A pair that meets in several tables counts in the first of them. Blocks of too many rows are
split, and all pairs of parts are compared. Pairs aren't emitted: a block
gives link counts per vector, and links that join its components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, map_batches, map_groups

WIDTH = 2.0
PROJECTIONS = 16
BLOCK = 2048
TARGET = 1024
SLAB = 1 << 17


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def same_cell(distance: float, width: float) -> float:
    """Chance that two points so far apart fall in the same cell of a randomly shifted Gaussian projection."""
    t = width / distance
    return 1 - 2 * _phi(-t) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(rows: int, threshold: float, miss: float) -> tuple[int, int, float, int]:
    """(projections per cell, tables, window, least count).

    Half of the allowed misses go to the cells, half to the counts.
    """
    near, far = math.sqrt(2 - 2 * threshold), math.sqrt(2)
    k = max(1, math.ceil(math.log(max(rows, 1) / TARGET) / -math.log(same_cell(far, WIDTH)))) if rows > TARGET else 0
    if not k:
        tables = 1
    else:
        p = same_cell(near, WIDTH) ** k
        tables = math.ceil(math.log(miss / 2) / math.log(1 - p))
    window = 1.5 * near
    q = 2 * _phi(1.5) - 1
    below, count = 0.0, 0
    while True:
        below += math.comb(PROJECTIONS, count) * q**count * (1 - q) ** (PROJECTIONS - count)
        if below > miss / 2:
            return k, tables, window, count
        count += 1


def _candidates(p: np.ndarray, window: float, least: int, split: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j that collide in at least `least` windows; with split > 0 only pairs across that row.

    On a sorted projection a row's window is a range of places, so a pair collides where the place of one is in the range of the other.
    A pair collides once per projection at most, so counts are bytes, added up projection by projection for SLAB pairs at a time.
    """
    n = len(p)
    kind = np.uint16 if n < 1 << 16 else np.uint32
    at, low, size = (np.empty((p.shape[1], n), kind) for _ in range(3))  # each row's place, where its window begins, and places in it
    for c, line in enumerate(p.T):
        order = np.argsort(line)
        s = line[order]
        ends = np.searchsorted(s, s + window, side="right")
        begins = np.searchsorted(ends, np.arange(n), side="right")
        at[c, order], low[c, order], size[c, order] = np.arange(n), begins, ends - begins
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, SLAB // max(n, 1))
    for a in range(0, split or n, step):
        rows, begin = slice(a, min(a + step, split or n)), split or a
        counts = np.zeros((rows.stop - a, n - begin), np.uint8)
        off, hit = np.empty(counts.shape, kind), np.empty(counts.shape, bool)
        for c in range(len(at)):
            np.subtract(at[c, None, begin:], low[c, rows, None], out=off)  # places before the window wrap round to large numbers
            np.less(off, size[c, rows, None], out=hit)
            counts += hit.view(np.uint8)
        i, j = np.nonzero(counts >= max(least, 1))
        i, j = i + a, j + begin
        found.append((i, j) if split else (i[i < j], j[i < j]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def near_vectors(vectors: DataFrame, scratch: Scratch, *, threshold: float = 0.95, miss: float = 1e-4, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Pairs with cosine >= threshold are linked. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing (n_links 0, a component of their own); vectors of different
    widths don't link. n_links counts the other rows linked directly, copies included; component_id is the
    smallest id reachable. A row with a null id has a null component and is kept, but counts as a copy like any other.
    Repeated ids come out as often. An empty table gives an empty result; other columns are not read.
    """
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = scratch.table(raw.select("vec_id", F.when(F.isnan(size) | (size == float("inf")) | (size <= 0), None).otherwise(F.when(size.isNotNull(), F.col("v"))).alias("v")), "rows")
    keyed = rows.withColumn("print", F.xxhash64("v"))
    reps = keyed.filter("v is not null").groupBy("print", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    reps = scratch.table(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    widths = reps.groupBy(F.size("v").alias("d")).count().collect()  # one row per width
    parts, links = [], []
    for w in sorted(widths, key=lambda r: r.d):
        links.append(_width_links(reps.filter(F.size("v") == w.d), w["count"], w.d, scratch, threshold, miss, seed))
    if not links:
        empty = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
        return empty
    found = links[0]
    for x in links[1:]:
        found = found.unionAll(x)
    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    comp = components(found.filter("b is not null").select("a", "b"), scratch, "vec_cc").withColumnRenamed("node", "rep")
    judged = reps.join(counts, "rep", "left").join(comp, "rep", "left").select("print", "v", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("comp"))
    judged = scratch.table(judged, "judged")
    lows = judged.groupBy("comp").agg(F.min("low").alias("component_id"))
    by_print = judged.join(lows, "comp").select("print", "v", "n_links", "component_id")
    out = keyed.join(by_print, ["print", "v"], "left")
    component = F.when(F.col("vec_id").isNull(), None).otherwise(F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _width_links(reps: DataFrame, n: int, d: int, scratch: Scratch, threshold: float, miss: float, seed: int) -> DataFrame:
    """(a, b, n): link counts of a (b null), and links that join components, among reps of one width."""
    k, tables, window, least = plan(n, threshold, miss)
    rng = np.random.default_rng(seed + d)
    cells = rng.normal(size=(d, tables * k))
    shift = rng.uniform(0, WIDTH, tables * k)
    lines = rng.normal(size=(d, PROJECTIONS))
    spice = rng.integers(1, 2**62, (tables, max(k, 1)), dtype=np.int64) * 2 + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = part.column(1).flatten().to_numpy().reshape(part.num_rows, d)
                u = x / np.abs(x).max(1, keepdims=True)
                u /= np.sqrt((u * u).sum(1, keepdims=True))
                if k:
                    code = np.floor((u @ cells + shift) / WIDTH).astype(np.int64).reshape(len(u), tables, k)
                    code = (code * spice).sum(2)
                else:
                    code = np.zeros((len(u), 1), np.int64)
                ends = pa.array(np.arange(len(u) + 1, dtype=np.int32) * tables)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.ListArray.from_arrays(ends, pa.array(code.ravel()))], ["rep", "v", "copies", "cells"])

    dealt = scratch.table(map_batches(reps.select("rep", "v", "copies"), deal, "rep long, v array<double>, copies long, cells array<long>"), f"dealt{d}")
    at = dealt.select("rep", F.posexplode("cells").alias("t", "cell"))
    sizes = at.groupBy("t", "cell").count().filter("count > 1").select("t", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    placed = dealt.select("*", F.posexplode("cells").alias("t", "cell")).join(sizes, ["t", "cell"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other"), "side": (F.col("part") > F.col("other")).cast("int")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "rep"], kind="stable")
        rep, copies, t = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), int(pdf["t"].iloc[0])
        x, codes = np.stack(pdf["v"].to_numpy()), np.stack(pdf["cells"].to_numpy())
        split = int((pdf["side"] == 0).sum()) if pdf["i"].iloc[0] != pdf["j"].iloc[0] else 0
        u = x / np.abs(x).max(1, keepdims=True)
        u /= np.sqrt((u * u).sum(1, keepdims=True))
        a, b = _candidates(u @ lines, window, least, split)
        linked = np.empty(len(a), bool)
        for c in range(0, len(a), 1 << 15):
            linked[c : c + (1 << 15)] = np.einsum("ij,ij->i", u[a[c : c + (1 << 15)]], u[b[c : c + (1 << 15)]]) >= threshold
        a, b = a[linked], b[linked]
        first = np.ones(len(a), bool)
        for s in range(t):
            first &= codes[a, s] != codes[b, s]
        a, b = a[first], b[first]
        n = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
        label = np.arange(len(rep))
        while len(a):  # smallest label along links
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        own, tied = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(rep)))
        return pd.DataFrame({
            "a": np.concatenate([rep[own], rep[tied]]), "b": pd.array([None] * len(own) + rep[label[tied]].tolist(), "Int64"),
            "n": np.concatenate([n[own], np.zeros(len(tied))]).astype(np.int64),
        })

    grouped = placed.select("t", "cell", "i", "j", "side", "rep", "v", "copies", "cells").groupBy("t", "cell", "i", "j")
    return scratch.table(map_groups(scratch.spark, grouped, run, "a long, b long, n long"), f"links{d}")


def op7_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings at cosine 0.95."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark))
