"""MinHash near-duplicates with tensored banding.

A document's set is its distinct word shingles. m half keys, each of a few minhashes, are
computed, and every pair of half keys forms a table key: m (m - 1) / 2 tables for m half keys, so
the minhash work is about the square root of what independent tables would take. Two documents
are candidates if they share a table key, that is at least two half keys. m follows from the
threshold and the miss probability of a pair that lies exactly on it.

Copies of one set are folded first. Half keys that occur once in the corpus can't meet anything and
go before the pairs of half keys are formed; tables' buckets with the same members count once.
Buckets that share documents make a cluster, and all links within a cluster are confirmed on full
sets. A large cluster is first thinned out: each bucket's members are held against its smallest
member. Where that leaves it in several components, its documents are dealt into blocks, bounded in documents and in bytes of their sets, and
all pairs of blocks are compared, but not those within its largest component.
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
from .scratch import Scratch, few, map_batches, map_groups, spread
from .textvec import Words, mix, pieces_of, release

BLOCK, BLOCK_BYTES = 512, 16 << 20
STAR = 256
SLAB = 4096
_MUL = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def half_keys(threshold: float, band: int, miss: float) -> int:
    """The fewest half keys of `band` minhashes such that a pair at the threshold shares two."""
    p, m = threshold**band, 2
    while (1 - p) ** m + m * p * (1 - p) ** (m - 1) > miss:
        m += 1
    return m


def _sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Each document's sorted distinct shingle hashes."""
    h, first = Words(texts).shingles(k)
    for a, b in zip(first[:-1], first[1:]):
        yield np.unique(h[a:b])


def signatures(docs: DataFrame, *, shingle: int, m: int, band: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, h0 .. h{m-1}): set size, set digest and half keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, part in pieces_of(batches):
            h, first = Words(part).shingles(shingle)
            n = np.diff(first)
            full = n > 0
            size, d1, d2 = np.zeros(len(part), np.int64), np.zeros(len(part), np.uint64), np.zeros(len(part), np.uint64)
            for i in np.flatnonzero(full):
                u = np.unique(h[first[i] : first[i + 1]])
                size[i], d1[i], d2[i] = len(u), np.add.reduce(u * _MUL[-1]), np.add.reduce(mix(u))
            keys = np.zeros((m, len(part)), np.uint64)
            if full.any():
                begins = first[:-1][full]
                for j in range(m):
                    for b in range(band):
                        low = np.minimum.reduceat(mix(h ^ _MUL[j * band + b]), begins)
                        keys[j, full] = mix(keys[j, full] ^ (low * _MUL[-2]))
            cols = [rows.column(0), pa.array(size), *(pa.array(x.view(np.int64)) for x in (d1, d2, *keys))]
            yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_shingles", "d1", "d2", *(f"h{j}" for j in range(m))]
    return map_batches(docs, run, ", ".join(f"{c} long" for c in names))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 |a n b| >= percent |a u b| for sorted distinct arrays."""
    n = len(a) + len(b)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inter >= percent * (n - inter)


def _confirm_pairs(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; a b with more than STAR pairs is dealt out over several tasks."""
    sa, sb = (sets.select(F.col("doc_id").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = [_similar(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), percent) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    many = few(scratch.table(pairs.groupBy("b").count().filter(F.col("count") > STAR).select("b", F.ceil(F.col("count") / STAR).cast("int").alias("parts")), "many"))
    parts = F.coalesce("parts", F.lit(1))
    left = pairs.join(many, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), parts).cast("int").alias("salt"))
    right = sb.join(many, "b", "left").select("b", "set_b", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    return map_batches(left.join(right, ["b", "salt"]).join(sa, "a").select("a", "b", "set_a", "set_b"), run, "a long, b long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted distinct arrays."""
    n = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1  # only what two sets have can count
    column = (np.cumsum(shared) - 1)[number]
    keep = shared[number]
    owner, column = owner[keep], column[keep]
    out = np.zeros((n, n), np.float64)
    for at in range(0, int(shared.sum()), SLAB):
        a, b = np.searchsorted(column, [at, at + SLAB])
        m = np.zeros((n, min(SLAB, int(column[b - 1]) - at + 1)), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _joins(doc: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], across: bool, percent: int) -> list[tuple[int, int]]:
    """Links that join different components; across: only those from side to side."""
    if len(doc) == 2:
        return [(doc[1], doc[0])] if comp[0] != comp[1] and _similar(sets[0], sets[1], percent) else []
    both, size = overlaps(sets), np.array([len(s) for s in sets])
    ok = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    ok &= comp[:, None] != comp[None, :]
    if across:
        ok &= side[:, None] != side[None, :]
    found, comp = [], comp.copy()
    for x, y in zip(*np.nonzero(np.triu(ok, 1))):
        if comp[x] != comp[y]:
            found.append((doc[y], doc[x]))
            comp[comp == comp[y]] = comp[x]
    return found


def _confirm_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links that join different components, from rows (grp, i, j, side, cluster, doc, comp, set); i and j are the blocks that meet."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cluster", "doc"], kind="stable")
        across = bool(pdf["i"].iloc[0] != pdf["j"].iloc[0])
        doc, comp, side, cluster = (pdf[c].to_numpy() for c in ("doc", "comp", "side", "cluster"))
        sets = [np.frombuffer(s, np.uint64) for s in pdf["set"]]
        edges = [0, *(np.flatnonzero(cluster[1:] != cluster[:-1]) + 1), len(cluster)]
        found = [x for a, b in zip(edges, edges[1:]) if b - a > 1 for x in _joins(doc[a:b], comp[a:b], side[a:b], sets[a:b], across, percent)]
        release()
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return map_groups(rows.sparkSession, rows.groupBy("grp", "i", "j"), run, "a long, b long")


def near_duplicates(docs: DataFrame, scratch: Scratch, *, percent: int = 80, shingle: int = 5, band: int = 2, miss: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Words are what stands between white space, A-Z lower-cased. Two documents are linked if
    100 |intersection| >= percent |union| of their distinct shingles; a document of fewer words than a
    shingle has its whole sequence as its one shingle. component_id is the smallest id
    reachable by links, kept marks the document that has it. Without words (null, empty or blank
    text) a document links with nothing and is kept. A null id stays a row of its own with a
    null component, kept. Rows that repeat an id come out as often, each judged by its own text.
    An empty table gives an empty result; other columns are not read.
    """
    docs = spread(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    m = half_keys(percent / 100, band, miss)
    keys = [f"h{j}" for j in range(m)]
    sig = scratch.table(signatures(docs, shingle=shingle, m=m, band=band), "sig")
    known = sig.filter("n_shingles > 0 and doc_id is not null")
    digest = ["n_shingles", "d1", "d2"]
    reps = scratch.table(known.groupBy(*digest).agg(F.min("doc_id").alias("doc"), *(F.min(k).alias(k) for k in keys)), "reps")

    # half keys that at least two sets have
    halves = reps.select("doc", F.posexplode(F.array(*keys)).alias("j", "h"))
    shared = halves.groupBy("j", "h").count().filter("count > 1").select("j", "h")
    held = halves.join(shared, ["j", "h"]).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("j", "h"))).alias("hs")).filter(F.size("hs") > 1)
    tables = held.select("doc", F.explode(F.flatten(F.transform("hs", lambda x: F.transform(F.filter("hs", lambda y: y["j"] > x["j"]), lambda y: F.xxhash64(x["j"], x["h"], y["j"], y["h"]))))).alias("key"))
    tables = scratch.table(tables, "tables")
    buckets = tables.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("doc"), F.lit(1 << 40))).alias("print"), F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high")
    buckets = buckets.groupBy("n", "print", "low").agg(F.min("key").alias("key"))
    members = scratch.table(tables.join(buckets, "key").select("doc", "low"), "members")
    scratch.drop("tables")

    pairs = members.filter("doc <> low").select(F.col("doc").alias("a"), F.col("low").alias("b")).distinct()
    pairs = scratch.table(pairs, "pairs")
    scratch.drop("members")
    clusters = components(pairs, scratch, "clusters").select(F.col("node").alias("doc"), F.col("component").alias("cluster"))
    large = scratch.table(clusters.groupBy("cluster").count().filter(F.col("count") > BLOCK).select("cluster"), "large")

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, part in pieces_of(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([s.tobytes() for s in _sets(part, shingle)], pa.binary())], ["doc_id", "set"])

    wanted = few(clusters.select(F.col("doc").alias("doc_id")))
    sets = scratch.table(map_batches(docs.join(wanted, "doc_id").dropDuplicates(["doc_id", "text"]), as_sets, "doc_id long, set binary"), "sets")

    in_large = clusters.join(large, "cluster", "left_semi").select(F.col("doc").alias("a"))
    stars = scratch.table(_confirm_pairs(pairs.join(in_large, "a", "left_semi"), sets, percent, scratch), "stars")
    thinned = components(stars, scratch, "thinned").withColumnRenamed("node", "doc")

    # what of a cluster is not yet one component; block numbers below `small` hold all but its largest component
    weight = reps.select("doc", (F.col("n_shingles") * 8).alias("bytes"))
    placed = scratch.table(clusters.join(thinned, "doc", "left").join(weight, "doc").select("cluster", "doc", "bytes", F.coalesce("component", "doc").alias("comp")), "placed")
    sizes = placed.groupBy("cluster", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    top = lambda c: F.max_by(c, F.struct("n", "comp"))
    sizes = sizes.groupBy("cluster").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), top("n").alias("top"), top("bytes").alias("top_bytes"), top("comp").alias("giant")).filter("comps > 1")
    blocks = lambda n, b: F.ceil(F.greatest(n / BLOCK, b / BLOCK_BYTES)).cast("int")
    alone = (F.col("n") <= BLOCK) & (F.col("bytes") <= BLOCK_BYTES)
    small, rest = blocks(F.col("n") - F.col("top"), F.col("bytes") - F.col("top_bytes")), blocks(F.col("top"), F.col("top_bytes"))
    sizes = sizes.select("cluster", "giant", alone.alias("alone"), F.when(alone, 1).otherwise(small).alias("small"), F.when(alone, 0).otherwise(rest).alias("rest"))
    rows = placed.join(scratch.table(sizes, "sizes"), "cluster")
    total = placed.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    bins = max(1, total.n // BLOCK, total.bytes // BLOCK_BYTES)
    rows = rows.withColumn("grp", F.when(F.col("alone"), -1 - F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.col("cluster")))
    rows = rows.withColumn("at", F.when((F.col("comp") == F.col("giant")) & (F.col("rest") > 0), F.col("small") + F.pmod(F.xxhash64("doc"), F.greatest("rest", F.lit(1)))).otherwise(F.pmod(F.xxhash64("doc"), F.col("small"))).cast("int"))
    meets = F.sequence(F.lit(0), F.when(F.col("at") < F.col("small"), F.col("small") + F.col("rest")).otherwise(F.col("small")).cast("int") - 1)
    rows = rows.withColumn("other", F.explode(meets))
    rows = rows.select("grp", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), (F.col("at") <= F.col("other")).alias("side"), "cluster", "doc", "comp")
    more = scratch.table(_confirm_blocks(rows.join(sets.withColumnRenamed("doc_id", "doc"), "doc"), percent), "more")
    comp = components(stars.unionAll(more), scratch, "linked")
    scratch.drop("sets", "pairs", "placed")

    of_set = reps.select(*digest, "doc").join(comp.withColumnRenamed("node", "doc"), "doc", "left").select(*digest, F.coalesce("component", "doc").alias("component_id"))
    out = sig.select("doc_id", *digest).join(of_set, digest, "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents at 85 per cent."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, Scratch(spark), percent=85)
