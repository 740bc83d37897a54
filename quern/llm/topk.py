"""Exact top-k inner-product search with a ball tree per shard.

Rows are dealt into shards of bounded size, queries into blocks of bounded size. A shard's rows form a
ball tree; a query walks it best bound first, where a node's bound is q.c + |q| r (centre and
radius of its ball), and stops when no bound reaches the current kth score. That score is shared: each
query first searches one shard, and takes the kth score found there to all the others.

A shard's share of the answers is k rows per query, so what is ranked in the end is small.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch, map_groups

LEAF = 64
SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
_SAFE = 1e-9


class BallTree:
    """Rows split at the median of their widest direction until a node is a leaf."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(self.spans)
            y = x[order[a:b]].astype(float)
            centre = y.mean(0)
            self.centres.append(centre)
            self.radii.append(float(np.sqrt(((y - centre) ** 2).sum(1).max())) if b > a else 0.0)
            self.spans.append((a, b))
            self.children.append(None)
            if parent >= 0:
                left, right = self.children[parent]
                self.children[parent] = (node, right) if side == 0 else (left, node)
            if b - a > leaf and self.radii[-1] > 0:
                far = y[((y - centre) ** 2).sum(1).argmax()]
                along = (y - centre) @ (far - centre)
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(along, half)]
                self.children[node] = (-1, -1)
                todo += [(a + half, b, node, 1), (a, a + half, node, 0)]
        self.ids, self.x = ids[order], x[order]
        self.centre_matrix, self.radius = np.array(self.centres), np.array(self.radii)
        big = float(np.abs(self.x).max()) if self.x.size else 0.0
        self.limit = big

    def search(self, q: np.ndarray, k: int, own: int | None, floor: int | None) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, of those that reach the floor; own is left out."""
        qf = q.astype(float)
        norm = float(np.sqrt(qf @ qf))
        bound = self.centre_matrix @ qf + norm * self.radius
        bound += _SAFE * (np.abs(bound) + norm * (1 + self.limit))
        exact = float(np.abs(q).max(initial=0)) * self.limit * max(len(q), 1) < 2**53
        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst on top
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            kth = best[0][0] if len(best) == k else floor
            if kth is not None and -b < kth:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    heapq.heappush(heap, (-bound[child], child))
                continue
            a, z = self.spans[node]
            if exact:
                scores = (self.x[a:z].astype(float) @ qf).astype(np.int64)
            else:
                scores = self.x[a:z] @ q
            hits = range(z - a) if kth is None else np.flatnonzero(scores >= kth).tolist()
            for i in hits:
                s, row = int(scores[i]), int(self.ids[a + i])
                if row == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -row))
                elif (s, -row) > best[0]:
                    heapq.heapreplace(best, (s, -row))
        return [(s, -row) for s, row in best]


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double; null if it is null or a component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in column]) if len(column) else np.zeros((0, 0), np.int64)


def top_k(rows: DataFrame, queries: DataFrame, scratch: Scratch, *, k: int = 5, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): every query's k highest inner products over rows, its own id left out.

    rows and queries: (vec_id long, v array<long>). Rows with a null id or vector take no part, nor do
    rows of another width than the query. All are given if there are fewer than k; ties go to the
    smaller id. A repeated id is one candidate per row. Empty tables give an empty result.
    """
    rows = scratch.table(rows.select("vec_id", "v").dropna().withColumn("d", F.size("v")), "rows")
    queries = scratch.table(queries.select(F.col("vec_id").alias("query_id"), "v").dropna().distinct().withColumn("d", F.size("v")), "queries")
    n, nq = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-nq // block_queries))
    hashed = lambda c, n, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(n)).cast("int")
    kind = "query_id long, vec_id long, score long"

    def searched(asked: DataFrame, to: Column) -> DataFrame:
        """asked (query_id, v, d, floor, block) in the shards of `to`."""
        left = rows.withColumn("shard", hashed("vec_id", shards, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = asked.withColumn("shard", F.explode(to))

        def run(key: tuple, ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            if ours.empty or theirs.empty:
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
            tree = BallTree(ours["vec_id"].to_numpy(), _matrix(ours["v"]))
            qid, rid, score = [], [], []
            for q, v, low in zip(theirs["query_id"], theirs["v"], theirs["floor"]):
                for s, row in tree.search(np.asarray(v, np.int64), k, q, None if pd.isna(low) else int(low)):
                    qid.append(q), rid.append(row), score.append(s)
            return pd.DataFrame({"query_id": qid, "vec_id": rid, "score": score}, dtype="int64")

        return map_groups(left.sparkSession, left.groupBy("d", "shard", "block").cogroup(right.groupBy("d", "shard", "block")), run, kind)

    asked = queries.withColumn("block", hashed("query_id", blocks, 2)).withColumn("home", hashed("query_id", shards, 3))
    first = scratch.table(searched(asked.withColumn("floor", F.lit(None).cast("long")), F.array("home")), "first")
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).select("query_id", F.when(F.col("n") >= k, F.col("floor")).alias("floor"))
    rest = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))
    found = first
    if shards > 1:
        found = first.unionAll(searched(asked.join(floors, "query_id", "left"), rest))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """Top 5 of every vector whose id is divisible by 50, against all."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), Scratch(spark))
