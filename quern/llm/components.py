"""Connected components as DataFrames: hook every root to its smallest neighbour, contract, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Tables of the rounds are written with about so many rows a file, not with one file per shuffle partition.
FILE_ROWS = 250_000


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(a, b) links to (node, component): the smallest node reachable, for nodes that have links.

    Each round joins on roots and keeps a row per distinct root pair, so the edges shrink; the
    rounds are about the logarithm of a component's diameter. Null ends and self-links count for
    nothing; without links the result is empty. Nothing is collected but a count, which also says how many
    files a round's tables need.
    """
    left = scratch.table(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).filter("a <> b").distinct(), f"{name}_edges0")
    labels, r, n = None, 0, left.count()
    total = 2 * n  # nodes at most
    files = lambda df, rows: df.coalesce(rows // FILE_ROWS + 1)
    if not n:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while n:
        both = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("parent"))
        hooks = scratch.table(files(hooks, 2 * n), f"{name}_hooks{r}_0")
        k = 0
        while True:  # pointer jumping, until each node points to a root
            up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            jumped = hooks.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved"))
            k += 1
            jumped = scratch.table(files(jumped, 2 * n), f"{name}_hooks{r}_{k}")
            moved = jumped.filter("moved").limit(1).count()
            hooks = jumped.select("node", "parent")
            scratch.drop(f"{name}_hooks{r}_{k - 1}")
            if not moved:
                break
        at = hooks.select(F.col("node").alias("component"), F.col("parent").alias("root"))
        if labels is None:
            new = hooks.select("node", F.col("parent").alias("component"))
        else:
            new = labels.join(at, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        new = scratch.table(files(new, total), f"{name}_labels{r}")
        a, b = (hooks.select(F.col("node").alias(c), F.col("parent").alias(f"r{c}")) for c in "ab")
        rest = left.join(a, "a").join(b, "b").filter("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct()
        rest = scratch.table(files(rest, n), f"{name}_edges{r + 1}")
        scratch.drop(f"{name}_edges{r}", f"{name}_hooks{r}_{k}", *([f"{name}_labels{r - 1}"] if r else []))
        labels, left, r = new, rest, r + 1
        n = left.count()
    return labels
