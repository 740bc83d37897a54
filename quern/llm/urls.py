"""URL verdicts: explicit rules first, else gradient-boosted trees on lexical features.

The trees learn from labelled urls; the query takes those urls that a rule decides. The
counts behind the suffix features cover all labelled rows, the fit sees at most max_rows different ones of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import smallest
from .scratch import Scratch, map_batches

FEATURES = ["length", "host_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "marks", "host_digits", "last_length", "suffix1", "suffix2"]
#: Rule to verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased; else empty. Any other character, NUL and line feeds too, is part of it."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; empty without ://."""
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (host/path) that fits the host or a parent of it and starts the path; null if none does."""
    tests = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        tests.append(((host == name) | host.endswith("." + name)) & path.startswith(slash + rest))
    return F.coalesce(*(F.when(t, F.lit(r)) for t, r in zip(tests, sorted(rules, key=lambda r: (-len(r), r)))), F.lit(None).cast("string"))


def lexical(urls: list[bytes], hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
    """One row of FEATURES but the suffix rates per url."""
    n = len(urls)
    size = np.fromiter(map(len, urls), np.int64, n)
    owner = np.repeat(np.arange(n), size)
    raw = np.frombuffer(b"".join(urls), np.uint8)
    count = lambda mask: np.bincount(owner[mask], minlength=n).astype(float)
    table = np.bincount(owner * 256 + raw, minlength=n * 256).reshape(n, 256)
    share = table / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    digit = (raw >= 48) & (raw <= 57)
    query = [u.partition(b"?")[2].partition(b"#")[0] for u in urls]
    mark = np.isin(raw, np.frombuffer(b"-_%~.@+", np.uint8))
    return np.column_stack([
        size, [len(h) for h in hosts], [h.count(b".") + 1 if h else 0 for h in hosts], [sum(map(bool, p.split(b"/"))) for p in paths], count(digit) / np.maximum(size, 1), entropy,
        [sum(map(bool, q.split(b"&"))) for q in query], count(mark), [sum(48 <= c <= 57 for c in h) for h in hosts], [len(p.rpartition(b"/")[2]) for p in paths],
    ]).astype(float)


class Trees:
    """Gradient-boosted regression trees on the logistic loss, over quantile bins."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, smooth: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.smooth = rounds, depth, rate, bins, smooth
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
        """y: 0 or 1, weight: of each row, 1 if not given. Without rows the probability is 1/2 everywhere, with one class it leans to it."""
        if not len(y):
            return self
        weight = np.ones(len(y)) if weight is None else weight / weight.mean()
        p = ((y * weight).sum() + self.smooth) / (weight.sum() + 2 * self.smooth)
        self.base = float(np.log(p / (1 - p)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        coded = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
            nodes = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
            at = np.zeros(len(y), np.int64)
            for node in range(nodes):
                here = at == node
                if not here.any():
                    continue
                g, h = grad[here], hess[here]
                value[node] = self.rate * g.sum() / (h.sum() + self.smooth)
                if node >= 2**self.depth - 1:
                    continue
                best, whole = 1e-3, g.sum() ** 2 / (h.sum() + self.smooth)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gs = np.cumsum(np.bincount(coded[here, j], g, len(e) + 1))[:-1]
                    hs = np.cumsum(np.bincount(coded[here, j], h, len(e) + 1))[:-1]
                    gain = gs**2 / (hs + self.smooth) + (g.sum() - gs) ** 2 / (h.sum() - hs + self.smooth) - whole
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], j, e[k]
                if feature[node] >= 0:
                    at[here] = 2 * node + 1 + (x[here, feature[node]] > cut[node])
            self.trees.append((feature, cut, value))
            score += value[at]
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]), at)
            score += value[at]
        return 1 / (1 + np.exp(-score))


def _with_lexical(rows: DataFrame) -> DataFrame:
    """Adds l0 .. to rows (key, url, host, path, suffix1, suffix2, label)."""
    names = [f"l{j}" for j in range(len(FEATURES) - 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                get = lambda c: [(v or "").encode() for v in part.column(c).to_pylist()]  # noqa: E731, B023
                x = lexical(get("url"), get("host"), get("path"))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c) for c in x.T)], [*part.schema.names, *names])

    return map_batches(rows, run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), *(f"{c} double" for c in names)]))


def judge(pages: DataFrame, scratch: Scratch, *, rules: dict[str, str] = RULES, labelled: DataFrame | None = None, max_rows: int = 20_000, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability) of every row.

    labelled: (url, verdict); by default those urls of pages that a rule decides. Rows with null are left out of
    it. Without labelled urls the method allows. A null url, or one without ://, has an empty host and path and is
    judged by the method. Repeated rows and null ids stay, an empty table gives an empty result.
    """
    def parts(df: DataFrame, *keep: Column) -> DataFrame:
        out = df.select(*keep, F.col("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        return out.withColumns({"suffix1": F.substring_index("host", ".", -1), "suffix2": F.substring_index("host", ".", -2)})

    rows = parts(pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("url")), F.col("key")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = reduce(lambda c, r: c.when(F.col("rule") == r, rules[r]), rules, F.when(F.lit(False), "")) if rules else F.lit(None).cast("string")
    if labelled is None:
        known = rows.filter("rule is not null").select("url", "host", "path", "suffix1", "suffix2", (verdict == "block").cast("int").alias("label"))
    else:
        known = parts(labelled.select("url", "verdict").dropna(), (F.col("verdict") == "block").cast("int").alias("label"))
    rates = {}
    prior = known.agg(F.sum("label").alias("s"), F.count("*").alias("n")).first()
    p = ((prior.s or 0) + 1) / (prior.n + 2)
    for c in ("suffix1", "suffix2"):
        rates[c] = scratch.table(known.groupBy(c).agg(F.sum("label").alias(f"{c}_s"), F.count("*").alias(f"{c}_n")), f"rate_{c}")

    def rated(df: DataFrame, own: bool) -> DataFrame:
        for c in ("suffix1", "suffix2"):  # a labelled url and its copies don't count in its own suffix rate
            less = F.col("copies") if own else F.lit(0)
            good = F.coalesce(F.col(f"{c}_s"), F.lit(0)) - (less * F.col("label") if own else less)
            df = df.join(rates[c], c, "left").withColumn(f"{c}_rate", (good + 10 * p) / (F.coalesce(F.col(f"{c}_n"), F.lit(0)) - less + 10))
        return df

    cols = [*(f"l{j}" for j in range(len(FEATURES) - 2)), "suffix1_rate", "suffix2_rate"]
    # copies of a url come in once, with their number as weight, so one that is copied much doesn't fill the sample
    different = scratch.table(known.groupBy("url", "label").agg(*(F.first(c).alias(c) for c in ("host", "path", "suffix1", "suffix2")), F.count("*").alias("copies")), "different")
    sample = scratch.table(smallest(different, F.xxhash64("url"), max_rows, ["url", "label"]), "sample")
    train = rated(_with_lexical(sample), True).orderBy("url", "label").select("label", "copies", *cols).toPandas()
    model = Trees().fit(train[cols].to_numpy(float), train["label"].to_numpy(float), np.log1p(train["copies"].to_numpy(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols]) if batch.num_rows else np.zeros((0, len(cols)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(model.probability(x))], [*kept, "block_probability"])

    kept = ["key", "host", "path", "rule"]
    kind = rows.schema["key"].dataType.simpleString()
    full = map_batches(rated(_with_lexical(rows), False), run, f"key {kind}, host string, path string, rule string, block_probability double")
    return full.select(F.col("key").alias(id_col), "host", "path", "rule", F.coalesce(verdict, F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")).alias("verdict"), "block_probability")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' urls."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark)).drop("block_probability")
