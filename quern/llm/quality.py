"""Quality scores learned from preference pairs (Bradley-Terry).

Every document gets a feature vector of its whole text. Pairs of a label-1 and a label-0 document
say which is preferred; the weights minimise the logistic loss of the score difference,
which is linear in the feature difference. The cut is a quantile of the training scores,
and scores are put on 0 to 1 by the logistic function such that the cut lies at the given mark.

Every labelled row takes part: rows are dealt to groups by a hash of their id, and within a group each label-1 document is
compared with each label-0 one. Newton steps add up gradient and curvature of all these pairs over the cluster, and the
cut comes from counts of all training scores. A caller may bound the rows (max_rows); the queries don't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, map_batches, map_groups, spread
from .textvec import Words, pieces_of

FEATURES = [
    "words", "word_length", "long_words", "upper", "shouted", "digits", "symbols", "marked_words", "other_bytes",
    "repeats", "distinct", "distinct_pairs", "same_lines", "line_words", "pipes", "worst_shouted", "worst_marked", "worst_repeats", "worst_pipes",
]
WINDOW = 24


def _kinds() -> dict[str, np.ndarray]:
    """Byte classes as 0/1 tables."""
    t = {k: np.zeros(256, np.int32) for k in ("upper", "lower", "digit", "symbol", "high")}
    t["upper"][0x41:0x5B] = 1
    t["lower"][0x61:0x7B] = 1
    t["digit"][0x30:0x3A] = 1
    t["high"][0x80:] = 1
    for b in b"!\"#$%&*+/<=>?@[\\]^_`{|}~":
        t["symbol"][b] = 1
    return t


KINDS = _kinds()


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text, each between 0 and about 1; an empty text has all 0."""
    w = Words(texts)
    n = np.diff(w.first)
    rows = np.zeros((len(texts), len(FEATURES)))
    some = np.flatnonzero(n)
    if not len(some):
        return rows
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    owner = np.repeat(np.arange(len(texts)), n)
    shift = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[owner]
    at, to = w.start + shift, w.end + shift
    count = {}
    for k, table in KINDS.items():
        c = np.concatenate([[0], np.cumsum(table[raw])])
        count[k] = (c[to] - c[at]).astype(float)
    size = (to - at).astype(float)
    letters = count["upper"] + count["lower"]
    last = raw[to - 1]
    begins = w.first[:-1][some]
    total = n[some].astype(float)
    per_doc = lambda x: np.add.reduceat(x.astype(float), begins)
    inner = np.arange(len(owner)) - w.first[:-1][owner]
    again = np.zeros(len(owner), bool)
    for back in (1, 2):
        again[back:] |= (w.hash[back:] == w.hash[:-back]) & (inner[back:] >= back)
    shouted = (count["upper"] >= 2) & (count["lower"] == 0)
    marked = KINDS["symbol"][last] == 1
    pipe = (size == 1) & (raw[at] == ord("|"))
    marked &= ~pipe
    nbytes = per_doc(size)

    def distinct(keys: np.ndarray, own: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, own))
        k, o = keys[order], own[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[new], minlength=len(texts))[some]

    def worst(x: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(x.astype(np.int64))])
        end = np.minimum(np.arange(len(x)) + WINDOW, w.first[1:][owner])
        return np.maximum.reduceat((c[end] - c[:-1]) / WINDOW, begins)

    pairs = w.hash * np.uint64(3) + np.where(inner > 0, np.roll(w.hash, 1), np.uint64(0))
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    line = breaks[at]
    opens = np.ones(len(line), bool)
    opens[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(opens)
    line_hash = np.add.reduceat(w.hash * (np.arange(len(w.hash), dtype=np.uint64) - np.repeat(heads, np.diff([*heads, len(opens)])).astype(np.uint64) + np.uint64(1)), heads)
    lines = np.bincount(owner[heads], minlength=len(texts))[some].astype(float)
    values = {
        "words": np.log1p(total) / 10,
        "word_length": np.minimum(nbytes / total / 20, 2),
        "long_words": per_doc(size > 25) / total,
        "upper": per_doc(count["upper"]) / np.maximum(per_doc(letters), 1),
        "shouted": per_doc(shouted) / total,
        "digits": per_doc(count["digit"]) / nbytes,
        "symbols": per_doc(count["symbol"]) / nbytes,
        "marked_words": per_doc(marked) / total,
        "other_bytes": per_doc(count["high"]) / nbytes,
        "repeats": per_doc(again) / total,
        "distinct": np.log1p(distinct(w.hash, owner)) / np.log1p(total),
        "distinct_pairs": np.log1p(distinct(pairs, owner)) / np.log1p(total),
        "same_lines": 1 - distinct(line_hash, owner[heads])[: len(some)] / lines if len(heads) else 0,
        "line_words": np.log1p(total / lines) / 8,
        "pipes": per_doc(pipe) / total,
        "worst_shouted": worst(shouted),
        "worst_marked": worst(marked),
        "worst_repeats": worst(again),
        "worst_pipes": worst(pipe),
    }
    for j, name in enumerate(FEATURES):
        rows[some, j] = values[name]
    return rows


def document_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0 ..): the features of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, part in pieces_of(batches):
            x = features(part).astype(np.float32)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c) for c in x.T)], names)

    names = ["doc_id", *(f"f{j}" for j in range(len(FEATURES)))]
    one = spread(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = one.schema["doc_id"].dataType.simpleString()
    return map_batches(one, run, f"doc_id {kind}, " + ", ".join(f"{c} float" for c in names[1:]))


def fit(x: np.ndarray, y: np.ndarray, *, pairs: int = 100_000, l2: float = 1e-4, steps: int = 60, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, scale, weights, cut) from features and labels.

    Newton steps on the mean logistic loss of `pairs` preference pairs. The cut is the quantile
    of the scores that best separates the labels (mean of both classes' recalls, ties to the lowest).
    With one class only the weights are 0.
    """
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - mean) / scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return mean, scale, w, -1.0
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = -(d * (1 - p)[:, None]).mean(0) + l2 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + (l2 + 1e-6) * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-4:
            break
    s = z @ w
    cuts = np.quantile(s, np.linspace(0, 1, 401))
    good_s, bad_s = np.sort(s[good]), np.sort(s[bad])
    recall = 1 - np.searchsorted(good_s, cuts) / len(good) + np.searchsorted(bad_s, cuts) / len(bad)
    return mean, scale, w, float(cuts[int(recall.argmax())])


def smallest(rows: DataFrame, h: Column, most: int, ties: list[str]) -> DataFrame:
    """The `most` rows of the smallest hashes h (64 bits, signed), in order.

    So that no partition keeps and sends `most` rows of its own, rows are counted first and a hash above the share
    needed, with room for chance, is left out before the rows are ordered. Should chance or many copies of one key leave
    too few, all rows are ordered.
    """
    n = rows.count()
    ordered = lambda df: df.orderBy(h, *ties).limit(most)
    share = (most + 10 * most**0.5 + 100) / max(n, 1)
    if share >= 1:
        return ordered(rows)
    near = rows.filter(h < F.lit(int(share * 2.0**64) - 2**63))
    return ordered(near if near.limit(most).count() == most else rows)


#: Rows of the rarer label in a group, as expected; each is compared with all rows of the other label there, worked off in blocks of BLOCK.
GROUP, BLOCK = 64, 4096
BINS = 1 << 14


def _blocks(labelled: DataFrame, low: int, high: int, rare: int, scratch: Scratch, name: str) -> DataFrame:
    """(good, bad): the feature rows of the groups as packed floats; rows of the commoner label are in one block each, those of the rarer one in all blocks of their group."""
    cols = [f"f{j}" for j in range(len(FEATURES))]
    groups = max(1, low // GROUP)
    parts = -(-high // (groups * BLOCK))
    h = F.xxhash64("doc_id", *cols)
    group = F.pmod(F.xxhash64("doc_id"), F.lit(groups))
    part = F.when(F.col("quality") == rare, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.pmod(F.shiftrightunsigned(h, 20), F.lit(parts)).cast("int")))
    dealt = labelled.select(group.alias("g"), F.explode(part).alias("part"), "quality", h.alias("h"), *cols)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", *cols], kind="stable")
        return pd.DataFrame({n: [pdf.loc[pdf["quality"] == q, cols].to_numpy("<f4").tobytes()] for n, q in (("good", 1), ("bad", 0))})

    return scratch.table(map_groups(scratch.spark, dealt.groupBy("g", "part"), pack, "good binary, bad binary"), f"{name}_blocks")


def pair_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Over all pairs of a row of x and one of y: their number, gradient and curvature of the log-likelihood that x is preferred, in one flat array."""
    m, s, t = len(w), x @ w, y @ w
    grad, curve = np.zeros(m), np.zeros((m, m))
    for at in range(0, len(x), 512):
        u = x[at : at + 512]
        p = 1 / (1 + np.exp(-np.clip(s[at : at + 512, None] - t[None, :], -30, 30)))
        grad += (1 - p).sum(1) @ u - (1 - p).sum(0) @ y
        p *= 1 - p
        cross = u.T @ (p @ y)
        curve += (u * p.sum(1)[:, None]).T @ u + (y * p.sum(0)[:, None]).T @ y - cross - cross.T
    return np.concatenate([[len(x) * len(y)], grad, curve.ravel()])


def fit_all(labelled: DataFrame, scratch: Scratch, *, l2: float = 1e-4, steps: int = 60, name: str = "quality") -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, scale, weights, cut) as fit() gives them, from a written table (doc_id, quality, f0 ..) of any size.

    All pairs within the groups count alike; up to 2 * GROUP - 1 rows of the rarer label are one group, so all pairs there are. The cut is sought among the quantiles of
    all scores, each taken to the next of BINS equal steps between the smallest and the largest score. The driver gets sums and counts only.
    """
    cols = [f"f{j}" for j in range(len(FEATURES))]
    m = len(cols)
    found = labelled.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0)), *(F.avg(c) for c in cols), *(F.stddev_pop(c) for c in cols)).first()
    n, good, w = found[0], int(found[1]), np.zeros(m)
    if not n:
        return np.zeros(m), np.ones(m), w, -1.0
    mean, scale = np.array(found[2 : 2 + m], float), np.maximum(np.array(found[2 + m :], float), 1e-6)
    if good in (0, n):
        return mean, scale, w, -1.0
    blocks = _blocks(labelled, min(good, n - good), max(good, n - good), int(good <= n - good), scratch, name)

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + m + m * m)
            for batch in batches:
                for pair in zip(*(c.to_pylist() for c in batch.columns)):
                    total += pair_sums(*((np.frombuffer(raw, "<f4").reshape(-1, m).astype(float) - mean) / scale for raw in pair), w)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        return sum(np.frombuffer(r.total) for r in map_batches(blocks, run, "total binary").collect())

    for _ in range(steps):
        total = sums(w)
        grad = l2 * w - total[1 : 1 + m] / total[0]
        move = np.linalg.solve(total[1 + m :].reshape(m, m) / total[0] + (l2 + 1e-6) * np.eye(m), grad)
        w = w - move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-4:
            break
    scored = labelled.select("quality", _linear(cols, mean, scale, w).alias("s"))
    low, high = scored.agg(F.min("s"), F.max("s")).first()
    width = max(high - low, 1e-12) / BINS
    counted = scored.groupBy(F.least(F.floor((F.col("s") - low) / width), F.lit(BINS)).cast("int").alias("bin"), "quality").count().collect()
    count = np.zeros((2, BINS + 1), np.int64)
    for r in counted:
        count[r.quality, r.bin] = r["count"]
    below = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(count, 1)], 1)  # of either label, below the lower edge of each bin
    edges = np.unique(np.searchsorted(below.sum(0), np.linspace(0, 1, 401) * n))
    recall = 1 - below[1, edges] / good + below[0, edges] / (n - good)
    return mean, scale, w, float(low + width * edges[int(recall.argmax())])


def _linear(cols: list[str], mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> Column:
    return sum(((F.col(c).cast("double") - float(m)) * float(k / s) for c, m, s, k in zip(cols, mean, scale, w)), F.lit(0.0))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Is the crc32 of the id as text a multiple of `folds`? A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, mark: float = 0.3, max_rows: int | None = None, name: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    labels: (doc_id, quality 0 or 1); rows with nulls or other values, ids with both labels and
    held-out ids teach nothing; all other labelled rows are learned from, with max_rows only so many of the smallest id hashes. Without
    labels of both kinds every score is above the mark. Null and empty texts get a score, too.
    Repeated rows come out as often; an empty table gives an empty result; further columns are not read.
    """
    x = scratch.table(document_features(docs, id_col=id_col, text_col=text_col), f"{name}_features")
    cols = [f"f{j}" for j in range(len(FEATURES))]
    clear = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").select("doc_id", "quality")
    labelled = x.filter(~held_out(F.col("doc_id"))).join(clear, "doc_id")
    if max_rows is None:
        mean, scale, w, cut = fit_all(scratch.table(labelled.select("doc_id", F.col("quality").cast("int").alias("quality"), *cols), f"{name}_labelled"), scratch, name=name)
    else:
        train = smallest(labelled, F.xxhash64("doc_id"), max_rows, ["doc_id", *cols]).select("quality", *cols).toPandas()
        none = np.zeros(len(cols)), np.ones(len(cols)), np.zeros(len(cols)), -1.0
        mean, scale, w, cut = fit(train[cols].to_numpy(float), train["quality"].to_numpy()) if len(train) else none
    raw = _linear(cols, mean, scale, w)
    value = 1 / (1 + F.exp(-(raw - F.lit(cut)) + F.lit(float(np.log((1 - mark) / mark)))))
    out = x.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), value.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= mark).cast("int")).withColumnRenamed("doc_id", id_col)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score_documents(docs, labels, Scratch(spark))
