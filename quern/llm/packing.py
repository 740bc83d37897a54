"""Sum-of-squares packing of documents into token sequences of a fixed length.

Counts N(g) of open sequences with a free gap g are kept, and every piece goes where the sum of
N(g) squared becomes smallest: into a sequence with some gap, or into a new one (of equal choices
the smallest gap). Only documents longer than a sequence are cut.

Pieces are dealt by a hash into groups of bounded size, packed alone, from long to short. The
sequences that a group leaves with a wide gap are then dissolved and packed again in fewer groups,
each again of bounded size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, fresh, map_batches, map_groups, spread
from .textvec import LOWER, laid_out, pieces_of
from .tokenruns import RunTable, load, split_runs

GROUP_ROWS = 8192
CHUNK = 2 << 20
_GAP, _MARK, _LETTER = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b" \n", b".,", b"abcdefghijklmnopqrstuvwxyz"))


class WordTokens:
    """Ids of a lower-casing tokenizer whose tokens never cross a space or a line feed, nor from a letter into a mark."""

    _kept: dict[str, WordTokens] = {}

    def __init__(self, path: str):
        tok, self.special = load(path)
        ends = np.zeros(tok.get_vocab_size() + 1, bool)
        for token, i in tok.get_vocab().items():
            ends[i] = token.endswith("</w>")
        cut = lambda ids: np.concatenate([[0], np.flatnonzero(ends[ids]) + 1])
        self.table = RunTable(lambda words: split_runs(tok, [w.decode() for w in words], " ".join, cut))

    @classmethod
    def of(cls, path: str) -> WordTokens:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each whole text, int32."""
        return self.special.around(texts, self.encode_plain)

    def encode_plain(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts without special tokens."""
        raw, begins = laid_out(texts)
        raw = LOWER[raw]
        inside = ~_GAP[raw]
        mark = _MARK[raw]
        mark[1:] &= _LETTER[raw[:-1]]  # a mark after a letter and before a gap stands alone
        mark[0] = False
        mark[:-1] &= ~inside[1:]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | mark[1:]
        closes[:-1] &= ~inside[1:] | mark[1:]
        at, to = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        ids, sizes = self.table.runs(raw, at, to)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(at, begins)]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def token_pieces(docs: DataFrame, tokenizer_path: str, *, length: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document's token run.

    A document is its tokens and then end_id; a null or empty text is end_id alone. A run longer
    than the sequence is cut into full pieces and a last one. Null ids and repeated rows stay.
    """
    one = spread(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    close = np.array([end_id], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens.of(tokenizer_path)
        for some, part in pieces_of(batches, size=CHUNK):
            rows, piece, start, size, crc, ids = [], [], [], [], [], []
            for i, run in enumerate(words.encode(part)):
                packed = np.concatenate([run, close]).astype("<u4")
                for k, b in enumerate(range(0, len(packed), length)):
                    cut = packed[b : b + length]
                    rows.append(i), piece.append(k), start.append(b), size.append(len(cut)), crc.append(zlib.crc32(cut))
                    if with_ids:
                        ids.append(cut)
            cols = [some.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                ends = np.cumsum([0, *size]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = one.schema["id"].dataType.simpleString()
    out = map_batches(one, run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each size, in the order given, and each sequence's free gap."""
    counts = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    seq, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        best, cost = capacity, (2 * int(counts[capacity - s]) + 1 if s < capacity else 0)
        if s < capacity:
            # change of the sum of squares if the piece goes into a gap g: N(g) loses one, N(g - s) gains one
            delta = 2 * (counts[: capacity - s] - counts[s:capacity]) + 2
            delta[0] = 1 - 2 * counts[s]
            delta[counts[s:capacity] == 0] = np.iinfo(np.int64).max
            k = int(delta.argmin())
            if delta[k] <= cost:
                best = s + k
        if best == capacity:
            b = len(gaps)
            gaps.append(capacity)
        else:
            b = stacks[best].pop()
            counts[best] -= 1
        seq[i], offset[i] = b, capacity - best
        gaps[b] = best - s
        if best > s:
            counts[best - s] += 1
            stacks[best - s].append(b)
    return seq, offset, np.array(gaps, np.int64)


def _round(pieces: DataFrame, groups: int, salt: int, capacity: int) -> DataFrame:
    """Deal pieces into so many groups and pack each; adds sequence, offset and gap."""
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key"], ascending=[False, True], kind="stable")
        seq, offset, gaps = pack(pdf["length"].to_numpy(), capacity)
        return pdf[["key", "length"]].assign(sequence_id=(salt << 56) + (pdf["grp"].to_numpy() << 24) + seq, offset=offset, gap=gaps[seq])

    return map_groups(dealt.sparkSession, dealt.groupBy("grp"), run, "key long, length long, sequence_id long, offset long, gap long")


def pack_pieces(pieces: DataFrame, scratch: Scratch, *, capacity: int = 4096, group_rows: int = GROUP_ROWS, wide: float = 0.01, name: str = "pack") -> DataFrame:
    """Adds sequence_id and offset to pieces (any columns, with length; columns of these two names are replaced).

    Every row is packed once, repeated rows too. Gapless offsets from 0 in every sequence. Lengths
    must lie between 1 and the capacity. An empty table gives an empty result.
    """
    pieces = pieces.drop("sequence_id", "offset")
    own = fresh("key", pieces.columns)
    keyed = scratch.table(pieces.withColumn(own, F.monotonically_increasing_id()), f"{name}_keyed")
    left, parts, salt = keyed.select(F.col(own).alias("key"), "length"), [], 1
    n = left.count()
    while True:
        groups = max(1, -(-n // group_rows))
        packed = scratch.table(_round(left, groups, salt, capacity), f"{name}_{salt}")
        again = packed.filter(F.col("gap") > wide * capacity).select("key", "length")
        again_n = again.count() if groups > 1 else 0
        if not again_n or salt == 8 or -(-again_n // group_rows) >= groups:
            parts.append(packed)
            break
        parts.append(packed.filter(F.col("gap") <= wide * capacity))
        left, n, salt = again, again_n, salt + 1
    placed = parts[0]
    for p in parts[1:]:
        placed = placed.unionAll(p)
    return keyed.join(placed.select(F.col("key").alias(own), "sequence_id", "offset"), own).drop(own)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 4096 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pack_pieces(pieces, Scratch(spark))
