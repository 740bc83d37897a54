"""Token counts per section from one encoding of the whole document.

Every document is encoded once. Its tokens' byte spans are joined with the spans of its sections
(lines, or intervals given in a table), and a token that crosses section boundaries is allotted by a rule:

    "majority"  to the section that holds most of its bytes, of equals the first;
    "first"     to the section that holds its first byte, "last" to that of its last byte;
    "split"     to every section it touches, in proportion to the bytes.

Bytes outside all sections belong to none; a token is outside (section null) if the rule finds no section for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import map_batches, spread
from .textvec import laid_out, pieces_of
from .tokenruns import RunTable, load, split_runs

CHUNK = 2 << 20
RULES = ("majority", "first", "last", "split")
#: UTF-8 of the white space above ASCII (or what it starts with); texts that hold it are encoded in one piece.
_WIDE_SPACE = ("\x85".encode(), "\xa0".encode(), " ".encode(), b"\xe2\x80", " ".encode(), "　".encode())
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r\x1c\x1d\x1e\x1f", np.uint8))
_LETTER = np.isin(np.arange(256), np.frombuffer(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]), np.uint8))
_MARK = np.isin(np.arange(256), np.frombuffer(b".,", np.uint8))


class TokenSizes:
    """Byte lengths of the tokens of a byte-level tokenizer, whose words take one space before them along."""

    _kept: dict[str, TokenSizes] = {}

    def __init__(self, path: str):
        self.tok, self.special = load(path)
        self.special.values = {text: np.array([len(text)], np.int32) for text in self.special.ids}
        vocab = self.tok.get_vocab()
        self.size = np.zeros(max(vocab.values()) + 1, np.int32)
        spaced = np.zeros(len(self.size), bool)
        for token, i in vocab.items():
            self.size[i] = len(token)  # one character stands for one byte
            spaced[i] = token.startswith("Ġ")
        line = vocab["Ċ"]

        def encode(words: list[bytes]) -> list[np.ndarray]:
            texts = [w.decode() for w in words]
            out: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
            for head in (" ", ""):
                some = [i for i, t in enumerate(texts) if t.startswith(" ") == (head == " ")]
                if head:
                    cut = lambda ids: np.concatenate([np.flatnonzero(spaced[ids]), [len(ids)]])
                    made = split_runs(self.tok, [texts[i][1:] for i in some], lambda w: " " + " ".join(w), cut, lambda w: " " + w)
                else:
                    cut = lambda ids: np.concatenate([[0], np.flatnonzero(ids == line) + 1, [len(ids) + 1]])
                    made = split_runs(self.tok, [texts[i] for i in some], "\n".join, cut)
                    made = [m[:-1] if len(m) > 1 and m[-1] == line and texts[i] != "\n" and not texts[i].endswith("\n") else m for i, m in zip(some, made)]
                for i, m in zip(some, made):
                    out[i] = self.size[m]
            return out

        self.table = RunTable(encode)

    @classmethod
    def of(cls, path: str) -> TokenSizes:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Lengths of every token of each whole text; they add up to the text's bytes."""
        return self.special.around(texts, self.encode_plain)

    def encode_plain(self, texts: list[bytes]) -> list[np.ndarray]:
        """Token lengths of texts without special tokens."""
        wide = [any(s in t for s in _WIDE_SPACE) for t in texts]
        raw, begins = laid_out([b"" if w else t for w, t in zip(wide, texts)])
        last = np.zeros(len(raw), bool)
        last[begins[1:] - 1] = True  # the space after each text is no part of it
        space = _SPACE[raw] | last
        solid = ~space
        alone = np.zeros(len(raw), bool)  # a space or line feed between solid neighbours
        alone[1:-1] = ((raw[1:-1] == 32) | (raw[1:-1] == 10)) & solid[:-2] & solid[2:] & ~last[1:-1]
        opens = np.zeros(len(raw), bool)
        opens[begins[:-1]] = True
        opens |= alone
        opens[1:] |= alone[:-1] & (raw[:-1] == 10)
        mark = np.zeros(len(raw), bool)
        mark[1:-1] = _MARK[raw[1:-1]] & _LETTER[raw[:-2]] & (alone[2:] | last[2:])
        opens |= mark
        opens &= ~last
        at = np.flatnonzero(opens)
        to = np.concatenate([at[1:], [len(raw)]])
        to = np.minimum(to, (begins[1:] - 1)[np.searchsorted(begins, at, side="right") - 1]) if len(at) else to[:0]
        sizes, many = self.table.runs(raw, at, to)
        ends = np.concatenate([[0], np.cumsum(many)])[np.searchsorted(at, begins)]
        out = [sizes[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for i in np.flatnonzero(wide):
            out[i] = self.size[self.tok.encode(texts[i].decode(), add_special_tokens=False).ids]
        return out


def lines(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of the lines; a line feed belongs to the line it ends. An empty text has none."""
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    edges = np.unique(np.concatenate([[0], breaks, [len(text)]]))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def allot(sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens of each section (ascending, disjoint spans), tokens that cross into or out of it, and tokens outside."""
    b = np.cumsum(sizes, dtype=np.int64)
    a = b - sizes
    low = np.searchsorted(ends, a, side="right")  # the first section that ends after the token's start
    high = np.searchsorted(starts, b, side="left") - 1  # the last that starts before its end
    touched = np.maximum(high - low + 1, 0)
    token = np.repeat(np.arange(len(sizes)), touched)
    section = np.arange(len(token)) - np.repeat(np.cumsum(touched) - touched, touched) + np.repeat(low, touched)
    held = np.minimum(b[token], ends[section]) - np.maximum(a[token], starts[section])
    partial = held < sizes[token]
    crossing = np.bincount(section[partial], minlength=len(starts))
    if rule == "split":
        count = np.bincount(section, held / sizes[token], len(starts))
        return count, crossing, float(len(sizes) - count.sum())
    if rule == "first":
        pick = (starts[section] <= a[token]) & (a[token] < ends[section])
    elif rule == "last":
        pick = (starts[section] < b[token]) & (b[token] <= ends[section])
    else:
        order = np.lexsort((section, -held, token))
        lead = np.ones(len(order), bool)
        lead[1:] = token[order][1:] != token[order][:-1]
        pick = np.zeros(len(order), bool)
        pick[order[lead]] = True
    count = np.bincount(section[pick], minlength=len(starts)).astype(float)
    return count, crossing, float(len(sizes) - pick.sum())


def token_counts(docs: DataFrame, tokenizer_path: str, *, sections: DataFrame | None = None, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing, doc_tokens) per section of every document.

    sections: (doc_id, section int, start, end) in bytes of the UTF-8 text; lines, numbered from 0, if not given. Spans are clipped
    to the text; where they overlap, the shared bytes belong to the span that starts first. A row with section null counts tokens outside
    all sections, if there are any. n_crossing counts tokens that lie partly outside the section. A document without text has no tokens, and a row with
    section null and count 0; null ids and repeated documents stay. Rows of sections with nulls are left out. An empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    one = spread(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = one.schema["doc_id"].dataType.simpleString()
    with_spans = sections is not None
    if with_spans:
        spans = sections.select(F.col("doc_id").alias("owner"), F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("section").cast("int").alias("section")).alias("s"))
        spans = spans.dropna(subset=["owner", "s.start", "s.end", "s.section"]).groupBy("owner").agg(F.sort_array(F.collect_list("s")).alias("spans"))
        one = one.join(spans, one["doc_id"] == spans["owner"], "left").select("doc_id", "text", "spans")
    names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenSizes.of(tokenizer_path)
        for rows, part in pieces_of(batches, size=CHUNK):
            given = rows.column(2).to_pylist() if with_spans else None
            cols: list[list] = [[] for _ in names]
            for i, sizes in enumerate(tokens.encode(part)):
                if given is None:
                    spans = lines(part[i])
                    labels: list = list(range(len(spans)))
                else:
                    spans, labels, low = [], [], 0
                    for s in given[i] or ():
                        a, b = max(s["start"], low), min(s["end"], len(part[i]))
                        if a < b:
                            spans.append((a, b)), labels.append(s["section"])
                            low = b
                bounds = np.array(spans, np.int64).reshape(-1, 2)
                count, crossing, outside = allot(sizes, bounds[:, 0], bounds[:, 1], rule)
                n = len(labels)
                if outside > 1e-9 or not n:
                    n, labels, spans = n + 1, [*labels, None], [*spans, (None, None)]
                    count, crossing = np.append(count, outside), np.append(crossing, 0)
                for c, v in zip(cols, ([i] * n, labels, [s[0] for s in spans], [s[1] for s in spans], count.tolist(), crossing.tolist(), [len(sizes)] * n)):
                    c.extend(v)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], names)

    out = map_batches(one, run, f"doc_id {kind}, section int, start long, end long, n_tokens double, n_crossing long, doc_tokens long")
    if rule != "split":
        out = out.withColumn("n_tokens", F.col("n_tokens").cast("long"))
    return out.withColumnRenamed("doc_id", id_col)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of all documents."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
