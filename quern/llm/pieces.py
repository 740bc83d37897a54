"""SentencePiece BPE encoding by backtracking, and decoding.

An Aho-Corasick automaton lists every piece that matches at every place. The encoder walks
left to right, tries the longest piece first, and accepts it only if it stands beside the
piece before it in the encoding of the two pieces' joined string (found by re-merging, and
kept per pair). A place from which nothing fits is marked in a bit field and never tried again.

No piece of the vocabulary crosses from a non-space into a space or a line feed, so texts are
cut there, and chunks again wherever two neighbours stand side by side in no piece. Each distinct
chunk is encoded once per worker and kept, up to a fixed number.
Runs of several spaces take the merge procedure itself, as the space pieces share one score.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import map_batches, spread
from .textvec import laid_out, pieces_of
from .tokenruns import RunTable

SPACE = "▁"
KEPT_CHUNKS = 250_000
KEPT_LENGTH = 48
ROWS = 256
CHUNK = 2 << 20
_LETTER = np.isin(np.arange(256), np.frombuffer(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]), np.uint8))


class PieceModel:
    """A BPE model file with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        if spec.model_type != 2 or not spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.out = [bytes([int(p.piece[3:-1], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() if p.type == 1 else b"" for p in proto.pieces]
        self.out[proto.trainer_spec.unk_id] = proto.trainer_spec.unk_surface.encode()
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("pieces must not run from a character into a space or a line feed")
        self.letters = {c for p in self.ids for c in p}
        self.inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: All symbols that can be: the pieces, and characters that only stand inside of some.
        self.symbols = [*self.ids, *sorted(self.letters - self.ids.keys())]
        self.sizes = [len(p) for p in self.symbols]
        self.coded = [[self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()] for p in self.symbols]
        self.find = ahocorasick.Automaton()
        for k, p in enumerate(self.symbols):
            self.find.add_word(p, k)
        self.find.make_automaton()
        self.pairs: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """The merge procedure: the best-scored adjacent pair first, the leftmost of equals."""
        symbols, score = list(text), self.score
        if len(symbols) < 2:
            return symbols
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap = [(-score[x], i, x) for i in range(len(symbols) - 1) if (x := symbols[i] + symbols[i + 1]) in score]
        heapq.heapify(heap)
        n = len(symbols)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j] = joined, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := joined + symbols[after[i]]) in score:
                    heapq.heappush(heap, (-score[x], i, x))
            if before[i] >= 0 and (x := symbols[before[i]] + joined) in score:
                heapq.heappush(heap, (-score[x], before[i], x))
        return [s for s in symbols if s is not None]

    def fits(self, left: int, right: int) -> bool:
        """Do the two symbols stand side by side in the encoding of their joined string? left -1: does right alone?"""
        x, y = self.symbols[left] if left >= 0 else "", self.symbols[right]
        if len(self.pairs) >= KEPT_CHUNKS:
            self.pairs.clear()
        ok = self.pairs[left << 20 | right] = self.merge(x + y) == ([x, y] if x else [y])
        return ok

    def backtrack(self, text: str) -> list[int]:
        """The symbols of a run of known characters, by number."""
        n, sizes, pairs = len(text), self.sizes, self.pairs
        found: list[list[int]] = [[] for _ in range(n)]
        for end, k in self.find.iter(text):
            found[end - sizes[k] + 1].append(k)  # from short to long
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        tried: list[int] = []
        begin, last, c = 0, -1, len(found[0]) - 1
        while begin < n:
            here = found[begin]
            while c >= 0:
                k = here[c]
                end = begin + sizes[k]
                if not failed[end >> 3] >> (end & 7) & 1:
                    ok = pairs.get(last << 20 | k)
                    if self.fits(last, k) if ok is None else ok:
                        break
                c -= 1
            if c >= 0:
                out.append(k)
                tried.append(c)
                begin, last = end, k
                c = len(found[begin]) - 1 if begin < n else 0
            else:
                failed[begin >> 3] |= 1 << (begin & 7)
                begin -= sizes[out.pop()]
                c = tried.pop() - 1
                last = out[-1] if out else -1
        return out

    def encode_chunk(self, text: str) -> list[int]:
        """Ids of one chunk, its spaces already escaped."""
        coded = self.coded
        if self.letters.issuperset(text) and SPACE * 2 not in text:
            return [i for k in self.backtrack(text) for i in coded[k]]
        out: list[int] = []
        at = 0
        while at < len(text):
            to = at
            while to < len(text) and text[to] in self.letters:
                to += 1
            if to > at:
                run = text[at:to]
                if SPACE * 2 in run:
                    for p in self.merge(run):
                        out.extend([self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()])
                else:
                    out.extend(i for k in self.backtrack(run) for i in coded[k])
            if to < len(text):
                out.extend(self.bytes[b] for b in text[to].encode())
                to += 1
            at = to
        return out


class _Chunks(dict):
    """Chunk to packed ids, made when first asked for, from parts no piece can join. Full, it becomes the old half; what is asked for again comes back."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            inner = self.model.inner
            cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in inner]
            if cuts:
                return b"".join([self[chunk[a:b]] for a, b in zip([0, *cuts], [*cuts, len(chunk)])])
            ids = array("i", self.model.encode_chunk(chunk)).tobytes()
            if len(chunk) > KEPT_LENGTH:
                return ids
        if len(self) >= KEPT_CHUNKS // 2:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


class Encoder:
    """Whole texts to ids and back."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.chunks = _Chunks(self.model)
        self.table = RunTable(lambda words: [np.frombuffer(self.chunks[w.decode().replace(" ", SPACE)], np.int32) for w in words])
        self.mark = np.zeros(256, bool)  # marks that no piece joins to a letter before them
        for m in ".,;:!?":
            self.mark[ord(m)] = not any(chr(c) + m in self.model.inner for c in (*range(0x41, 0x5B), *range(0x61, 0x7B)))

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each whole text, int32."""
        escaped = SPACE.encode()
        # a text gets a space before it; spaces are escaped to a character, so in a text the two are one
        raw, begins = laid_out([b" " + (t.replace(escaped, b" ") if escaped in t else t) if t else b"" for t in texts])
        last = np.zeros(len(raw), bool)
        last[begins[1:] - 1] = True  # the space after each text is no part of it
        space, line = raw == 32, raw == 10
        opens = space.copy()
        opens[1:] &= ~space[:-1] | last[:-1]
        opens |= line
        opens[1:] |= line[:-1]
        mark = np.zeros(len(raw), bool)
        mark[1:-1] = self.mark[raw[1:-1]] & _LETTER[raw[:-2]] & (space[2:] | line[2:])
        opens = (opens | mark) & ~last
        at = np.flatnonzero(opens)
        to = np.concatenate([at[1:], [len(raw)]])
        to = np.minimum(to, (begins[1:] - 1)[np.searchsorted(begins, at, side="right") - 1]) if len(at) else to[:0]
        ids, sizes = self.table.runs(raw, at, to)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(at, begins)]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([(text or "").encode()])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Pieces joined, bytes read as UTF-8, without the leading space of the first piece."""
        raw = b"".join(map(self.model.out.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model_path: str, *, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>[, decoded]) of every whole text, exactly as the model's own library encodes it.

    decoded adds what the ids decode to, in the same pass. A null or empty text gives an empty
    array; a null id stays; repeated rows stay repeated; other columns are not read. Texts of any
    length are encoded whole, in bounded batches.
    """
    one = spread(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(model_path)
        for rows, part in pieces_of(batches, size=CHUNK):
            ids = encoder.encode_all(part)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            cols = [rows.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
            if decoded:
                cols.append(pa.array([encoder.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["id", "ids", *["decoded"] * decoded])

    kind = one.schema["id"].dataType.simpleString()
    return map_batches(one, run, f"id {kind}, ids array<int>" + ", decoded string" * decoded).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded) of encoded documents; null ids decode to the empty string."""
    one = spread(encoded).select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [encoder.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid and len(x.values) else "" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    kind = one.schema["id"].dataType.simpleString()
    return map_batches(one, run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Encode and decode all documents; digests of ids and of decoded texts."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, path, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
