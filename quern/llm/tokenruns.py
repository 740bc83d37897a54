"""Token runs of many words at once: each distinct word is encoded when first seen, all else is numpy.

What a word's run is (ids, or lengths of its tokens) is up to the encode function. Words are told
apart by 64-bit hashes. A bounded number of distinct words is kept; when there are too many, those go that
the batch at hand does not use.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np

from .textvec import hash_spans

KEPT = 400_000
AT_ONCE = 4096


class Special:
    """A tokenizer's added tokens: their strings stand for one token each wherever they occur, and what lies between is encoded as a text of its own."""

    def __init__(self, ids: dict[str, int]):
        self.ids = {text.encode(): i for text, i in ids.items()}
        self.values = {text: np.array([i], np.int32) for text, i in self.ids.items()}
        self.pattern = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.ids, key=lambda t: (-len(t), t))) + b")") if ids else None

    def around(self, texts: list[bytes], encode: Callable[[list[bytes]], list[np.ndarray]]) -> list[np.ndarray]:
        """Runs of whole texts, from the runs that encode gives to texts without such strings."""
        if self.pattern is None or not any(t in x for x in texts for t in self.ids):
            return encode(texts)
        cut = [self.pattern.split(x) for x in texts]  # every second part is a token's string
        plain = iter(encode([p for parts in cut for p in parts[::2]]))
        return [np.concatenate([next(plain) if i % 2 == 0 else self.values[p] for i, p in enumerate(parts)]) for parts in cut]


def load(path: str):
    """A tokenizer file, ready for worker processes, and its added tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    added = tok.get_added_tokens_decoder()
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
        raise ValueError("added tokens that depend on what stands around them are not supported")
    tok.encode_special_tokens = True  # Special finds them in the raw text; words that lower-casing makes equal to one are ordinary
    return tok, Special({t.content: i for i, t in added.items()})


def joined(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of values, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - ends + sizes, sizes)]


class RunTable:
    """Hash of a word to its run."""

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]]):
        self.encode = encode
        self.hashes = np.empty(0, np.uint64)
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)
        self.values = np.empty(0, np.int32)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def runs(self, raw: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the words' runs, one after the other, and each word's number of them."""
        if not len(at):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        distinct, example, which = np.unique(hash_spans(raw, at, to), return_index=True, return_inverse=True)
        place, known = self._find(distinct)
        if not known.all():
            new = ~known
            made = self.encode([raw[a:b].tobytes() for a, b in zip(at[example[new]].tolist(), to[example[new]].tolist())])
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            if len(self.hashes) + len(made) > KEPT:
                keep = place[known]
                self.values = joined(self.values, self.starts[keep], self.sizes[keep])
                self.hashes, self.sizes = self.hashes[keep], self.sizes[keep]
                self.starts = np.cumsum(self.sizes) - self.sizes
            starts = len(self.values) + np.cumsum(sizes) - sizes
            self.values = np.concatenate([self.values, *made]).astype(np.int32)
            spots = np.searchsorted(self.hashes, distinct[new])
            self.hashes = np.insert(self.hashes, spots, distinct[new])
            self.starts, self.sizes = np.insert(self.starts, spots, starts), np.insert(self.sizes, spots, sizes)
            place, _ = self._find(distinct)
        sizes = self.sizes[place][which]
        return joined(self.values, self.starts[place][which], sizes), sizes


def is_plain(word: str) -> bool:
    """Letters only, also when lower-cased: one run of its own in every tokenizer used here."""
    return word.isalpha() and (word.isascii() or word.lower().isalpha())


def split_runs(tok, words: list[str], joiner: Callable[[list[str]], str], cut: Callable[[np.ndarray], np.ndarray], alone: Callable[[str], str] = str) -> list[np.ndarray]:
    """Ids of each word: plain ones many in one string, cut where `cut` says runs start; others each alone.

    cut gives the start of every run, and ends with the number of ids.
    """
    plain = [i for i, w in enumerate(words) if is_plain(w)]
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
    rest = sorted(set(range(len(words))).difference(plain))
    for at in range(0, len(plain), AT_ONCE):
        some = plain[at : at + AT_ONCE]
        ids = np.array(tok.encode_batch_fast([joiner([words[i] for i in some])], add_special_tokens=False)[0].ids, np.int64)
        edges = cut(ids).tolist()
        if len(edges) != len(some) + 1:  # some word isn't one run after all
            rest += some
            continue
        for i, a, b in zip(some, edges[:-1], edges[1:]):
            out[i] = ids[a:b]
    for at in range(0, len(rest), AT_ONCE):
        some = rest[at : at + AT_ONCE]
        for i, x in zip(some, tok.encode_batch_fast([alone(words[i]) for i in some], add_special_tokens=False)):
            out[i] = np.array(x.ids, np.int64)
    return out
