"""License scans: phrase places, and an exact containment join of text blocks with templates.

Blocks are overlapping runs of words over the whole text, whatever its line breaks, so long that each span of as many words
as the longest template has lies within one. Template t is found in a block if
|words of t in the block| >= threshold * |words of t| (distinct words). The join is exact and
needs few comparisons: tokens are ordered by their frequency in the whole corpus, rarest first, so a block
that holds enough of a template holds one of its first |t| - need + 1 tokens (prefix filter); blocks
with too few words are out (length filter), and so are those whose first common token
leaves too few tokens behind it (positional filter). What is left is counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import map_batches, spread
from .textvec import SYMBOLS, Words, pieces_of

#: Phrase and label of the base scan.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label and sentence of well-known public license notices.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("proprietary", "All rights reserved. No part of this work may be reproduced without permission"),
]
STRIDE = 32


def stride_of(templates: list[tuple[str, str]]) -> int:
    """Words from the start of a block to the next one's; a block is twice as long."""
    return max([STRIDE, *(len(words_of(t)) for _, t in templates)])


def words_of(text: str) -> list[bytes]:
    """The words of a short text, as the scan sees them."""
    raw = text.encode()
    w = Words([raw], SYMBOLS)
    low = raw.lower()
    return [low[a:b] for a, b in zip(w.start, w.end)]


def _hash(words: list[bytes]) -> np.ndarray:
    return Words([b" ".join(words)], SYMBOLS).hash


class Join:
    """Templates under a global token order, ready to find their blocks."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float):
        sets = [sorted(set(words_of(t)), key=lambda x: (counts.get(x, 0), x)) for _, t in templates]
        order = sorted({x for s in sets for x in s}, key=lambda x: (counts.get(x, 0), x))
        rank = {x: i for i, x in enumerate(order)}
        hashes = _hash(order)
        by = np.argsort(hashes)
        self.hashes, self.ranks = hashes[by], by.astype(np.int64)
        self.labels = [label for label, _ in templates]
        self.sets = [[rank[x] for x in s] for s in sets]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, s in enumerate(self.sets):
            for p, x in enumerate(s[: len(s) - self.need[t] + 1]):
                self.prefix.setdefault(x, []).append((t, p))
        self.is_prefix = np.zeros(len(order) + 1, bool)  # the last place is that of rank -1
        self.is_prefix[list(self.prefix)] = True

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """Rank in the token order, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ranks[at], -1)

    def find(self, ranks: np.ndarray, size: int) -> Iterator[tuple[int, float]]:
        """(template, containment) of those templates that a block of `size` words holds enough of."""
        block = np.unique(ranks[ranks >= 0]).tolist()
        seen = set()
        for q, x in enumerate(block):
            for t, p in self.prefix.get(x, ()):
                if t in seen:
                    continue
                seen.add(t)
                s, need = self.sets[t], self.need[t]
                if size < need or 1 + min(len(s) - p - 1, len(block) - q - 1) < need:
                    continue
                common = len(set(s).intersection(block))
                if common >= need:
                    yield t, common / len(s)


def corpus_counts(docs: DataFrame, words: list[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How often each of the given words stands in all texts; the result has one row per given word at most."""
    ordered = sorted(set(words))
    hashes = _hash(ordered)
    by = np.argsort(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ordered), np.int64)
        for _, part in pieces_of(batches, 0):
            h = Words(part, SYMBOLS).hash
            at = np.minimum(np.searchsorted(hashes[by], h), len(by) - 1)
            total += np.bincount(by[at][hashes[by][at] == h], minlength=len(ordered))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["word", "n"])

    if not ordered:
        return {}
    rows = map_batches(docs.select(text_col), run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {ordered[r.word]: r.n for r in rows}


def scan(docs: DataFrame, *, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks) of every row.

    Words: A-Z lower-cased runs of letters, digits and bytes above ASCII, so long texts count whole. n_base counts
    all places of all phrases, first_word and last_word their smallest and largest start (null without
    one). labels joins the phrases' and the templates' labels; score is 1 with a phrase, else the
    largest containment found, else 0. blocks lists (template, first word, words, containment). A null
    text counts as empty; null ids and repeated rows stay; an empty table gives an empty result.
    """
    docs = spread(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = corpus_counts(docs, [w for _, t in templates for w in words_of(t)])
    sought = [(words_of(p), label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join, stride = Join(templates, counts, threshold), stride_of(templates)
        hashes = [(_hash(p), p, label) for p, label in sought]
        for rows, part in pieces_of(batches):
            w = Words(part, SYMBOLS)
            n = np.diff(w.first)
            owner = np.repeat(np.arange(len(part)), n)
            places: dict[int, list[tuple[int, str]]] = {}
            for h, phrase, label in hashes:
                hit = np.ones(max(len(w.hash) - len(h) + 1, 0), bool)
                for j, x in enumerate(h):
                    hit &= w.hash[j : j + len(hit)] == x
                for i in np.flatnonzero(hit):
                    d = int(owner[i])
                    if owner[i + len(h) - 1] == d and all(part[d][w.start[i + j] : w.end[i + j]].lower() == x for j, x in enumerate(phrase)):
                        places.setdefault(d, []).append((int(i - w.first[d]), label))
            ranks = join.rank(w.hash)
            found: dict[int, list[tuple[int, int, int, float]]] = {}
            done = set()
            for i in np.flatnonzero(join.is_prefix[ranks]):
                d = int(owner[i])
                a, b = int(w.first[d]), int(w.first[d + 1])
                k = int(i) - a
                for begin in range(max(0, (k - 2 * stride) // stride + 1) * stride, k + 1, stride):
                    x, y = a + begin, min(a + begin + 2 * stride, b)
                    if y <= i or x in done:
                        continue
                    done.add(x)
                    for t, c in join.find(ranks[x:y], y - x):
                        found.setdefault(d, []).append((t, x - a, y - x, c))
            base = [sorted({s for _, s in places.get(d, ())}) for d in range(len(part))]
            own = [{join.labels[t] for t, *_ in found.get(d, ())} for d in range(len(part))]
            starts = [[p for p, _ in places.get(d, ())] for d in range(len(part))]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(n.astype(np.int64)),
                    pa.array([len(s) for s in starts], pa.int64()),
                    pa.array([min(s) if s else None for s in starts], pa.int64()),
                    pa.array([max(s) if s else None for s in starts], pa.int64()),
                    pa.array([",".join(b) for b in base], pa.string()),
                    pa.array([",".join(sorted({*b, *o})) for b, o in zip(base, own)], pa.string()),
                    pa.array([1.0 if b else max((x[3] for x in found.get(d, ())), default=0.0) for d, b in enumerate(base)], pa.float64()),
                    pa.array([[dict(zip(("template", "first", "words", "containment"), x)) for x in found.get(d, ())] for d in range(len(part))], pa.list_(pa.struct([("template", pa.int32()), ("first", pa.int64()), ("words", pa.int32()), ("containment", pa.float64())]))),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<template:int,first:long,words:int,containment:double>>"
    return map_batches(docs, run, schema).withColumnRenamed("doc_id", id_col)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("blocks")
