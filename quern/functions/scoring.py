"""Scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75  # Fixed values: the BM25 parameters
PLACES = 6


def idf(n_docs: Column, df: Column) -> Column:
    """log10(N / df), unsmoothed; N is the stored document count, one above the number of documents."""
    return F.log10(n_docs / df)


def bm25(tf: Column, doc_len: Column, idf: Column, n_docs: Column, total_len: Column) -> Column:
    """Without a (k1 + 1) factor; the mean length is total_len / n_docs."""
    return tf / (F.lit(K1) * (F.lit(1 - B) + F.lit(B) * (doc_len / (total_len / n_docs))) + tf) * idf


def tfidf(tf: Column, idf: Column) -> Column:
    """(1 + log10 tf) idf, without length normalisation."""
    return (F.lit(1.0) + F.log10(tf)) * idf


SCORERS = {
    "bm25": lambda c: bm25(c["tf"], c["doc_len"], c["idf"], c["n_docs"], c["total_len"]),
    "tfidf": lambda c: tfidf(c["tf"], c["idf"]),
}
