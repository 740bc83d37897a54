"""Posting lists as text, for looking at one term."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import Index


def dump_postings(index: Index, term: str, path: str) -> None:
    """One `docid: <int> tf: <int>` line per posting of the term, in id order, as text files under path (overwriting)."""
    rows = index.postings.filter(F.col("term") == term)
    line = F.format_string("docid: %d tf: %d", "doc_id", "tf")
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(line.alias("value")).write.mode("overwrite").text(path)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, tf) of the dump's lines; other lines are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.col("value").rlike(r"^\s*docid: \d+ tf: \d+\s*$"))
    return rows.select(parts[1].cast("long").alias("doc_id"), parts[3].cast("long").alias("tf"))
