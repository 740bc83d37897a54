"""Readers of collections, query files and word lists."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_AT_ONCE = 4096


def _records(lines: DataFrame) -> DataFrame:
    """(docno, text) of the lines that aren't blank and have a tab; docno is what stands before the first."""
    good = lines.filter(F.col("value").rlike(r"\S") & (F.instr("value", "\t") > 0))
    return good.select(F.substring_index("value", "\t", 1).alias("docno"), F.expr("substr(value, instr(value, '\t') + 1)").alias("text"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(docno, text) of text files, plain or compressed, one `docno TAB text` a line."""
    return _records(spark.read.text(path))


def read_tar(spark: SparkSession, path: str) -> DataFrame:
    """(docno, text) of the first file in each gzipped tar, read as a stream of lines.

    An archive can't be split, so it is one task; unpack large ones to plain files and use read_tsv.
    """
    paths = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import tarfile

        for batch in batches:
            for content in batch.column(0):
                with tarfile.open(fileobj=io.BytesIO(content.as_py()), mode="r:*") as tar:
                    member = next((m for m in tar if m.isfile()), None)
                    if member is None:
                        continue
                    held: list[str] = []
                    for line in io.TextIOWrapper(tar.extractfile(member), "utf-8", errors="replace", newline="\n"):
                        held.append(line.rstrip("\r\n"))
                        if len(held) == LINES_AT_ONCE:
                            yield pa.RecordBatch.from_arrays([pa.array(held)], ["value"])
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(held)], ["value"])

    return _records(paths.mapInArrow(run, "value string"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query) of a file with `qid TAB query` lines; quotes are ordinary characters."""
    return spark.read.csv(path, sep="\t", quote="", schema="qid string, query string").filter("qid is not null and query is not null")


def read_words(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The distinct words of a list, one a line, for IndexConfig.stopwords."""
    return tuple(sorted({r.value.strip() for r in spark.read.text(path).collect()} - {""}))
