"""Batch evaluation: run files and timings."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index
from .search import SearchOptions, search, search_batch

RUN_ID = "RUN-01"  # Fixed value: the run's name in its file


def trec_rows(index: Index, queries: DataFrame, options: SearchOptions = SearchOptions(), run_id: str = RUN_ID) -> DataFrame:
    """(qid, q0, docno, rank, score, runid) of all queries."""
    found = search_batch(index, queries, options)
    return found.select("qid", F.lit("Q0").alias("q0"), "docno", "rank", "score", F.lit(run_id).alias("runid"))


def write_trec(rows: DataFrame, path: str, mode: str = "append", one_file: bool = False) -> None:
    """Tab-separated lines in query and rank order, as text files under path; one_file: as a single one, which a run's rows (queries x k) fill in one task."""
    line = F.concat_ws("\t", "qid", "q0", "docno", F.col("rank").cast("string"), F.col("score").cast("string"), "runid")
    dealt = rows.repartition(1) if one_file else rows.repartitionByRange("qid")
    dealt.sortWithinPartitions("qid", "rank").select(line.alias("value")).write.mode(mode).text(path)


def shown(results: DataFrame) -> DataFrame:
    """(docno, score) as printed: three decimals, best first."""
    return results.orderBy("rank").select("docno", F.format_string("%.3f", "score").alias("score"))


def timings(index: Index, queries: DataFrame, options: SearchOptions = SearchOptions()) -> tuple[list[tuple[str, str, int]], int]:
    """(qid, query, milliseconds) of each query run on its own, and their whole mean; for a file of queries, not a corpus."""
    out = []
    for r in queries.collect():
        began = time.perf_counter()
        search(index, r.query, options).collect()
        out.append((r.qid, r.query, int((time.perf_counter() - began) * 1000)))
    return out, sum(t for *_, t in out) // len(out) if out else 0
