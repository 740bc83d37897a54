"""Command line: build an index, search it, time queries, write run files.

    python -m quern build --docs docs.tsv --index INDEX [--stopwords-and-stemming] [--stopwords FILE] [--compression]
    python -m quern search --index INDEX [--mode or|and] [--scorer bm25|tfidf] [--strategy exhaustive|maxscore] [-k 10]
    python -m quern time --index INDEX --queries queries.tsv [--report FILE] ...
    python -m quern run --index INDEX --queries queries.tsv --out RUN ...

Documents are read by the ending of --docs: .tsv, .txt or .gz lines, .tar.gz or .tgz archives, anything else as Parquet.
"""

from __future__ import annotations

import argparse
import logging
import sys
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate
from .operators.index import IndexConfig, build_index, load, numbered, save
from .operators.search import Mode, Scorer, SearchOptions, Strategy, search
from .sources import collections as sources

log = logging.getLogger("quern")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, docno, text) of a collection; TSV records are numbered in docno order, from 1."""
    if path.endswith((".tar.gz", ".tgz")):
        rows = sources.read_tar(spark, path)
    elif path.endswith((".tsv", ".txt", ".gz")):
        rows = sources.read_tsv(spark, path)
    else:
        return spark.read.parquet(path)
    # dense numbers need an order on numbers: docnos that are numbers keep it, others take that of their hash
    keyed = rows.withColumn("key", F.coalesce(F.expr("try_cast(docno AS BIGINT)"), F.xxhash64("docno")))
    return numbered(keyed, "key").select(F.col("number").cast("long").alias("doc_id"), "docno", "text")


def options(args: argparse.Namespace) -> SearchOptions:
    return SearchOptions(k=args.k, mode=args.mode, scorer=args.scorer, strategy=args.strategy, tie_compat=args.tie_compat)


def interactive(index, opts: SearchOptions, lines: Iterable[str], out=print) -> int:
    """Answer one query a line until "x"; blank lines are turned away. Returns how many were answered."""
    answered = 0
    for line in lines:
        query = line.strip()
        if query == "x":
            break
        if not query:
            out("the query is empty")
            continue
        began = time.perf_counter()
        rows = evaluate.shown(search(index, query, opts)).collect()
        for r in rows:
            out(f"{r.docno}\t{r.score}")
        out(f"{len(rows) or 'no'} results in {int((time.perf_counter() - began) * 1000)} ms")
        answered += 1
    return answered


def report(times: list[tuple[str, str, int]], mean: int) -> str:
    """The text of a timing report."""
    return "".join(f'query "{q}" time : {ms}ms\n' for _, q, ms in times) + f"Average time: {mean}ms\n"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quern", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    todo = top.add_subparsers(dest="command", required=True)
    build = todo.add_parser("build")
    build.add_argument("--docs", required=True)
    build.add_argument("--index", required=True)
    build.add_argument("--stopwords-and-stemming", action="store_true")
    build.add_argument("--stopwords")
    build.add_argument("--compression", action="store_true")
    for name in ("search", "time", "run"):
        sub = todo.add_parser(name)
        sub.add_argument("--index", required=True)
        sub.add_argument("-k", type=int, default=10)
        sub.add_argument("--mode", choices=[m.value for m in Mode], default="or")
        sub.add_argument("--scorer", choices=[s.value for s in Scorer], default="bm25")
        sub.add_argument("--strategy", choices=[s.value for s in Strategy], default="exhaustive")
        sub.add_argument("--tie-compat", action="store_true")
        if name != "search":
            sub.add_argument("--queries", required=True)
        if name == "time":
            sub.add_argument("--report")
        if name == "run":
            sub.add_argument("--out", required=True)
            sub.add_argument("--one-file", action="store_true", help="write the run as a single file under --out")
    for sub in todo.choices.values():
        sub.add_argument("--log", help="append the log to this file")
        sub.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    log.setLevel(args.log_level)
    handler = logging.FileHandler(args.log) if args.log else logging.StreamHandler()
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.handlers = [handler]
    spark = spark or SparkSession.builder.appName("quern").getOrCreate()
    if args.command == "build":
        words = {"stopwords": sources.read_words(spark, args.stopwords)} if args.stopwords else {}
        config = IndexConfig(stopwords_and_stemming=args.stopwords_and_stemming, compression=args.compression, **words)
        began = time.perf_counter()
        made = save(build_index(documents(spark, args.docs), config), args.index)
        log.info("built %d terms in %.1f s", made.dictionary.count(), time.perf_counter() - began)
        return 0
    index, opts = load(spark, args.index), options(args)
    if args.command == "search":
        interactive(index, opts, sys.stdin)
    elif args.command == "time":
        text = report(*evaluate.timings(index, sources.read_queries(spark, args.queries), opts))
        print(text, end="")
        if args.report:
            with open(args.report, "a") as f:
                f.write(text)
    else:
        evaluate.write_trec(evaluate.trec_rows(index, sources.read_queries(spark, args.queries), opts), args.out, one_file=args.one_file)
    return 0
