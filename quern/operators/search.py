"""Ranked retrieval: disjunctive and conjunctive top-k, one query or many."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.analysis import tokens_of
from ..functions.stemmer import vocabulary
from .index import Index

MARGIN = 1e-6


class Mode(str, Enum):
    OR = "or"
    AND = "and"


class Scorer(str, Enum):
    BM25 = "bm25"
    TFIDF = "tfidf"


class Strategy(str, Enum):
    EXHAUSTIVE = "exhaustive"
    MAXSCORE = "maxscore"


@dataclass(frozen=True)
class SearchOptions:
    """k best documents; mode or/and; scorer; strategy for `or`; tie_compat replays a bounded heap's choice among ties at the end."""

    k: int = 10
    mode: Mode = Mode.OR
    scorer: Scorer = Scorer.BM25
    strategy: Strategy = Strategy.EXHAUSTIVE
    tie_compat: bool = False

    def __post_init__(self):
        if isinstance(self.k, bool) or not isinstance(self.k, int) or self.k < 1:
            raise ValueError("k must be a positive whole number")
        for name, kind in (("mode", Mode), ("scorer", Scorer), ("strategy", Strategy)):
            object.__setattr__(self, name, kind(getattr(self, name)))


def query_terms(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, term, term_pos, df, idf, max_bm25, max_tfidf) of the known distinct terms of (qid, query).

    Query tokens are analysed as documents are but never truncated, so one longer than an index term matches nothing.
    """
    tokens = queries.select("qid", F.posexplode(F.array_distinct(tokens_of(F.col("query"), index.config.removed))).alias("term_pos", "term"))
    if index.config.stopwords_and_stemming:
        tokens = tokens.join(vocabulary(tokens, "term", "stem"), "term").select("qid", "term_pos", F.col("stem").alias("term"))
        tokens = tokens.groupBy("qid", "term").agg(F.min("term_pos").alias("term_pos"))
    return tokens.join(index.dictionary.drop("cf"), "term")


def by_length(terms: DataFrame) -> DataFrame:
    """Adds list_order: a query's terms from the shortest list to the longest, of equals the first in the query."""
    return terms.withColumn("list_order", F.row_number().over(W.partitionBy("qid").orderBy("df", "term_pos")))


def by_bound(terms: DataFrame, scorer: Scorer = Scorer.BM25) -> DataFrame:
    """Adds bound_order and bound_sum: a query's terms from the smallest maximum score up, and the maxima's running sum."""
    order = W.partitionBy("qid").orderBy(f"max_{Scorer(scorer).value}", "term_pos")
    return terms.withColumn("bound_order", F.row_number().over(order)).withColumn("bound_sum", F.sum(f"max_{Scorer(scorer).value}").over(order.rowsBetween(W.unboundedPreceding, 0)))


def _scored(index: Index, terms: DataFrame, scorer: Scorer) -> DataFrame:
    """(qid, term, doc_id, part, and what else terms has) per posting of a query's terms."""
    rows = index.postings.join(terms, "term").crossJoin(F.broadcast(index.stats))
    part = scoring.SCORERS[scorer.value]({c: F.col(c) for c in ("tf", "doc_len", "idf", "n_docs", "total_len")})
    return rows.select("doc_id", part.alias("part"), *terms.columns)


def _essential(index: Index, terms: DataFrame, options: SearchOptions) -> DataFrame:
    """(qid, term, essential): can documents that have none of a query's essential terms reach its top k? They can't.

    The k-th largest score that documents get from the query's term of the largest bound alone is no more than
    the k-th largest full score. Terms whose bounds together stay below it can't lift a document into
    the top k by themselves; ties within the rounding stay in. Only that one list is read twice.
    """
    bounded = by_bound(terms, options.scorer)
    top = bounded.withColumn("last", F.max("bound_order").over(W.partitionBy("qid"))).filter("bound_order = last")
    partial = _scored(index, top, options.scorer).withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("part"))))
    floor = partial.filter(F.col("r") <= options.k).groupBy("qid").agg(F.count("*").alias("n"), F.min("part").alias("floor")).filter(F.col("n") >= options.k).select("qid", "floor")
    return bounded.join(floor, "qid", "left").select("qid", "term", (F.col("floor").isNull() | (F.col("bound_sum") >= F.col("floor") - MARGIN)).alias("essential"))


def _heap_order(scored: DataFrame, k: int) -> DataFrame:
    """The top k that a heap of size k keeps when documents arrive in id order and one that ties with the head is turned away.

    All above the k-th score stay. Of the documents that reach it the first k in id order fill the heap for good, so
    later ties are turned away, and every later document above it throws the tie of the smallest id out.
    """
    place = scored.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"))))
    low = place.filter(F.col("r") == k).select("qid", F.col("score").alias("low"))
    reach = scored.join(low, "qid", "left").filter(F.col("low").isNull() | (F.col("score") >= F.col("low")))
    above = F.coalesce(F.col("score") > F.col("low"), F.lit(True))
    seen = reach.withColumns({"above": above, "arrival": F.row_number().over(W.partitionBy("qid").orderBy("doc_id"))}).filter(F.col("above") | (F.col("arrival") <= k))
    left = seen.withColumns({"n_above": F.sum(F.col("above").cast("int")).over(W.partitionBy("qid")), "from_last": F.row_number().over(W.partitionBy("qid", "above").orderBy(F.desc("doc_id")))})
    kept = left.filter(F.col("above") | (F.col("from_last") <= k - F.col("n_above")))
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))).select("qid", "doc_id", "score", "rank")


def search_batch(index: Index, queries: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(qid, rank, doc_id, docno, score) for queries (qid, query): at most k rows each, score descending, then doc_id.

    Scores are rounded to six places before they are ranked. Unknown terms don't count; `and` wants all known
    ones. A query without tokens or known terms has no rows.
    """
    terms = query_terms(index, queries)
    pruned = options.mode is Mode.OR and options.strategy is Strategy.MAXSCORE
    asked = terms.join(_essential(index, terms, options), ["qid", "term"]) if pruned else terms.withColumn("essential", F.lit(True))
    parts = _scored(index, asked, options.scorer)
    scored = parts.groupBy("qid", "doc_id").agg(F.round(F.sum("part"), scoring.PLACES).alias("score"), F.count("*").alias("matched"), F.max("essential").alias("essential")).filter("essential")
    if options.mode is Mode.AND:
        wanted = terms.groupBy("qid").agg(F.count("*").alias("wanted"))
        scored = scored.join(wanted, "qid").filter("matched = wanted")
    if options.tie_compat:
        ranked = _heap_order(scored, options.k)
    else:
        ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= options.k)
    return ranked.join(index.doc_table.select("doc_id", "docno"), "doc_id").select("qid", "rank", "doc_id", "docno", "score")


def search(index: Index, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(rank, doc_id, docno, score) of one query; a blank query is an error, one without known terms has no rows.

    The few known terms are looked up first and go into the plan as literals, so the scan of the
    postings is pruned to their row groups, and k rows come out of a top-k that needs no window.
    """
    if not query or not query.strip():
        raise ValueError("the query is empty")
    spark = index.postings.sparkSession
    asked = spark.createDataFrame([("q", query)], "qid string, query string")
    if options.tie_compat:
        return search_batch(index, asked, options).drop("qid")
    bound = f"max_{options.scorer.value}"
    known = query_terms(index, asked).select("term", "term_pos", "idf", F.col(bound).alias("bound")).collect()  # a row per known query term
    schema = "rank int, doc_id long, docno string, score double"
    if not known:
        return spark.createDataFrame([], schema)
    idf = F.element_at(F.create_map(*(F.lit(x) for r in known for x in (r.term, r.idf))), F.col("term"))
    part = scoring.SCORERS[options.scorer.value]({c: F.col(c) for c in ("tf", "doc_len", "idf", "n_docs", "total_len")})

    def lists(terms: list[str]) -> DataFrame:
        return index.postings.filter(F.col("term").isin(*terms)).withColumn("idf", idf).crossJoin(F.broadcast(index.stats)).select("term", "doc_id", part.alias("part"))

    essential = [r.term for r in known]
    if options.mode is Mode.OR and options.strategy is Strategy.MAXSCORE and len(known) > 1:  # one list can't be pruned
        rising = sorted(known, key=lambda r: (r.bound, r.term_pos))
        floor = lists([rising[-1].term]).orderBy(F.desc("part")).limit(options.k).collect()
        if len(floor) == options.k:
            sums = list(accumulate(r.bound for r in rising))
            essential = [r.term for r, s in zip(rising, sums) if s >= floor[-1].part - MARGIN]
    scored = lists([r.term for r in known]).groupBy("doc_id").agg(F.round(F.sum("part"), scoring.PLACES).alias("score"), F.count("*").alias("matched"), F.max(F.col("term").isin(*essential)).alias("essential"))
    if len(essential) < len(known):
        scored = scored.filter("essential")
    if options.mode is Mode.AND:
        scored = scored.filter(F.col("matched") == len(known))
    best = scored.orderBy(F.desc("score"), "doc_id").limit(options.k)
    ranked = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "doc_id")))  # of k rows
    return ranked.join(index.doc_table.select("doc_id", "docno"), "doc_id").select("rank", "doc_id", "docno", "score")


def next_geq(index: Index, targets: DataFrame) -> DataFrame:
    """(term, target, doc_id): the first document of a term's list with an id >= target, for (term, target); without one no row.

    Where a list has skip blocks, the first block that reaches the target bounds the ids to look at.
    """
    reach = targets.join(index.skip_blocks, "term").filter("max_doc_id >= target").groupBy("term", "target").agg(F.min("max_doc_id").alias("until"))
    bounds = targets.join(reach, ["term", "target"], "left")
    rows = index.postings.join(bounds, "term").filter("doc_id >= target and (until is null or doc_id <= until)")
    return rows.groupBy("term", "target").agg(F.min("doc_id").alias("doc_id"))
