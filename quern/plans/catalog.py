"""The retrieval engine's queries, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.analysis import STOPWORDS, clean_text, elapsed, remove_stopwords, tokenize, tokens_of, truncated
from ..functions.stemmer import stem, stem_sql
from ..operators import index as ix
from ..operators.evaluate import shown, trec_rows, write_trec
from ..operators.search import SearchOptions, by_bound, by_length, next_geq, query_terms, search, search_batch
from ..sources import collections as sources
from ..sources.dumps import dump_postings, read_dump
from . import workspace

Query = Callable[[SparkSession, str], DataFrame]
SWS = ix.IndexConfig(stopwords_and_stemming=True)
SMALL = ix.IndexConfig(skip_threshold=64, compression=True)  # the usual threshold is seldom reached in small tables

COMMON, ALL_OF, LONG = "nter thatin that", "the that orre", "thatin thatinthatinthatinthatinthatin"
UNKNOWN, TWICE, STEMS = "nter nosuchtermhere", "nter nter thatin nter", "the nters of ering thatin"
HARD_TEXTS = [
    (1, "See https://a.b/c?d=1 now"), (2, "HTTP://A.B x"), (3, "a<b>c</b> d"), (4, "x < y and z > w"), (5, "don't_stop"), (6, "café Ünï 日本"),
    (7, ""), (8, " \t\n "), (9, "http://x"), (10, "tail http://x.y "), (11, "!?#"), (12, None), (13, "<p>One <a href='https://q.r/s t'>two</a></p>"),
]


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _index(spark: SparkSession, sf: str, config: ix.IndexConfig = ix.IndexConfig()) -> ix.Index:
    return workspace.index_of(spark, f"{sf}/documents.parquet", config)


def _lazy(spark: SparkSession, sf: str, config: ix.IndexConfig = ix.IndexConfig()) -> ix.Index:
    return ix.build_index(_docs(spark, sf), config)


# ---- SQL building blocks

_WORDS = ", ".join(f"'{w}'" for w in STOPWORDS)


def _clean_sql(text: str) -> str:
    c = f"lower(regexp_replace({text}, 'https?://\\S+\\s?', ' ', 'g'))"
    for pattern, to in (("<[^>]*>", ""), ("[[:punct:]]", " "), ("[^\\x00-\\x7F]", " "), ("\\s+", " ")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return c


def _tokens_sql(text: str, sws: bool = False) -> str:
    out = f"list_filter(string_split({_clean_sql(text)}, ' '), lambda x: x <> '')"
    return f"list_filter({out}, lambda x: x NOT IN ({_WORDS}))" if sws else out


def _base(sws: bool = False, table: str = "documents", id_col: str = "doc_id", text: str = "text") -> str:
    """docs, stats, postings and dictionary as CTEs."""
    term = "t"
    stems = ""
    if sws:
        stems = f", vocab AS (SELECT DISTINCT t FROM tok), stems AS ({stem_sql('vocab', 't', 's')})"
    source = "tok JOIN stems USING (t) WHERE t <> 's'" if sws else "tok"
    term = "s" if sws else "t"
    return f"""WITH docs AS (SELECT * FROM (SELECT {id_col} AS doc_id, {_tokens_sql(text, sws)} AS toks, len(toks) AS doc_len FROM {table}) WHERE doc_len > 0),
stats AS (SELECT count(*) + 1 AS n_docs, coalesce(sum(doc_len), 0)::DOUBLE AS total_len FROM docs),
tok AS (SELECT doc_id, doc_len, unnest(toks) AS t FROM docs){stems},
postings AS (SELECT substr({term}, 1, 20) AS term, doc_id, count(*) AS tf, any_value(doc_len) AS doc_len FROM {source} GROUP BY ALL),
dictionary AS (SELECT term, df, cf, log10(n_docs / df) AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS cf FROM postings GROUP BY term), stats)"""


_BM25 = "tf / (1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (doc_len / (total_len / n_docs))) + tf) * idf"
_TFIDF = "(1 + log10(tf)) * idf"


def _search_sql(query: str, scorer: str = _BM25, both: bool = False, k: int = 10, sws: bool = False) -> str:
    asked = f"asked AS (SELECT DISTINCT unnest({_tokens_sql(repr(query), sws)}) AS t)"
    terms = f"wanted AS (SELECT DISTINCT s AS term FROM ({stem_sql('asked', 't', 's')}))" if sws else "wanted AS (SELECT t AS term FROM asked)"
    having = "HAVING count(*) = (SELECT count(*) FROM dictionary JOIN wanted USING (term))" if both else ""
    return f"""{_base(sws)}, {asked}, {terms},
best AS (SELECT doc_id, round(sum({scorer}), 6) AS score FROM postings JOIN dictionary USING (term) JOIN wanted USING (term), stats GROUP BY doc_id {having} ORDER BY score DESC, doc_id LIMIT {k})
SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, doc_id, doc_id::VARCHAR AS docno, score FROM best"""


def _batch_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text, whole."""
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))


_BATCH_SQL = f"""{_base()}, asked AS (SELECT DISTINCT item_id::VARCHAR AS qid, unnest({_tokens_sql('text')}) AS term FROM benchmark),
scored AS (SELECT qid, doc_id, round(sum({_BM25}), 6) AS score FROM asked JOIN dictionary USING (term) JOIN postings USING (term), stats GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM scored)
"""


def _hard(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HARD_TEXTS, "doc_id long, text string")


def _sql_text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


_HARD_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {_sql_text(t)})" for i, t in HARD_TEXTS) + ") v(doc_id, text))"

Q: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    Q[name] = (query, sql)


# ---- text pipeline

_add("text_clean", lambda s, d: _docs(s, d).select("doc_id", clean_text(F.col("text")).alias("cleaned")), f"SELECT doc_id, {_clean_sql('text')} AS cleaned FROM documents")
_add(
    "text_tokens",
    lambda s, d: _docs(s, d).select("doc_id", F.posexplode(tokenize(clean_text(F.col("text")))).alias("pos", "term")),
    f"SELECT doc_id, unnest(generate_series(0, len(toks) - 1))::INT AS pos, unnest(toks) AS term FROM (SELECT doc_id, {_tokens_sql('text')} AS toks FROM documents)",
)
_add("text_hard_cases", lambda s, d: _hard(s).select("doc_id", F.concat_ws("|", tokens_of(F.col("text"))).alias("terms")), f"SELECT doc_id, coalesce(array_to_string({_tokens_sql('text')}, '|'), '') AS terms FROM {_HARD_SQL}")
_add("url_clean", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", clean_text(F.concat_ws(" ", F.lit("at"), "url", F.lit("end"))).alias("cleaned")), f"SELECT page_id, {_clean_sql(chr(39) + 'at ' + chr(39) + ' || url || ' + chr(39) + ' end' + chr(39))} AS cleaned FROM pages")
_add(
    "text_stopwords",
    lambda s, d: _docs(s, d).select("doc_id", F.posexplode(remove_stopwords(tokenize(clean_text(F.col("text"))))).alias("pos", "term")),
    f"SELECT doc_id, unnest(generate_series(0, len(toks) - 1))::INT AS pos, unnest(toks) AS term FROM (SELECT doc_id, {_tokens_sql('text', True)} AS toks FROM documents)",
)
_add(
    "text_stem_vocab",
    lambda s, d: stem(_docs(s, d).select(F.explode(tokens_of(F.col("text"))).alias("term")).distinct(), "term", "stem"),
    f"WITH vocab AS (SELECT DISTINCT unnest({_tokens_sql('text')}) AS term FROM documents) {stem_sql('vocab', 'term', 'stem')}",
)
_add(
    "term_truncate",
    lambda s, d: _docs(s, d).select(F.explode(tokens_of(F.col("text"))).alias("token")).distinct().filter(F.length("token") > 15).select("token", truncated(F.col("token")).alias("term")),
    f"SELECT DISTINCT token, substr(token, 1, 20) AS term FROM (SELECT unnest({_tokens_sql('text')}) AS token FROM documents) WHERE length(token) > 15",
)
_add("elapsed_format", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", elapsed(F.col("event_id")).alias("elapsed")), "SELECT event_id, printf('%02d:%02d:%02d', event_id // 3600, event_id // 60 % 60, event_id % 60) AS elapsed FROM events")

# ---- index

_add("docs_nonempty", lambda s, d: ix.analyzed(_docs(s, d)).agg(F.count("*").alias("n_documents")), f"{_base()} SELECT count(*) AS n_documents FROM docs")
_add("doc_table", lambda s, d: _lazy(s, d).doc_table, f"{_base()} SELECT doc_id, doc_id::VARCHAR AS docno, doc_len FROM docs")
_add("doc_numbers", lambda s, d: ix.numbered(_lazy(s, d).doc_table).select("doc_id", "number"), f"{_base()} SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS number FROM docs")
_add("postings", lambda s, d: _lazy(s, d).postings, f"{_base()} SELECT * FROM postings")
_add("dictionary", lambda s, d: _lazy(s, d).dictionary.select("term", "df", "cf", F.round("idf", 6).alias("idf")), f"{_base()} SELECT term, df, cf::BIGINT AS cf, round(idf, 6) AS idf FROM dictionary")
_add("collection_stats", lambda s, d: _lazy(s, d).stats, f"{_base()} SELECT * FROM stats")
_add("vocab_size", lambda s, d: _lazy(s, d).dictionary.agg(F.count("*").alias("terms")), f"{_base()} SELECT count(*) AS terms FROM dictionary")
_add(
    "term_max_scores",
    lambda s, d: _lazy(s, d).dictionary.select("term", F.round("max_bm25", 6).alias("max_bm25"), F.round("max_tfidf", 6).alias("max_tfidf")),
    f"{_base()} SELECT term, round(max({_BM25}), 6) AS max_bm25, round(max({_TFIDF}), 6) AS max_tfidf FROM postings JOIN dictionary USING (term), stats GROUP BY term",
)


def _blocks_sql(threshold: int) -> str:
    return f"""{_base()}, placed AS (SELECT term, doc_id, df, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS spot FROM postings JOIN dictionary USING (term) WHERE df >= {threshold}),
blocks AS (SELECT term, floor(spot / ceil(sqrt(df)))::BIGINT AS block_no, max(doc_id) AS max_doc_id, count(*) AS n_postings FROM placed GROUP BY ALL)
SELECT * FROM blocks"""


_add("skip_blocks", lambda s, d: _index(s, d).skip_blocks, _blocks_sql(ix.SKIP_THRESHOLD))
_add("skip_blocks_64", lambda s, d: _index(s, d, SMALL).skip_blocks, _blocks_sql(64))
_add("index_saved", lambda s, d: _index(s, d).postings, f"{_base()} SELECT * FROM postings")
_add("postings_sws", lambda s, d: _lazy(s, d, SWS).postings, f"{_base(True)} SELECT * FROM postings")
_add("pages_index", lambda s, d: ix.build_index(s.read.parquet(f"{d}/pages.parquet"), id_col="page_id", text_col="html").postings, f"{_base(False, 'pages', 'page_id', 'html')} SELECT * FROM postings")

# ---- retrieval


def _targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, n) for t in ("the", "that", "nter", "orre") for n in (0, 17, 400, 10**12)], "term string, target long")


_add(
    "next_geq",
    lambda s, d: next_geq(_index(s, d, SMALL), _targets(s)),
    f"{_base()} SELECT term, target, min(doc_id) AS doc_id FROM postings JOIN (SELECT * FROM (VALUES ('the'), ('that'), ('nter'), ('orre')) a(term), (VALUES (0::BIGINT), (17), (400), (1000000000000)) b(target)) USING (term) WHERE doc_id >= target GROUP BY ALL",
)


def _one(text: str, config: ix.IndexConfig = ix.IndexConfig(), **options) -> Query:
    return lambda s, d: search(_index(s, d, config), text, SearchOptions(**options))


for _name, _text, _scorer, _sql in (("bm25", COMMON, "bm25", _BM25), ("tfidf", COMMON, "tfidf", _TFIDF)):
    _add(f"search_or_{_name}", _one(_text, scorer=_scorer), _search_sql(_text, _sql))
    _add(f"search_and_{_name}", _one(ALL_OF, mode="and", scorer=_scorer), _search_sql(ALL_OF, _sql, both=True))
    _add(f"search_maxscore_{_name}", _one(_text, scorer=_scorer, strategy="maxscore"), _search_sql(_text, _sql))
_add("search_k100", _one(COMMON, k=100), _search_sql(COMMON, k=100))
_add("search_unknown_term", _one(UNKNOWN, mode="and"), _search_sql(UNKNOWN, both=True))
_add("search_no_term", _one("nosuchtermhere"), _search_sql("nosuchtermhere"))
_add("search_long_term", _one(LONG), _search_sql(LONG))
_add("search_dup_terms", _one(TWICE), _search_sql(TWICE))
_add("search_sws_bm25", _one(STEMS, SWS), _search_sql(STEMS, sws=True))
_add("search_sws_and_tfidf", _one(STEMS, SWS, mode="and", scorer="tfidf"), _search_sql(STEMS, _TFIDF, both=True, sws=True))
_add("search_printed", lambda s, d: shown(search(_index(s, d), COMMON)), f"SELECT docno, printf('%.3f', score) AS score FROM ({_search_sql(COMMON)})")
_HEAP_SQL = f"""{_base()}, wanted AS (SELECT DISTINCT unnest({_tokens_sql(repr(COMMON))}) AS term),
scored AS (SELECT doc_id, round(sum({_TFIDF}), 6) AS score FROM postings JOIN dictionary USING (term) JOIN wanted USING (term), stats GROUP BY doc_id),
low AS (SELECT min(score) AS low, count(*) AS n FROM (SELECT score FROM scored ORDER BY score DESC LIMIT 10)),
reach AS (SELECT doc_id, score, n < 10 OR score > low AS above, row_number() OVER (ORDER BY doc_id) AS arrival FROM scored, low WHERE score >= low),
seen AS (SELECT *, sum(above::INT) OVER () AS n_above, row_number() OVER (PARTITION BY above ORDER BY doc_id DESC) AS from_last FROM reach WHERE above OR arrival <= 10)
SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, doc_id, doc_id::VARCHAR AS docno, score FROM seen WHERE above OR from_last <= 10 - n_above"""
_add("search_heap_ties", _one(COMMON, scorer="tfidf", tie_compat=True), _HEAP_SQL)
_add("batch_trec_bm25", lambda s, d: trec_rows(_index(s, d), _batch_queries(s, d)), f"{_BATCH_SQL} SELECT qid, 'Q0' AS q0, doc_id::VARCHAR AS docno, rank, score, 'RUN-01' AS runid FROM best WHERE rank <= 10")
_add("batch_maxscore_bm25", lambda s, d: search_batch(_index(s, d), _batch_queries(s, d), SearchOptions(strategy="maxscore")), f"{_BATCH_SQL} SELECT qid, rank, doc_id, doc_id::VARCHAR AS docno, score FROM best WHERE rank <= 10")
_add(
    "batch_and_bm25",
    lambda s, d: search_batch(_index(s, d), _batch_queries(s, d), SearchOptions(mode="and")),
    _BATCH_SQL.replace("GROUP BY ALL),\nbest", "GROUP BY qid, doc_id HAVING count(*) = any_value(known)),\nbest").replace("FROM asked JOIN dictionary", "FROM asked JOIN (SELECT qid, count(*) AS known FROM asked JOIN dictionary USING (term) GROUP BY qid) USING (qid) JOIN dictionary") + " SELECT qid, rank, doc_id, doc_id::VARCHAR AS docno, score FROM best WHERE rank <= 10",
)


def _ordered(s: SparkSession, d: str) -> DataFrame:
    return query_terms(_index(s, d), _batch_queries(s, d))


_ASKED_SQL = f"{_base()}, asked AS (SELECT qid, t AS term, min(p) AS term_pos FROM (SELECT item_id::VARCHAR AS qid, unnest(toks) AS t, unnest(generate_series(1, len(toks))) AS p FROM (SELECT item_id, {_tokens_sql('text')} AS toks FROM benchmark)) GROUP BY ALL)"
_add("list_order_df", lambda s, d: by_length(_ordered(s, d)).select("qid", "term", "df", "list_order"), f"{_ASKED_SQL} SELECT qid, term, df, row_number() OVER (PARTITION BY qid ORDER BY df, term_pos)::INT AS list_order FROM asked JOIN dictionary USING (term)")
_add(
    "list_order_maxscore",
    lambda s, d: by_bound(_ordered(s, d), "tfidf").select("qid", "term", F.round("max_tfidf", 6).alias("bound"), "bound_order", F.round("bound_sum", 6).alias("bound_sum")),
    f"{_ASKED_SQL}, m AS (SELECT term, max({_TFIDF}) AS bound FROM postings JOIN dictionary USING (term), stats GROUP BY term)\n"
    "SELECT qid, term, round(bound, 6) AS bound, row_number() OVER w::INT AS bound_order, round(sum(bound) OVER w, 6) AS bound_sum FROM asked JOIN m USING (term) WINDOW w AS (PARTITION BY qid ORDER BY bound, term_pos ROWS UNBOUNDED PRECEDING)",
)

# ---- codecs


def _sizes(s: SparkSession, d: str) -> DataFrame:
    made = _index(s, d, SMALL)
    rows = ix.blocked(made.postings, made.dictionary, 64).groupBy("term", "block_no").agg(codecs.unary_size(F.sum("tf")).alias("u"), F.sum(codecs.vbyte_size(F.col("doc_id") + 1)).alias("v"))
    return rows.groupBy("term").agg(F.sum("u").alias("unary_bytes"), F.sum("v").alias("vbyte_bytes"))


def _written(s: SparkSession, d: str) -> DataFrame:
    made = _index(s, d, SMALL)
    return made.compressed.groupBy("term").agg(F.sum(F.length("tf_bytes")).cast("long").alias("unary_bytes"), F.sum(F.length("doc_bytes")).cast("long").alias("vbyte_bytes"))


_SIZE_SQL = f"""{_base()}, placed AS (SELECT term, doc_id + 1 AS n, tf, df, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS spot FROM postings JOIN dictionary USING (term)),
b AS (SELECT term, CASE WHEN df >= 64 THEN floor(spot / ceil(sqrt(df))) ELSE 0 END AS block_no, sum(tf) AS bits, sum((length(bin(n)) + 6) // 7) AS v FROM placed GROUP BY ALL)
SELECT term, sum(ceil(bits / 8)::BIGINT + CASE WHEN bits % 8 = 0 THEN 0 ELSE 1 END)::BIGINT AS unary_bytes, sum(v)::BIGINT AS vbyte_bytes FROM b GROUP BY term"""
_add("codec_sizes", _sizes, _SIZE_SQL)
_add("codec_bytes_written", _written, _SIZE_SQL)
_add("codec_roundtrip", lambda s, d: ix.decompressed(_index(s, d, SMALL).compressed), f"{_base()} SELECT term, doc_id, tf FROM postings")


# ---- files: written to the shared folder and read back


def _file(spark: SparkSession, name: str) -> str:
    return f"{workspace.shared_dir(spark)}/quern-files-{spark.sparkContext.applicationId}/{name}"


def _source_tsv(s: SparkSession, d: str) -> DataFrame:
    """Documents as lines of a collection, with blank lines and lines without a tab between them."""
    rows = _docs(s, d).select(F.array(F.concat_ws("\t", F.concat(F.lit("D-"), "doc_id"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " ")), F.lit("  "), F.lit("no tab")).alias("l"))
    rows.select(F.explode("l").alias("value")).write.mode("overwrite").text(_file(s, "tsv"))
    return sources.read_tsv(s, _file(s, "tsv")).select("docno", F.sha2("text", 256).alias("text_sha256"))


def _source_queries(s: SparkSession, d: str) -> DataFrame:
    _batch_queries(s, d).select(F.concat_ws("\t", "qid", F.regexp_replace("query", r"[\r\n\t]+", " ")).alias("value")).write.mode("overwrite").text(_file(s, "queries"))
    return sources.read_queries(s, _file(s, "queries"))


def _run_file(s: SparkSession, d: str) -> DataFrame:
    write_trec(trec_rows(_index(s, d), _batch_queries(s, d)), _file(s, "run"), "overwrite", one_file=True)
    parts = F.split("value", "\t")
    return s.read.text(_file(s, "run")).select(*(parts[i].alias(c) for i, c in enumerate(("qid", "q0", "docno"))), parts[3].cast("int").alias("rank"), parts[4].cast("double").alias("score"), parts[5].alias("runid"))


def _dump(s: SparkSession, d: str) -> DataFrame:
    dump_postings(_index(s, d), "the", _file(s, "dump"))
    return read_dump(s, _file(s, "dump"))


def _flags(s: SparkSession, d: str) -> DataFrame:
    configs = [_index(s, d, c).config for c in (ix.IndexConfig(), SMALL, SWS)]
    return s.createDataFrame([(c.stopwords_and_stemming, c.compression, c.skip_threshold) for c in configs], "stopwords_and_stemming boolean, compression boolean, skip_threshold int")


_add("source_tsv", _source_tsv, "SELECT 'D-' || doc_id AS docno, sha256(regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g')) AS text_sha256 FROM documents")
_add("source_queries", _source_queries, "SELECT item_id::VARCHAR AS qid, regexp_replace(text, '[\r\n\t]+', ' ', 'g') AS query FROM benchmark")
_add("run_file", _run_file, f"{_BATCH_SQL} SELECT qid, 'Q0' AS q0, doc_id::VARCHAR AS docno, rank, score, 'RUN-01' AS runid FROM best WHERE rank <= 10")
_add("posting_dump", _dump, f"{_base()} SELECT doc_id, tf FROM postings WHERE term = 'the'")
_add("index_flags", _flags, f"SELECT * FROM (VALUES (false, false, {ix.SKIP_THRESHOLD}), (false, true, 64), (true, false, {ix.SKIP_THRESHOLD})) v(stopwords_and_stemming, compression, skip_threshold)")


def queries() -> dict[str, Query]:
    """Query name to a function of (spark, sf_dir)."""
    return {name: query for name, (query, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {name: sql for name, (_, sql) in Q.items() if sql is not None}
