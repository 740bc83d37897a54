"""The inverted index as DataFrames: postings, dictionary, document table, statistics, skip blocks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codecs, scoring
from ..functions.analysis import STOPWORDS, tokens_of, truncated
from ..functions.names import fresh
from ..functions.stemmer import vocabulary
from .spread import spread

SKIP_THRESHOLD = 1024  # Fixed value: from so many documents on, a term's list has skip blocks

#: Tables that do not depend on how lists are cut into blocks.
SHARED = ("doc_table", "stats", "postings", "dictionary")


@dataclass(frozen=True)
class IndexConfig:
    """How texts become terms; stopwords only count when stopwords_and_stemming is set."""

    stopwords_and_stemming: bool = False
    stopwords: tuple[str, ...] = STOPWORDS
    skip_threshold: int = SKIP_THRESHOLD
    compression: bool = False

    def __post_init__(self):
        if self.skip_threshold < 1:
            raise ValueError("skip_threshold must be positive")

    @property
    def terms(self) -> tuple:
        """What decides which terms a text has; indexes that agree in it differ in blocks only."""
        return self.stopwords_and_stemming, self.removed

    @property
    def removed(self) -> tuple[str, ...]:
        return self.stopwords if self.stopwords_and_stemming else ()


@dataclass(frozen=True)
class Index:
    """postings (term, doc_id, tf, doc_len), dictionary (term, df, cf, idf, max_bm25, max_tfidf), doc_table (doc_id, docno, doc_len), stats (n_docs, total_len)."""

    config: IndexConfig
    postings: DataFrame
    dictionary: DataFrame
    doc_table: DataFrame
    stats: DataFrame
    skip_blocks: DataFrame
    compressed: DataFrame | None = field(default=None)
    analysed: DataFrame | None = field(default=None)


def analyzed(docs: DataFrame, config: IndexConfig = IndexConfig(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, docno, tokens, doc_len) of documents that have a token; docno is the id as text where docs has none."""
    docno = F.col("docno") if "docno" in docs.columns else F.col(id_col).cast("string")
    raw = spread(docs.select(F.col(id_col).alias("doc_id"), docno.alias("docno"), F.col(text_col).alias("text")))
    one = raw.select("doc_id", "docno", tokens_of(F.col("text"), config.removed).alias("tokens"))
    return one.withColumn("doc_len", F.size("tokens").cast("long")).filter("doc_id is not null and doc_len > 0")


CHUNK_BITS = 10


def in_order(rows: DataFrame, keys: list[str], id_col: str, out: str) -> DataFrame:
    """Adds the 0-based place of each row in id order within its keys, without gathering a key in one task.

    Ids are cut into 2^CHUNK_BITS ranges of about as many rows each, at approximate quantiles of the ids there are, dense or
    sparse. Rows are numbered within their range, and a range's rows start after those of the ranges before it; what a key gathers is a
    count per range. The order of equal ids is open; rows without an id are left out; all other columns stay; an empty table gives an empty result.
    """
    chunk, place, start, n, cuts = (fresh(c, rows.columns) for c in ("chunk", "place", "start", "n", "cuts"))
    rows = rows.filter(F.col(id_col).isNotNull())
    shares = F.array(*(F.lit(i / (1 << CHUNK_BITS)) for i in range(1, 1 << CHUNK_BITS)))
    bounds = rows.agg(F.percentile_approx(id_col, shares, 16 << CHUNK_BITS).alias(cuts))
    cut = rows.crossJoin(F.broadcast(bounds)).withColumn(chunk, F.lit(0))  # how many cuts are no more than the id, found by halving
    for b in reversed(range(CHUNK_BITS)):  # a column a step: compiled, which one expression over an array is not
        cut = cut.withColumn(chunk, F.col(chunk) + F.when(F.get(F.col(cuts), F.col(chunk) + ((1 << b) - 1)) <= F.col(id_col), 1 << b).otherwise(0))
    cut = cut.drop(cuts)
    before = W.partitionBy(*keys).orderBy(chunk) if keys else W.orderBy(chunk)
    sizes = cut.groupBy(*keys, chunk).agg(F.count("*").alias(n))
    starts = sizes.select(*keys, chunk, (F.sum(n).over(before.rowsBetween(W.unboundedPreceding, 0)) - F.col(n)).alias(start))
    placed = cut.withColumn(place, F.row_number().over(W.partitionBy(*keys, chunk).orderBy(id_col)) - 1)
    return placed.join(starts, [*keys, chunk]).withColumn(out, F.col(start) + F.col(place)).select(*rows.columns, out)


def numbered(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds the dense 1-based number of each document in id order."""
    return in_order(docs, [], id_col, "number").withColumn("number", F.col("number") + 1)


def postings_of(docs: DataFrame, config: IndexConfig = IndexConfig()) -> DataFrame:
    """(term, doc_id, tf, doc_len) from analyzed documents; the count is partial before it is shuffled.

    With stemming the token "s", the only one whose stem is empty, is no term; it counts in doc_len, as every token does.
    Rows that repeat an id are one document to the postings, of the sum of their counts and the length of one of them.
    """
    raw = docs.select("doc_id", "doc_len", F.explode("tokens").alias("token"))
    if not config.stopwords_and_stemming:
        return raw.groupBy(truncated(F.col("token")).alias("term"), "doc_id").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))
    counted = raw.filter("token <> 's'").groupBy("token", "doc_id").agg(F.count("*").alias("n"), F.first("doc_len").alias("doc_len"))
    stems = vocabulary(counted, "token", "stem")  # each distinct token is stemmed once
    joined = counted.join(stems, "token")
    return joined.groupBy(truncated(F.col("stem")).alias("term"), "doc_id").agg(F.sum("n").alias("tf"), F.first("doc_len").alias("doc_len"))


def stats_of(docs: DataFrame) -> DataFrame:
    """One row (n_docs, total_len): the number of documents plus one, and all tokens."""
    return docs.agg((F.count("*") + 1).alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).cast("double").alias("total_len"))


def dictionary_of(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, cf, idf, max_bm25, max_tfidf).

    The maxima are exact. The idf is a positive factor of both scores, so one pass
    finds df, cf and the largest scores without it, and they are scaled after.
    """
    per = postings.crossJoin(F.broadcast(stats))
    part = {n: f({"tf": F.col("tf"), "doc_len": F.col("doc_len"), "idf": F.lit(1.0), "n_docs": F.col("n_docs"), "total_len": F.col("total_len")}) for n, f in scoring.SCORERS.items()}
    found = per.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("n_docs").alias("n_docs"), *(F.max(c).alias(n) for n, c in part.items()))
    found = found.withColumn("idf", scoring.idf(F.col("n_docs"), F.col("df")))
    return found.select("term", "df", "cf", "idf", (F.col("bm25") * F.col("idf")).alias("max_bm25"), (F.col("tfidf") * F.col("idf")).alias("max_tfidf"))


def blocked(postings: DataFrame, dictionary: DataFrame, threshold: int) -> DataFrame:
    """Postings with df and block_no: lists of threshold documents and more fall into blocks of ceil(sqrt(df)), others are one block."""
    joined = postings.join(dictionary.select("term", "df"), "term")
    return _placed(joined.filter(F.col("df") >= threshold)).unionByName(joined.filter(F.col("df") < threshold).withColumn("block_no", F.lit(0).cast("long")))


def _placed(rows: DataFrame) -> DataFrame:
    """Postings with df and block_no, from those with df; each list falls into blocks of ceil(sqrt(df))."""
    placed = in_order(rows, ["term"], "doc_id", "_at")
    return placed.withColumn("block_no", F.floor(F.col("_at") / F.ceil(F.sqrt("df"))).cast("long")).drop("_at")


def _ends(placed: DataFrame) -> DataFrame:
    return placed.groupBy("term", "block_no").agg(F.max("doc_id").alias("max_doc_id"), F.count("*").alias("n_postings"))


def skip_blocks_of(postings: DataFrame, dictionary: DataFrame, threshold: int = SKIP_THRESHOLD) -> DataFrame:
    """(term, block_no, max_doc_id, n_postings) of the terms that have skip blocks."""
    return _ends(_placed(postings.join(dictionary.select("term", "df").filter(F.col("df") >= threshold), "term")))


def compressed_of(postings: DataFrame, dictionary: DataFrame, threshold: int = SKIP_THRESHOLD) -> DataFrame:
    """(term, block_no, n_postings, doc_bytes, tf_bytes): each block's ids (from 1) variable-byte, its frequencies unary.

    A block has at most max(threshold - 1, ceil(sqrt(df))) postings, so lists stay small however common a term is.
    """
    return _encoded(blocked(postings, dictionary, threshold))


def _encoded(placed: DataFrame) -> DataFrame:
    rows = placed.groupBy("term", "block_no").agg(F.sort_array(F.collect_list(F.struct((F.col("doc_id") + 1).alias("d"), "tf"))).alias("p"))
    return rows.select("term", "block_no", F.size("p").cast("long").alias("n_postings"), codecs.vbyte_encode(F.col("p.d")).alias("doc_bytes"), codecs.unary_encode(F.col("p.tf")).alias("tf_bytes"))


def decompressed(blocks: DataFrame) -> DataFrame:
    """(term, doc_id, tf) from compressed blocks."""
    lists = blocks.select("term", F.arrays_zip(codecs.vbyte_decode("doc_bytes").alias("d"), codecs.unary_decode("tf_bytes", "n_postings").alias("t")).alias("z"))
    return lists.select("term", F.explode("z").alias("z")).select("term", (F.col("z.d") - 1).alias("doc_id"), F.col("z.t").alias("tf"))


def build_index(docs: DataFrame, config: IndexConfig = IndexConfig(), *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """A lazy index over (id, text); save() it to search it more than once.

    Documents without tokens, and null ids, are left out. An empty collection gives an empty index.
    """
    one = analyzed(docs, config, id_col=id_col, text_col=text_col)
    stats, postings = stats_of(one), postings_of(one, config)
    dictionary = dictionary_of(postings, stats)
    blocks = skip_blocks_of(postings, dictionary, config.skip_threshold)
    compressed = compressed_of(postings, dictionary, config.skip_threshold) if config.compression else None
    return Index(config, postings, dictionary, one.select("doc_id", "docno", "doc_len"), stats, blocks, compressed, one)


def save(index: Index, path: str) -> Index:
    """Write the index (overwriting) and return it as read back.

    Texts are analysed once: their tokens are written, and everything else is made from what was written. Postings
    go out by ranges of terms and sorted, so a search for a few terms reads few row groups.
    """
    spark = index.postings.sparkSession
    _save_config(spark, index.config, path)
    all_postings, table = index.postings, index.doc_table
    if index.analysed is not None:
        index.analysed.write.mode("overwrite").parquet(f"{path}/analysed")
        tokens = spark.read.parquet(f"{path}/analysed")
        all_postings, table = postings_of(tokens, index.config), tokens.select("doc_id", "docno", "doc_len")
    table.write.mode("overwrite").parquet(f"{path}/doc_table")
    stats_of(spark.read.parquet(f"{path}/doc_table")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    all_postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(f"{path}/postings")
    if index.analysed is not None:
        _remove(spark, f"{path}/analysed")
    postings, stats = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats")
    dictionary_of(postings, stats).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/dictionary")
    dictionary = spark.read.parquet(f"{path}/dictionary")
    _save_blocks(postings, dictionary, index.config, path)
    return load(spark, path)


#: A written table of so many terms at most may be broadcast.
BROADCAST_TERMS = 200_000


def _save_blocks(postings: DataFrame, dictionary: DataFrame, config: IndexConfig, path: str) -> None:
    """Write skip_blocks and, if the configuration asks for it, compressed, from tables that are written; lists are numbered once for both."""
    spark, threshold = postings.sparkSession, config.skip_threshold
    terms = dictionary.select("term", "df")
    long = terms.filter(F.col("df") >= threshold)
    long = F.broadcast(long) if long.count() <= BROADCAST_TERMS else long
    if not config.compression:
        skip_blocks_of(postings, long, threshold).write.mode("overwrite").parquet(f"{path}/skip_blocks")
        return
    _placed(postings.join(long, "term")).write.mode("overwrite").parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    _ends(placed).write.mode("overwrite").parquet(f"{path}/skip_blocks")
    short = postings.join(long.select("term"), "term", "left_anti").withColumn("block_no", F.lit(0).cast("long"))
    columns = ["term", "block_no", "doc_id", "tf"]
    _encoded(placed.select(columns).unionByName(short.select(columns))).write.mode("overwrite").parquet(f"{path}/compressed")
    _remove(spark, f"{path}/placed")


def save_variant(base: Index, base_path: str, config: IndexConfig, path: str) -> Index:
    """Write an index of the same documents and terms as the saved one at base_path, under another configuration.

    Only its flags and blocks are written; load() takes the other tables from base_path, which must stay.
    """
    if config.terms != base.config.terms:
        raise ValueError("the configurations make different terms")
    _save_config(base.postings.sparkSession, config, path, base_path)
    _save_blocks(base.postings, base.dictionary, config, path)
    return load(base.postings.sparkSession, path)


def _save_config(spark: SparkSession, config: IndexConfig, path: str, base: str | None = None) -> None:
    flags = asdict(config) | ({"base": base} if base else {})
    spark.createDataFrame([(json.dumps(flags),)], "config string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Are all tables of an index there, with that of the compressed lists if its configuration asks for it?"""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = lambda at, *tables: all(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{t}/_SUCCESS")) for t in tables)
    if not whole(path, "config", "skip_blocks"):
        return False
    flags = json.loads(spark.read.text(f"{path}/config").first().value)
    return whole(flags.get("base", path), *SHARED) and (not flags["compression"] or whole(path, "compressed"))


def load(spark: SparkSession, path: str) -> Index:
    """A saved index; a path without one raises FileNotFoundError."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no index at {path}")
    flags = json.loads(spark.read.text(f"{path}/config").first().value)
    base = flags.pop("base", path)
    config = IndexConfig(**flags | {"stopwords": tuple(flags["stopwords"])})
    table = lambda t: spark.read.parquet(f"{base if t in SHARED else path}/{t}")
    return Index(config, table("postings"), table("dictionary"), table("doc_table"), table("stats"), table("skip_blocks"), table("compressed") if config.compression else None)
