"""The index and ranked search on a small corpus with known scores, and invariants on the test tables."""

import io
import math
import random
import re
import tarfile
from collections import Counter

import pytest
from pyspark.sql import functions as F
from quern.operators import evaluate
from quern.operators import index as ix
from quern.operators.search import SearchOptions, next_geq, search, search_batch
from quern.sources import collections as src
from quern.streaming.search import answer

TEXTS = ["Test functionalities of the project", "Function to test the project", "Check the project functionalities"]
RANKED = {
    ("test project", "bm25"): [(0, 0.164739), (1, 0.164739), (2, 0.053655)],
    ("test project", "tfidf"): [(0, 0.425969), (1, 0.425969), (2, 0.124939)],
    ("functionalities", "bm25"): [(2, 0.129277), (0, 0.116420)],
    ("functionalities", "tfidf"): [(0, 0.301030), (2, 0.301030)],
    ("the test function", "bm25"): [(1, 0.397580), (0, 0.164739), (2, 0.053655)],
    ("the test function", "tfidf"): [(1, 1.028029), (0, 0.425969), (2, 0.124939)],
}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return ix.save(ix.build_index(docs), f"file://{tmp_path_factory.mktemp('index')}/small")


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ix.save(ix.build_index(docs, ix.IndexConfig(skip_threshold=16, compression=True)), f"file://{tmp_path_factory.mktemp('index')}/tables")


def listed(df):
    return [(r.doc_id, r.score) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize("query,scorer", RANKED)
@pytest.mark.parametrize("strategy", ["exhaustive", "maxscore"])
def test_known_scores(small, query, scorer, strategy):
    assert listed(search(small, query, SearchOptions(scorer=scorer, strategy=strategy))) == RANKED[query, scorer]


def test_conjunctive(small):
    one = SearchOptions(mode="and")
    assert listed(search(small, "test project", one)) == RANKED["test project", "bm25"][:2]
    assert listed(search(small, "test nosuchterm", one)) == listed(search(small, "test", one)) == listed(search(small, "test test"))
    assert search(small, "nosuchterm", one).count() == 0 == search(small, "?!").count()
    for bad in ("", "  ", None):
        with pytest.raises(ValueError):
            search(small, bad)


def test_statistics(small):
    assert small.stats.first()[:] == (4, 14.0)
    rows = {r.term: (r.df, r.cf, round(r.idf, 6)) for r in small.dictionary.collect()}
    assert rows["the"] == rows["project"] == (3, 3, 0.124939) and rows["test"] == (2, 2, 0.301030) and rows["of"] == (1, 1, 0.602060) and len(rows) == 8


@pytest.mark.parametrize("options", [{"k": 0}, {"k": "x"}, {"k": True}, {"mode": "nor"}, {"scorer": "x"}, {"strategy": "x"}])
def test_bad_options(options):
    with pytest.raises(ValueError):
        SearchOptions(**options)


def test_long_terms(spark):
    long = "abcdefghijklmnopqrstuvwxyz"
    made = ix.build_index(spark.createDataFrame([(1, long), (2, "other")], "doc_id long, text string"))
    assert search(made, long).count() == 0 and listed(search(made, long[:20]))[0][0] == 1


def test_left_out_documents(spark):
    rows = [(5, "one two"), (1, ""), (2, None), (3, " <b> "), (None, "one"), (9, "two")]
    made = ix.build_index(spark.createDataFrame(rows, "doc_id long, text string").withColumn("term", F.lit("x")))
    assert sorted(r.doc_id for r in made.doc_table.collect()) == [5, 9] and made.stats.first().n_docs == 3
    assert [(r.doc_id, r.number) for r in ix.numbered(made.doc_table).orderBy("doc_id").collect()] == [(5, 1), (9, 2)]
    none = ix.build_index(spark.createDataFrame([], "doc_id long, text string"))
    assert none.stats.first()[:] == (1, 0.0) and none.dictionary.count() == 0 and search(none, "one").count() == 0


def test_stopwords_and_stemming(spark):
    config = ix.IndexConfig(stopwords_and_stemming=True, stopwords=("the", "s"))
    made = ix.build_index(spark.createDataFrame([(1, "the hopping cats"), (2, "hop cat cat"), (3, "the s")], "doc_id long, text string"), config)
    assert sorted((r.term, r.doc_id, r.tf, r.doc_len) for r in made.postings.collect()) == [("cat", 1, 1, 2), ("cat", 2, 2, 3), ("hop", 1, 1, 2), ("hop", 2, 1, 3)]
    assert {d for d, _ in listed(search(made, "the HOPPED"))} == {1, 2} and search(made, "the").count() == 0


def test_invariants(tables):
    dictionary, postings = tables.dictionary, tables.postings
    stats = tables.stats.first()
    sums = dictionary.agg(F.sum("cf"), F.sum("df"), F.min("df"), F.max("df"), F.min(F.col("cf") - F.col("df"))).first()
    assert sums[0] == stats.total_len and sums[1] == postings.count() and 1 <= sums[2] <= sums[3] <= stats.n_docs - 1 and sums[4] >= 0
    blocks = tables.skip_blocks.join(dictionary, "term").groupBy("term").agg(F.sum("n_postings").alias("n"), F.first("df").alias("df"), F.max("n_postings").alias("most"), F.max("max_doc_id").alias("last"))
    last = postings.groupBy("term").agg(F.max("doc_id").alias("end"))
    for r in blocks.join(last, "term").collect():
        assert r.n == r.df >= 16 and r.most == math.ceil(math.sqrt(r.df)) and r.last == r.end
    back = ix.decompressed(tables.compressed)
    assert back.exceptAll(postings.select("term", "doc_id", "tf")).count() == 0 == postings.select("term", "doc_id", "tf").exceptAll(back).count()


@pytest.mark.parametrize("spread_out", [1, 2**50])
def test_long_lists_are_numbered_across_chunks(spark, monkeypatch, spread_out):
    """Dense ids, and sparse ones as hashes give them; columns that clash with the helpers stay."""
    monkeypatch.setattr(ix, "CHUNK_BITS", 3)
    ids = [i * spread_out for i in random.Random(1).sample(range(-100, 400), 90)]
    df = spark.createDataFrame([("a" if i // spread_out % 3 else "b", i, "x") for i in ids] + [("a", None, "x")], "term string, doc_id long, chunk string").withColumn("n", F.lit(1))
    out = ix.in_order(df, ["term"], "doc_id", "at")
    got = {(r.term, r.doc_id): r.at for r in out.collect()}
    assert out.columns == ["term", "doc_id", "chunk", "n", "at"] and len(got) == 90
    for t in "ab":
        assert [got[t, i] for i in sorted(i for i in ids if (i // spread_out % 3 > 0) == (t == "a"))] == list(range(sum((i // spread_out % 3 > 0) == (t == "a") for i in ids)))
    assert ix.in_order(df.limit(0), ["term"], "doc_id", "at").count() == 0 and sorted(r.number for r in ix.numbered(df).collect()) == list(range(1, 91))


def many_queries(spark, tables, n=60):
    rng = random.Random(4)
    terms = [r.term for r in tables.dictionary.orderBy(F.desc("df"), "term").limit(400).collect()]
    return [(str(i), " ".join(rng.choices(terms[: rng.choice([5, 50, 400])], k=rng.randrange(1, 6)))) for i in range(n)] + [("none", "nosuchterm"), ("blank", "!")]


@pytest.mark.parametrize("scorer", ["bm25", "tfidf"])
def test_batches(spark, tables, scorer):
    asked = many_queries(spark, tables)
    queries = spark.createDataFrame(asked, "qid string, query string")
    pick = lambda **o: sorted((r.qid, r["rank"], r.doc_id, r.score) for r in search_batch(tables, queries, SearchOptions(scorer=scorer, **o)).collect())
    full = pick()
    assert full == pick(strategy="maxscore") and not {q for q, *_ in full} & {"none", "blank"}
    for qid, text in asked[:4]:
        assert [(d, s) for q, _, d, s in full if q == qid] == listed(search(tables, text, SearchOptions(scorer=scorer)))
    wide = {(q, d) for q, _, d, _ in pick(k=10**6)}
    both = pick(mode="and", k=10**6)
    assert {(q, d) for q, _, d, _ in both} <= wide
    assert max(Counter(q for q, *_ in full).values()) <= 10


def test_heap_ties(spark):
    """A newcomer that ties with the head is turned away, a better one drives out the smallest id among the worst."""
    rows = [(1, "a b"), (2, "a b"), (3, "a b"), (4, "a a"), (5, "c c")]
    made = ix.build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    plain, heap = (listed(search(made, "a", SearchOptions(k=2, scorer="tfidf", tie_compat=t))) for t in (False, True))
    assert [d for d, _ in plain] == [4, 1] and [d for d, _ in heap] == [4, 2]
    assert [s for _, s in plain] == [s for _, s in heap]


def test_next_geq(spark, tables):
    term = tables.dictionary.orderBy(F.desc("df"), "term").first().term
    ids = sorted(r.doc_id for r in tables.postings.filter(F.col("term") == term).collect())
    targets = [0, ids[3], ids[3] + 1, ids[-1], ids[-1] + 1]
    got = {r.target: r.doc_id for r in next_geq(tables, spark.createDataFrame([(term, t) for t in targets] + [("nosuchterm", 0)], "term string, target long")).collect()}
    assert got == {t: min(i for i in ids if i >= t) for t in targets if t <= ids[-1]}


def test_pruned_scan(tables):
    plan = search(tables, "the of")._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\n]*term[^\n]*ReadSchema: struct<term:string,doc_id:bigint,tf", plan), plan


def test_sources_and_runs(spark, small, tmp_path):
    lines = "0\tTest functionalities of the project\n\nno tab here\n1\tFunction to test\tthe project\n \t \n2\tCheck the project functionalities\n"
    (tmp_path / "docs.tsv").write_text(lines)
    want = [("0", "Test functionalities of the project"), ("1", "Function to test\tthe project"), ("2", "Check the project functionalities")]
    assert sorted(tuple(r) for r in src.read_tsv(spark, str(tmp_path / "docs.tsv")).collect()) == want
    with tarfile.open(tmp_path / "docs.tar.gz", "w:gz") as tar:
        for name, text in (("one.tsv", lines), ("two.tsv", "9\tnever read\n")):
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))
    assert sorted(tuple(r) for r in src.read_tar(spark, str(tmp_path / "docs.tar.gz")).collect()) == want
    (tmp_path / "queries.tsv").write_text('7\ttest "project\n8\tnosuchterm\n')
    queries = src.read_queries(spark, str(tmp_path / "queries.tsv"))
    rows = evaluate.trec_rows(small, queries)
    evaluate.write_trec(rows, str(tmp_path / "run"))
    got = [r.value for r in spark.read.text(str(tmp_path / "run")).collect()]
    assert got == ["7\tQ0\t0\t1\t0.164739\tRUN-01", "7\tQ0\t1\t2\t0.164739\tRUN-01", "7\tQ0\t2\t3\t0.053655\tRUN-01"]
    assert [r.score for r in evaluate.shown(search(small, "test project")).collect()] == ["0.165", "0.165", "0.054"]
    times, mean = evaluate.timings(small, queries)
    assert len(times) == 2 and mean == sum(t for *_, t in times) // 2
    (tmp_path / "words").write_text("b\na\nb\n\n")
    assert src.read_words(spark, str(tmp_path / "words")) == ("a", "b")
    stream = answer(spark.readStream.schema("qid string, query string").option("sep", "\t").csv(str(tmp_path / "queries*")), small, str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    stream.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_load(spark, small, tmp_path):
    with pytest.raises(FileNotFoundError):
        ix.load(spark, f"file://{tmp_path}/none")
    assert small.config == ix.IndexConfig()


def test_spread(spark, sf_dir):
    from quern.operators.spread import spread

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert spread(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(docs).count() == docs.count()
    assert spread(spark.range(10**9)).rdd.getNumPartitions() == spark.range(10**9).rdd.getNumPartitions()


def test_variant_shares_tables(spark, sf_dir, small, tmp_path, monkeypatch):
    """An index that differs in blocks only writes its blocks, and equals one that is built on its own."""
    from quern.plans import workspace

    config = ix.IndexConfig(skip_threshold=16, compression=True)
    table = f"file://{tmp_path}/docs.parquet"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    docs.write.parquet(table)
    docs = spark.read.parquet(table)
    built = []
    monkeypatch.setattr(workspace, "build_index", lambda *a, **k: built.append(a) or ix.build_index(*a, **k))
    workspace.index_of(spark, table)
    made = workspace.index_of(spark, table, config)
    assert len(built) == 1 and made.config == config
    alone = ix.save(ix.build_index(docs, config), f"file://{tmp_path}/alone")
    for name in ("postings", "dictionary", "doc_table", "stats", "skip_blocks", "compressed"):
        rows = [sorted(map(repr, getattr(x, name).collect())) for x in (made, alone)]
        assert rows[0] == rows[1] and (name == "stats" or rows[0]), name
    assert workspace.index_of(spark, table, ix.IndexConfig(stopwords_and_stemming=True)).config.stopwords_and_stemming and len(built) == 2
    with pytest.raises(ValueError):
        ix.save_variant(small, "x", ix.IndexConfig(stopwords_and_stemming=True), f"file://{tmp_path}/other")
