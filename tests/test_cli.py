"""The command line over a small collection, and posting dumps."""

from quern import cli
from quern.operators import index as ix
from quern.sources.dumps import dump_postings, read_dump

LINES = "D-10\tTest functionalities of the project\nD-2\tFunction to test the project\n\nD-3\tCheck the project functionalities\n"


def test_build_search_time_run(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "docs.tsv").write_text(LINES)
    (tmp_path / "queries.tsv").write_text("1\tthe test function\n2\tnothing known\n")
    at = f"file://{tmp_path}/index"
    assert cli.main(["build", "--docs", str(tmp_path / "docs.tsv"), "--index", at, "--compression"], spark) == 0
    index = ix.load(spark, at)
    assert index.config.compression and {r.docno for r in index.doc_table.collect()} == {"D-10", "D-2", "D-3"}
    said = []
    assert cli.interactive(index, cli.SearchOptions(k=2), ["test project\n", "\n", "nosuchterm\n", "x\n", "never\n"], said.append) == 2
    assert sorted(s.split("\t")[1] for s in said[:2]) == ["0.165", "0.165"] and said[3] == "the query is empty" and said[4].startswith("no results")
    monkeypatch.setattr("sys.stdin", iter(["check\n", "x\n"]))
    cli.main(["search", "--index", at, "--scorer", "tfidf", "--strategy", "maxscore"], spark)
    assert "D-3\t0.602" in capsys.readouterr().out
    cli.main(["time", "--index", at, "--queries", str(tmp_path / "queries.tsv"), "--report", str(tmp_path / "report")], spark)
    assert (tmp_path / "report").read_text().splitlines()[-1].startswith("Average time: ")
    cli.main(["run", "--index", at, "--queries", str(tmp_path / "queries.tsv"), "--out", str(tmp_path / "run"), "--mode", "or", "-k", "1"], spark)
    assert [r.value.split("\t")[:4] for r in spark.read.text(str(tmp_path / "run")).collect()] == [["1", "Q0", "D-2", "1"]]


def test_parquet_documents(spark, tmp_path):
    spark.createDataFrame([(7, "one two")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    (tmp_path / "words").write_text("one\n")
    cli.main(["build", "--docs", str(tmp_path / "docs"), "--index", f"file://{tmp_path}/i", "--stopwords-and-stemming", "--stopwords", str(tmp_path / "words")], spark)
    assert [r.term for r in ix.load(spark, f"file://{tmp_path}/i").dictionary.collect()] == ["two"]


def test_dumps(spark, tmp_path):
    made = ix.build_index(spark.createDataFrame([(5, "a a"), (2, "a b"), (9, "b")], "doc_id long, text string"))
    dump_postings(made, "a", str(tmp_path / "a"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "a")).collect()]
    assert sorted(lines) == ["docid: 2 tf: 1", "docid: 5 tf: 2"]
    (tmp_path / "a" / "part-head.txt").write_text("a heading\n")
    assert sorted(tuple(r) for r in read_dump(spark, str(tmp_path / "a")).collect()) == [(2, 1), (5, 2)]
