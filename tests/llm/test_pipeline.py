"""The pipeline's stages, each against what it must keep, and the guard around this part."""

import os
import re
import shutil
import subprocess
import sys
import zlib
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from corpus_pipeline import STAGES
from quern.llm.substrings import repeated_passages

ROOT = Path(__file__).resolve().parents[2]


def test_stages_keep_the_schema(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.dtypes == spark.read.parquet(f"{sf_dir}/documents.parquet").dtypes
        assert 0 < docs.count() <= n
        n = docs.count()
    from tokenizers import Tokenizer

    tok, texts = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {r.doc_id: r.text or "" for r in docs.collect()}
    packed, want = STAGES[-1][1](spark, docs, sf_dir).collect(), {}
    for i, t in texts.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        want |= {(i, k): (b, len(ids[b : b + 4096]), zlib.crc32(np.array(ids[b : b + 4096], "<u4"))) for k, b in enumerate(range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed} == want and len(packed) == len(want)
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_each_stage_against_its_operator(spark, sf_dir, scratch):
    from test_licenses_passages import flagged
    from test_minhash import brute

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = {r.doc_id for r in STAGES[0][1](spark, docs, sf_dir).collect()}
    judged = [(d, q) for d, q in labels.items() if q is not None]
    assert sum((d in good) == (q == 1) for d, q in judged) / len(judged) >= 0.95
    rows, n_chars = [(r.doc_id, r.text) for r in docs.collect()], {r.doc_id: r.n_chars for r in docs.collect()}
    kept = {r.doc_id for r in STAGES[1][1](spark, docs, sf_dir).collect()}
    assert kept == {i for i, (_, c) in brute(rows, 80).items() if i == c}
    cut = {r.doc_id: r for r in STAGES[2][1](spark, docs, sf_dir).collect()}
    assert not flagged([(i, r.text) for i, r in cut.items()])
    passages = {}
    for r in repeated_passages(docs, scratch).collect():
        passages.setdefault(r.doc_id, []).append((r.start, r.end))
    assert flagged(rows) <= passages.keys()
    for i, t in rows:
        if i not in passages:
            assert cut[i].text == t and cut[i].n_chars == n_chars[i]
            continue
        raw = t.encode()  # what stands outside all passages, word by word
        left = [m[0].decode() for m in re.finditer(rb"[^ \t\n\v\f\r]+", raw) if not any(a <= m.start() < b for a, b in passages[i])]
        assert left == (re.findall(r"[^ \t\n\v\f\r]+", cut[i].text) if i in cut else [])
        assert i not in cut or cut[i].n_chars == len(cut[i].text)


def test_hard_rows_pass_all_stages(spark, hard_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (8, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (hard_docs, no_docs):
        now = docs
        for _, stage in STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns
        STAGES[-1][1](spark, now, str(tmp_path)).count()
    assert STAGES[1][1](spark, hard_docs, "").filter("doc_id in (1, 2, 6, 7)").count() == 2


def test_registered(spark):
    import __spark_entry__ as entry

    names = [n.split("_")[0] for n in entry.queries()]
    assert all(f"op{i}" in names for i in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in STAGES] == ["quality classifier", "minhash near-dedup", "substring dedup", "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert set(entry.oracle_sql()) <= set(entry.queries())


def run_in(copy, *command):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, *command], cwd=copy, check=True, env={**env, "PYTHONPATH": str(copy)})


NO_OPS = "import __spark_entry__ as e; q = e.queries(); assert 'search_or_bm25' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_the_rest_works_without_this_part(tmp_path, gone):
    """A copy without the two folders, with and without the pipeline, lists its queries and passes tests; nothing else imports this part."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *gone))
    run_in(copy, "-c", NO_OPS)
    run_in(copy, "-m", "pytest", "-q", "-x", "tests/test_text.py", "-k", "codec_vectors or config or tokens")
    for path in [*(ROOT / "quern").rglob("*.py")]:
        if "llm" not in path.parts:
            assert "quern.llm" not in path.read_text() and "from ..llm" not in path.read_text()


def test_the_rest_works_when_this_part_fails_to_import(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "tests"))
    (copy / "quern" / "llm" / "minhash.py").write_text("import there_is_no_such_module\n")
    run_in(copy, "-c", NO_OPS)
