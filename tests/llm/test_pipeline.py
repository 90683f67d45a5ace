"""The pipeline on planted documents, and each stage's columns."""

import hashlib
import os
import random
import subprocess
import sys

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from wardtable.llm import bpe

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean texts, toxic ones, copies, secrets, nulls; and labels."""
    root = tmp_path_factory.mktemp("corpus")
    draw = random.Random(1)
    words = [f"word{i}" for i in range(4000)]
    rows, labels = [], []
    for i in range(600):
        text = [draw.choice(words) for _ in range(60)]
        if i % 5 == 0:
            text[10:12] = ["nasty", "vile"]
        rows.append((i, " ".join(text), "en", f"s{i % 4}", 1))
        labels.append((i, 1, int(i % 5 == 0)))
    clean = [r for r in rows if r[0] % 5]
    rows += [(1000 + k, r[1], "en", "s9", 1) for k, r in enumerate(clean[:50])]
    rows += [(2000, "token=abcdefghijklmnop " + clean[3][1][::-1], "en", "s1", 1), (3000, None, None, None, None), (3001, "", "en", "s1", 0)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"file://{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"file://{root}/labels.parquet")
    return f"file://{root}"


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), after.schema)
        ids[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert not any(i < 600 and i % 5 == 0 for i in ids["toxicity"])
    assert {i for i in range(600) if i % 5} <= set(ids["toxicity"])
    assert not any(1000 <= i < 1050 for i in ids["near_duplicates"])
    assert {i for i in range(600) if i % 5} <= set(ids["near_duplicates"]) and len(set(ids["near_duplicates"])) == len(ids["near_duplicates"])
    assert sorted(ids["secrets"]) == sorted(ids["near_duplicates"])
    assert max(ids["mixing"].count(i) for i in set(ids["mixing"])) <= 3
    assert not docs.filter("text like '%abcdefghijklmnop%'").count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(last) == len(ids["mixing"])
    for r in last:
        assert r["n_tokens"] == len(plain.encode_ordinary(texts[r["doc_id"]]))
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_and_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 400
    spark.createDataFrame([], COLUMNS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_session_without_a_shared_folder(tmp_path):
    """A local session that names no folder gets one of its own; a folder is found again by the same application."""
    code = """
from wardtable.session import local_session
from wardtable.llm.common import saved, shared_root
spark = local_session(2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_root(spark) == shared_root(spark)
assert saved(spark.range(5), "rows").count() == 5
print("done")
"""
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join(sys.path)}
    ran = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=180)
    assert "done" in ran.stdout, ran.stderr[-2000:]
