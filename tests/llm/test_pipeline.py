"""The pipeline's stages against brute force, and the registered queries."""

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from depweave.llm import queries
from tests.llm.test_operators import DOCS, corpus, junk, library, mix_brute, near_brute


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = corpus(seed=8, n=80)
    rows += [(1000 + i, junk(rng, 30), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [rows[3]]  # a repeated row
    labels = [(i, int(i < 1000), 0) for i, *_ in rows if i % 3]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages(spark, sf_dir):
    path, rows = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {r[0]: r for r in rows}

    one = corpus_pipeline.quality_classifier(spark, docs, path)
    assert one.columns == columns
    clean = {i: r for i, r in kept.items() if i < 1000}
    got = {r.doc_id for r in one.collect()}
    odd = {i for i, r in clean.items() if len((r[1] or "").split()) < 5 or len(set(r[1])) < 5}  # too short to tell
    assert got - odd == set(clean) - odd

    two = corpus_pipeline.minhash_near_dedup(spark, one, path)
    assert two.columns == columns
    passed = [r for i, r in kept.items() if i in got]
    classes = near_brute(passed, 5)
    left = {i for i, (_, c) in classes.items() if i == c}
    assert sorted(r.doc_id for r in two.collect()) == sorted(left)

    three = corpus_pipeline.source_mixing(spark, two, path)
    assert three.columns == columns
    copies = {i: 1 if n == 0 else int(t / n + 0.5) for i, n, _, _, t in mix_brute([kept[i] for i in left])}
    assert sorted(r.doc_id for r in three.collect()) == sorted(itertools.chain.from_iterable([i] * n for i, n in copies.items()))

    four = corpus_pipeline.bpe_encoding(spark, three, path).collect()
    tok = library("byte_bpe_50k.json")
    assert len(four) == sum(copies.values())
    for r in four:
        ids = np.array(tok.encode(kept[r.doc_id][1] or "", add_special_tokens=False).ids, "<u4")
        assert r.ids == ids.tobytes() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256((kept[r.doc_id][1] or "").encode()).hexdigest()

    whole = corpus_pipeline.run(spark, path)
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id, r.ids_sha256) for r in four)


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.SQL) <= set(queries.QUERIES) and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert public_tokenizers.path("byte_bpe_50k.json").endswith(".json")
