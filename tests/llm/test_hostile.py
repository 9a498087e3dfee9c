"""Hot keys, clashing column names, repeated ids with different texts, and numbers at their ends."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from depweave.llm import ann, bloom, mixing, neardup, topk, urlfilter
from tests.llm.test_operators import DOCS, VECTORS, corpus, empty, junk, near_brute, text_of, top_brute, vectors, verdict_brute

#: Every name that an operator here gives a helper column, now or before.
HELPERS = "_key _tie _of _ranges _range _at _offset _before _copies _copy _may _block _lane0 _lane3 _text _group _bundle _number own pooled best k key cut body block may lane0 count parts part range sum offset before taken of tie hit n order gone host".split()


def crowded(df):
    return df.withColumns({c: F.lit(c) for c in HELPERS})


def untouched(rows):
    return all(r[c] == c for r in rows for c in HELPERS)


def test_clashing_names_in_mixing(spark):
    df = spark.createDataFrame(corpus(n=40), DOCS)
    want = sorted((r.doc_id, r["size"], r.target, r.taken) for r in mixing.mix(df).collect())
    got = mixing.mix(crowded(df))
    assert got.columns == [c for c in crowded(df).columns if c != "taken"] + ["size", "source_size", "target", "taken"]
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in got.collect()) == want
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in mixing.mix(df, columns=["doc_id"]).collect()) == want
    out = mixing.mixed_documents(crowded(df).withColumn("size", F.lit("size")))
    rows = out.collect()
    assert untouched(rows) and all(r["size"] == "size" for r in rows)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in mixing.mixed_documents(df).collect())


def test_many_sources_are_not_broadcast(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 9), "en", rng.choice([None, "hot", f"s{i}"]), 0) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS)
    key = lambda r: (r.doc_id, r["size"], r.target, r.taken)
    assert sorted(map(key, mixing.mix(df, mixing.Mix(most_sources=1, range_rows=32)).collect())) == sorted(map(key, mixing.mix(df).collect()))


def test_clashing_names_and_hot_urls(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "x.org", "/a")]
    urls = ["http://www.example.net/en/1"] * 700 + [f"http://h{i % 30}.net/{i}" for i in range(300)] + [None, "http://x.org/ab"]
    pages = crowded(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(6))
    for how in (urlfilter.UrlRules(), urlfilter.UrlRules(few_rules=0)):
        out = urlfilter.judge_urls(pages, urlfilter.rule_table(spark, rules), how)
        assert out.columns == [c for c in pages.columns if c != "host"] + ["host", "path", "rule", "verdict"]
        rows = out.collect()
        assert len(rows) == len(urls)
        for r in rows:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == verdict_brute(r.url, rules)
            assert r.best == "best" and r.body == "body"


def test_clashing_names_in_filters(spark):
    df = crowded(spark.createDataFrame([(i,) for i in [*range(50), None]], "id long"))
    keys = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "id long")
    for f, want in ((bloom.only_keys, {i for i in range(50) if i % 3 == 0}), (bloom.without_keys, {i for i in range(50) if i % 3} | {None})):
        out = f(df, "id", keys)
        rows = out.collect()
        assert out.columns == df.columns and {r.id for r in rows} == want and len(rows) == len(want) and untouched(rows)


def test_repeated_ids_with_different_texts(spark):
    """A document's texts all speak for it, in whatever order they come."""
    rng = random.Random(2)
    base = [text_of(rng, 40) for _ in range(6)]
    near = lambda t: t + " more"
    rows = [(5, base[0]), (5, base[1]), (7, near(base[0])), (3, near(base[1])), (9, base[2]), (9, base[2]), (11, base[3]), (11, None), (12, near(base[3])), (2, base[4]), (20, base[5])]
    for seed in range(2):
        rng.shuffle(rows)
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3 + seed)
        got = neardup.near_duplicates(docs).collect()
        assert len(got) == len(rows)
        component = {(r.doc_id, r.n_shingles > 0): r.component_id for r in got}
        assert component == {(5, True): 3, (7, True): 3, (3, True): 3, (9, True): 9, (11, True): 11, (11, False): 11, (12, True): 11, (2, True): 2, (20, True): 20}


def test_hot_bucket_and_hot_star(spark):
    """Hundreds of near copies of one text, which share buckets, beside two chains in the same buckets."""
    rng = random.Random(4)
    words = text_of(rng, 60).split()
    rows = [(i, " ".join([*words, f"own{i}"]), "en", "s", 0) for i in range(700)]
    half = words[:42]
    rows += [(1000 + i, " ".join([*half, *(f"a{i}x{j}" for j in range(22))]), "en", "s", 0) for i in range(40)]
    rows += [(2000 + i, " ".join([*half, *(f"b{j}" for j in range(20)), f"c{i}"]), "en", "s", 0) for i in range(40)]
    rng.shuffle(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), neardup.MinHash(block=8)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_brute(rows)


def test_long_scores_and_large_components(spark):
    rows = [(100, [3e300, 1.0]), (1, [3e300, 0.0]), (2, [-3e300, 5.0]), (3, [0.0, 2.0]), (4, [2e300, 1.0])]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (4, 2**63 - 1), (3, 1024 * 2048), (2, -(2**63))]


def test_first_tile_changes_nothing(spark):
    rows, good = vectors(seed=5, n=900)
    df = spark.createDataFrame(rows, VECTORS)
    want = [(q, n, v, int(s)) for q, n, v, s in top_brute(good, 100, 10, lambda v: np.floor(1024 * v))]
    for seeds in (0, 30, 400):
        how = topk.BlockSearch(seeds=seeds, tile_docs=100, block=8)
        assert sorted(map(tuple, topk.exact_top_k(df, how).collect())) == want


@pytest.mark.parametrize("kind", ["tiny lists", "copies", "short"])
def test_nearest_is_never_short(spark, kind):
    """Lists of a few rows, a third of all rows alike, and vectors of different lengths."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, 12))
    if kind == "copies":
        x[::3] = x[0]
    rows = [(i, v[: 1 + i % 12].tolist() if kind == "short" else v.tolist(), 0) for i, v in enumerate(x)]
    if kind == "tiny lists":
        # Each cluster is far away from the others and holds fewer rows than a query wants.
        rows = [(i, (v * 0.01 + 50 * np.eye(12)[i % 12] * (1 + i % 60 // 12)).tolist(), 0) for i, v in enumerate(x)]
    how = ann.Probing(list_rows=4, recall=0.01) if kind == "tiny lists" else ann.Probing(list_rows=40)
    got = ann.nearest(spark.createDataFrame(rows, VECTORS), how).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 600, 20))
    width = 12
    full = {i: np.array([*v, *[0.0] * (width - len(v))], np.float32).astype(float) for i, v, _ in rows}
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and len({r.vec_id for r in found}) == 20 and q not in {r.vec_id for r in found}
        assert all(abs(r.score - full[q] @ full[r.vec_id]) < 1e-9 * max(1, abs(r.score)) for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)


def stages_on(spark, tmp_path, docs, labels=()):
    path = str(tmp_path)
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
    return docs


def test_stages_on_clashing_names_and_empty_tables(spark, tmp_path):
    assert stages_on(spark, tmp_path / "a", empty(spark)).collect() == []
    rng = random.Random(9)
    rows = [(i, text_of(rng, 30), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more", "en", "s", 0) for i in range(10)] + [(200 + i, junk(rng, 30), "en", "s", 0) for i in range(30)]
    labels = [(i, int(i < 200), 0) for i, *_ in rows]
    df = crowded(spark.createDataFrame(rows, DOCS)).withColumns({"score": F.lit("s"), "predicted": F.lit("p"), "component_id": F.lit("c")})
    out = stages_on(spark, tmp_path / "b", df, labels)
    got = out.collect()
    assert out.columns == df.columns and untouched(got) and all((r.score, r.predicted, r.component_id) == ("s", "p", "c") for r in got)
    assert {r.doc_id for r in got} <= set(range(60))
    plain = stages_on(spark, tmp_path / "c", spark.createDataFrame(rows, DOCS), labels).collect()
    assert sorted(r.doc_id for r in plain) == sorted(r.doc_id for r in got)


def test_dedup_stage_on_null_and_repeated_ids(spark, tmp_path):
    """No text is lost, and no near copy stays, whatever the ids are."""
    rng = random.Random(10)
    base = [text_of(rng, 50) for _ in range(5)]
    rows = [(None, base[0]), (None, base[0]), (1, base[0] + " x"), (2, base[1]), (2, base[2]), (2, base[2]), (3, base[2] + " y"), (None, base[3]), (4, base[4]), (5, None), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", 0) for n, (i, t) in enumerate(rows)], DOCS)
    first = None
    for parts in (1, 4):
        got = sorted((r.doc_id or -1, r.text or "", r.source) for r in corpus_pipeline.minhash_near_dedup(spark, docs.repartition(parts), "").collect())
        texts = [t.removesuffix(" x").removesuffix(" y") for _, t, _ in got if t]
        assert sorted(texts) == sorted(base)
        assert sorted(i for i, t, _ in got if not t) == [5, 6]
        assert first in (None, got)
        first = got
