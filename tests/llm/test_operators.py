"""The ten operators against brute force, library results and round trips on small tables."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from depweave.llm import ann, bpe, mixing, neardup, quality, sharding, tokenbin, tokencount, topk, urlfilter
from depweave.operators.cluster import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus(seed=1, n=120):
    """Texts with near copies, exact copies, nulls, empties, odd white space and a very long one."""
    rng = random.Random(seed)
    texts = [text_of(rng, rng.randrange(5, 80)) for _ in range(n)]
    for base in list(texts[:20]):
        words = base.split()
        for _ in range(3):
            own = list(words)
            own[rng.randrange(len(own))] = "changed" + str(rng.randrange(9))
            texts.append(" ".join(own))
    texts += [texts[0]] * 30 + [None, "", "  \t\n", "One", "one", "ONE two", "É é", "a\x1cb c\u00a0d", "😀 ab<|endoftext|>cd  ", "x" * 3000, text_of(rng, 9000)]
    return [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    # A column that clashes with what operators return, and a repeated row.
    return spark.createDataFrame([*rows, rows[5]], DOCS).withColumn("size", F.lit(1)).withColumn("score", F.lit("x")), [*rows, rows[5]]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, size=2):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def near_brute(rows, size=2, similar=80):
    sets = {i: shingles(t, size) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= similar * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(spark, docs):
    df, rows = docs
    out = neardup.near_duplicates(df).collect()
    assert len(out) == len(rows)
    want = near_brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_duplicates_with_small_blocks_and_long_shingles(spark):
    rows = corpus(seed=4, n=60)
    df = spark.createDataFrame(rows, DOCS)
    how = neardup.MinHash(shingle=5, block=4)
    out = neardup.near_duplicates(df, how).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == near_brute(rows, 5)


def test_chains_that_no_star_sees(spark):
    """Near copies that drift: ends of a chain aren't similar, neighbours are."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(100)]
    texts = []
    for step in range(40):
        words[(step * 7) % 100] = f"new{step}"
        words[(step * 7 + 1) % 100] = f"also{step}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: c for i, (_, c) in near_brute(rows).items()}


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    assert neardup.near_duplicates(empty(spark)).collect() == []
    rows = [(None, "a b c", None, None, None), (3, "a b c", None, None, None), (None, None, None, None, None)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in out) == [(-1, 0, -1, False), (-1, 2, 3, False), (3, 2, 3, True)]


def test_estimate_is_near_the_similarity():
    how = neardup.MinHash()
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for share in (0.2, 0.5, 0.8, 0.95):
        n = int(2000 * share)
        a, b = x[:2000], np.concatenate((x[:n], rng.integers(0, 2**63, 2000 - n).astype(np.uint64)))
        bits = neardup.packed(neardup.minima([a, b], how))
        assert abs(neardup.estimated(bits[:1], bits[1:])[0] - n / (4000 - n)) < 0.15


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), src="a", dst="b").collect()}
    root = {x: x for e in edges if None not in e for x in e}
    for _ in range(400):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def verdict_brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else default


def test_url_filter(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "a.b.example.org", "/fr/x")]
    urls = [None, "", "no scheme", "http://", "https://A.Example.NET/en/1?q=/de/", "http://example.net", "http://example.net/", "http://notexample.com/de/", "http://www.example.com/de/?x://y", "http://example.com/deep", "HTTP://x.org/fr/#a", "ftp://a.b.example.org/fr/xyz", "://net/", "http://a..net//", "http://É.net/en", "x" * 5000 + "://net/" + "y" * 5000, "http://line\nbreak.net/\n?"]
    urls += [f"https://{a}.{b}/{c}/{i}" for i, (a, b, c) in enumerate(itertools.product(("m", "blog.x"), ("example.net", "example.com", "x.org", "y.de"), ("en", "de", "fr")))]
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate([*urls, urls[4]])], "page_id long, url string, Rule string")
    out = urlfilter.judge_urls(pages, urlfilter.rule_table(spark, rules)).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == verdict_brute(r.url, rules), r.url
    none = urlfilter.judge_urls(pages.drop("Rule"), urlfilter.rule_table(spark, rules).limit(0)).collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "allow")}
    assert urlfilter.judge_urls(pages.limit(0), urlfilter.rule_table(spark, rules)).collect() == []


def test_url_filter_with_many_rules_and_a_crowded_filter(spark):
    rules = [("block", f"h{i}.example", f"/{'p' * (i % 9)}") for i in range(500)]
    pages = spark.createDataFrame([(i, f"http://s.h{i}.example/ppp/{i}") for i in range(900)], "page_id long, url string")
    out = urlfilter.judge_urls(pages, urlfilter.rule_table(spark, rules), urlfilter.UrlRules(max_blocks=2)).collect()
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == verdict_brute(r.url, rules)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_token_files(spark, docs):
    df, rows = docs
    got = {}
    path = public_tokenizers.path("word_bpe_49k.json")
    for r in tokenbin.read_token_files(*tokenbin.write_token_files(df, path, tokenbin.TokenFiles(block=500)), ids=True).collect():
        got.setdefault(r.doc_id, []).append(r)
    tok, start = library("word_bpe_49k.json"), 0
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        r = min(got[i], key=lambda r: r.start)
        got[i].remove(r)
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    assert not any(got.values())
    assert tokenbin.token_files(empty(spark), path).collect() == []


def test_words_coded_as_the_library_does():
    tok, coder = library("word_bpe_49k.json"), tokenbin.WordCoder(public_tokenizers.path("word_bpe_49k.json"), 50)
    rng = random.Random(1)
    pool = "aA zZ'sS'T 1½٣ é e\u0301 \u00a0\u2028\x1c\x85 ΑΣ ΣΑΣ. İ ǅ ß ﬁ 中文 😀<|endoftext|> <|startoftext|> \t\n\x0b\r".split(" ") + list(" \n\t\u3000.,!'")
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += ["<|ENDOFTEXT|> <|EndOfText|>", "ABC<|endoftext|>DEF É"]
    for text, ids in zip(texts, [x for t in texts for x in coder.encode([t], 1)], strict=True):
        assert np.frombuffer(ids, coder.kind).tolist() == [*tok.encode(text, add_special_tokens=False).ids, 1], repr(text)


def test_plain_words_are_coded_by_runs():
    tok, coder = library("word_bpe_49k.json"), tokenbin.WordCoder(public_tokenizers.path("word_bpe_49k.json"), 50)
    rng = random.Random(3)
    pool = "abzAZ019.,;$%&!?-_<|>()[]\\^`~@#\"/{}=+*:ÀÖØßéöøÿÇÑ"
    words = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    want = [[*tok.encode(w, add_special_tokens=False).ids, 1] for w in words]
    coder.tokenizer = None  # plain words don't need the library's whole way
    assert [np.frombuffer(x, coder.kind).tolist() for w in words for x in coder.encode([w], 1)] == want
    assert len(coder.runs) <= 50
    coder.tokenizer = tok
    # Words with an apostrophe, an added token, other letters or marks that join with a letter go the whole way.
    for text in ("don't 'tis x's!'s 's1", "ab<|endoftext|>cd, e", "plain e\u0301, ×÷ǅ ΣΑΣ. ½x", "a<|ENDOFTEXT|>b É<|startoftext|>É9"):
        assert np.frombuffer(coder.encode([text], 1)[0], coder.kind).tolist() == [*tok.encode(text, add_special_tokens=False).ids, 1], text


def test_control_byte_coding():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (2.0 ** rng.uniform(0, 32, n)).astype(np.uint32)
        control, data = tokenbin.pack(values)
        assert len(control) == -(-n // 4)
        assert tokenbin.unpack(control, data, n).tolist() == values.tolist()
    control, data = tokenbin.pack(np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1]))
    assert len(data) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4


def mix_brute(rows, weights=(5, 2, 1), most=3):
    size = lambda t: len((t or "").encode().split())
    by = {}
    for i, t, _, s, _ in rows:
        by.setdefault(s, []).append((hashlib.md5(f"mix:{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest(), i, size(t)))
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, sizes = sum(x[2] for v in by.values() for x in v), {s: sum(x[2] for x in v) for s, v in by.items()}
    target, open_, left = {}, set(order), float(total)
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if level * weight[s] > most * sizes[s]]
        for s in above or list(open_):
            target[s] = most * sizes[s] if above else level * weight[s]
            left -= target[s] if above else 0
            open_.remove(s)
    out = []
    for s, v in by.items():
        budget, before = round(target[s]), 0
        epochs, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for _, i, n in sorted(v):
            out.append((i, n, sizes[s], round(target[s], 6), epochs * n + min(n, max(0, rest - before))))
            before += n
    return sorted(out)


def test_mixing(spark, docs):
    df, rows = docs
    got = mixing.mix(df, mixing.Mix(range_rows=7)).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == mix_brute(rows)
    skewed = [(i, "w " * (1 + i % 5), "en", "abc"[min(i, 2)], 0) for i in range(200)]
    got = mixing.mix(spark.createDataFrame(skewed, DOCS)).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == mix_brute(skewed)
    assert mixing.mix(empty(spark)).collect() == []
    nothing = [(1, None, None, None, None), (2, "", None, "a", None)]
    assert {(r.target, r.taken) for r in mixing.mix(spark.createDataFrame(nothing, DOCS)).collect()} == {(0.0, 0)}


def test_mixed_documents(spark, docs):
    df, rows = docs
    taken = {i: (n, t) for i, n, _, _, t in mix_brute(rows) if i != rows[5][0]}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for i, (n, t) in taken.items():
        assert counts.get(i, 0) == (1 if n == 0 else int(t / n + 0.5))


def plain_schedule(sizes, shards):
    """Loads and, per size, how many of it each shard got: one item at a time to the least-loaded shard."""
    loads, got = [0] * shards, {}
    for size in sorted(sizes, reverse=True):
        i = loads.index(min(loads))
        loads[i] += size
        got.setdefault(size, [0] * shards)[i] += 1
    return loads, got


def test_schedule_of_a_histogram():
    rng = random.Random(12)
    for shards in (1, 3, 24):
        for _ in range(60):
            hist = {rng.randrange(1, rng.choice([5, 50, 5000])): rng.choice([1, 2, 7, rng.randrange(1, 2000)]) for _ in range(rng.randrange(1, 12))}
            _, want = plain_schedule([s for s, n in hist.items() for _ in range(n)], shards)
            got = {s: [b - a for a, b in zip([0, *ends], ends, strict=False)] for s, ends in sharding.schedule(list(hist.items()), shards)}
            assert got == want


@pytest.mark.parametrize("few", [1 << 15, 0])
def test_sharding(spark, docs, few):
    df, rows = docs
    got = sharding.shard(df, sharding.Shards(range_rows=16, few_sizes=few)).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, *_ in rows}
    assert all(r["size"] == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    where = {(text[r.doc_id], r.shard) for r in got}
    assert len(where) == len(set(text.values()))
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    # Every size has as many groups in each shard as the plain rule gives it.
    groups = {}
    for r in got:
        groups[text[r.doc_id]] = groups.get(text[r.doc_id], 0) + r["size"]
    placed = {}
    for t, s in where:
        placed.setdefault(groups[t], [0] * 24)[s] += 1
    assert placed == plain_schedule(groups.values(), 24)[1]


def test_sharding_of_nothing_and_of_clashing_names(spark, docs):
    assert sharding.shard(empty(spark)).collect() == []
    df, rows = docs
    odd = df.withColumns({c: F.lit(c) for c in ("own", "pooled", "group", "_group", "offset", "_offset", "bytes", "range", "body", "part", "ends", "place", "number", "chance", "shard")})
    got = sharding.shard(odd)
    assert got.columns == [c for c in odd.columns if c not in ("size", "shard")] + ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted((r.doc_id, r.shard, r.slot) for r in got.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard(df, columns=["doc_id"]).collect())
    assert all(r.body == "body" and r.bytes == "bytes" for r in got.collect())


def test_even_shards(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(2000), "en", "s", 0) for i in range(5000)]
    loads = [r[0] for r in sharding.shard(spark.createDataFrame(rows, DOCS)).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(loads) == 24 and max(loads) < 1.01 * min(loads)


def junk(rng, n):
    return " ".join(w + rng.choice(["%%%", "###", "&&&"]) for w in text_of(rng, n).split())


def test_quality(spark):
    rng = random.Random(6)
    rows = [(i, junk(rng, 40) if i % 5 == 0 else text_of(rng, 40), "en", "s", 0) for i in range(400)] + [(900, None, None, None, None), (901, "", None, None, None), (902, "ab", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(400)] + [(None, 1, 0), (901, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r.predicted == (r.doc_id % 5 != 0) for r in held if r.doc_id < 900)
    # Labels of the held-out part change nothing.
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality.score(df, flipped).collect()) == sorted(got)
    assert {r.score for r in quality.score(df, labels.limit(0)).collect()} == {1.0}
    assert quality.score(empty(spark), labels).collect() == []
    kept = quality.score(df.withColumn("Score", F.lit(0)), labels, columns=["doc_id", "Score", "text"])
    assert kept.columns == ["doc_id", "text", "held_out", "score", "predicted"]


def runs_brute(text, terms, seed):
    """Log counts of hashed runs of three bytes, at length 1, by plain loops."""
    raw = (text or "").encode()
    classed = []
    for b in raw:
        c = chr(b)
        kind = "a" if b >= 128 or "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else " " if c in "\t\x0b\x0c\r" else c
        if not (classed and classed[-1] == kind and kind in "aA0"):
            classed.append(kind)
    out = []
    for x, k in (([ord(c) for c in classed], seed), (list(raw), seed + 1)):
        counts = [0.0] * terms
        for a, b, c in zip(x, x[1:], x[2:], strict=False):
            counts[((a << 16 | b << 8 | c) * (0x9E3779B1 + 2 * k) % 2**32) >> (32 - terms.bit_length() + 1)] += 1
        logs = [math.log1p(v) for v in counts]
        length = math.sqrt(sum(v * v for v in logs))
        out += [v / max(length, 1e-9) for v in logs]
    return out


def test_quality_votes(spark):
    """Every score against plain votes: an SVD of all labelled texts, cosines with each, the nearest by hand."""
    rng = random.Random(16)
    how = quality.Voting(terms=64, dimensions=6, neighbours=5)
    rows = [(i, junk(rng, rng.randrange(3, 30)) if rng.random() < 0.4 else text_of(rng, rng.randrange(3, 30)), "en", "s", 0) for i in range(150)]
    rows += [(200, None, None, None, None), (201, "", None, None, None), (202, "été 12\tAB", None, None, None)]
    known = {i: rng.randrange(2) for i in range(0, 150, 2) if zlib.crc32(str(i).encode()) % 4 != 2}
    text = {r[0]: r[1] for r in rows}
    x = np.array([runs_brute(text[i], how.terms, how.seed) for i in known])
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.2
    space = weight[:, None] * np.linalg.svd(x * weight)[2][: how.dimensions].T
    labels = list(known.values())
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, q, 0) for i, q in known.items()], "doc_id long, quality int, toxic int"), how).collect()}
    assert set(got) == set(text)
    for i, own in text.items():
        v = np.array(runs_brute(own, how.terms, how.seed)) @ space
        near = sorted(((float(v @ u) / max(np.linalg.norm(v) * np.linalg.norm(u), 1e-9), q) for u, q in zip(x @ space, labels, strict=True)), reverse=True)[: how.neighbours]
        total = sum(max(c, 0) ** how.power for c, _ in near)
        want = sum(max(c, 0) ** how.power * q for c, q in near) / total if total > 0 else sum(labels) / len(labels)
        assert abs(got[i] - want) < 2e-3, i


def test_quality_on_clashing_names_and_repeated_ids(spark):
    rng = random.Random(7)
    rows = [(i, text_of(rng, 20), "en", "s", 0) for i in range(60)] + [(i, junk(rng, 20), "en", "s", 0) for i in range(0, 60, 3)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    want = sorted((r.doc_id, r.text, r.score) for r in quality.score(df, labels, columns=df.columns).collect())
    odd = df.withColumns({c: F.lit(c) for c in ("_text", "__text", "label", "counts", "quality", "vectors")}).repartition(5)
    got = quality.score(odd, labels, columns=odd.columns)
    assert got.columns == [*odd.columns, "held_out", "score", "predicted"]
    assert sorted((r.doc_id, r.text, r.score) for r in got.collect()) == want
    assert all(r._text == "_text" and r.counts == "counts" for r in got.collect())


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed=0, n=700, width=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width))
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    rows += [(n + i, rows[40][1], 0) for i in range(60)]  # ties
    bad = [None, [], [None] * width, [float("nan")] * width, [float("inf"), *[0.0] * (width - 1)]]
    rows += [(2000 + 100 * i, v, None) for i, v in enumerate(bad)] + [(None, rows[1][1], 0)]
    return rows, [r for r in rows if r[0] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1])]


def top_brute(good, every, k, f):
    x = np.array([f(np.array(v, np.float64)) for _, v, _ in good])
    out = []
    for i, _, _ in good:
        if i % every == 0:
            scores = x @ x[[r[0] for r in good].index(i)]
            ranked = sorted(((-s, r[0]) for s, r in zip(scores.tolist(), good, strict=True) if r[0] != i))[:k]
            out += [(i, n + 1, v, -s) for n, (s, v) in enumerate(ranked)]
    return out


def test_exact_top_k(spark):
    rows, good = vectors()
    df = spark.createDataFrame(rows, VECTORS)
    want = top_brute(good, 100, 10, lambda v: np.floor(1024 * v))
    for how in (topk.BlockSearch(), topk.BlockSearch(block=5, tile_docs=50, tile_queries=3, least_tiles=2)):
        assert sorted(tuple(r) for r in topk.exact_top_k(df, how).collect()) == [(q, n, v, int(s)) for q, n, v, s in want]
    few = spark.createDataFrame(good[:4], VECTORS)
    assert len(topk.exact_top_k(few).collect()) == 3
    assert topk.exact_top_k(df.limit(0)).collect() == []


def test_exact_top_k_beyond_doubles(spark):
    rows = [(i, [float(2**20 + i), float(2**19 - i)], 0) for i in range(30)]
    good = [(i, [int(1024 * a), int(1024 * b)]) for i, (a, b) in ((r[0], r[1]) for r in rows)]
    want = sorted(((-sum(x * y for x, y in zip(v, good[0][1], strict=True)), i) for i, v in good if i))[:10]
    got = topk.exact_top_k(spark.createDataFrame(rows, VECTORS)).orderBy("rank").collect()
    assert [(-r.score, r.vec_id) for r in got] == want


def test_block_search_skips_blocks():
    """Clustered documents: most blocks' bounds fall below the kth score."""
    rng = np.random.default_rng(0)
    centers = rng.standard_normal((16, 16)) * 300
    x = np.floor(centers[np.arange(1600) % 16] + rng.standard_normal((1600, 16)) * 10)
    seen = []

    class Counted(np.ndarray):
        pass

    ids, q = np.arange(1600), x[:8]
    query, score, vec = topk.search_tile(ids, x, ids[:8], q, topk.BlockSearch())
    seen = np.argsort(-(q @ x.T + np.where(np.eye(8, 1600) > 0, -np.inf, 0)), axis=1, kind="stable")[:, :10]
    assert [sorted(vec[query == i].tolist()) for i in range(8)] == [sorted(s.tolist()) for s in seen]


def test_bpe_equals_the_library(spark, docs):
    df, rows = docs
    tok = library("byte_bpe_50k.json")
    text = {i: t or "" for i, t, *_ in rows}
    got = bpe.encode_decode(df, public_tokenizers.path("byte_bpe_50k.json"), ids=True, text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = tok.encode(text[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded == tok.decode(ids, skip_special_tokens=False) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_decode(empty(spark), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_bpe_on_odd_strings():
    coder, tok = bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"), symbols=50), library("byte_bpe_50k.json")
    rng = random.Random(9)
    pool = ["a", "aa", "aaaa", "the", " the", "  ", "\n", "\t ", "'s", "'re", "é", "中", "😀", "\u00a0", "1", "12", "!!", "<|endoftext|>", "\x00", "́", "zzzzz"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(500)] + ["a" * n for n in range(1, 40)] + [" " * 500, "ab" * 400]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        want = tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert coder.decode(ids) == tok.decode(want, skip_special_tokens=False)
    assert coder.decode(np.array([447, 0], "<u4").tobytes()) == tok.decode([447, 0], skip_special_tokens=False)


def test_token_counts(spark, docs):
    import sentencepiece

    df, rows = docs
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    text = {i: t or "" for i, t, *_ in rows}
    for how in (tokencount.Counting(), tokencount.Counting(limit=20, frequent=10, task_summary=5, task_counter=50, worker_cache=20)):
        got = tokencount.count_tokens(df, path, how).collect()
        assert len(got) == len(rows)
        for r in got:
            n = len(model.encode(text[r.doc_id]))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > how.limit)
    assert tokencount.count_tokens(empty(spark), path).collect() == []


def test_pretokens_add_up():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), tokencount.processor(path)
    rng = random.Random(2)
    pool = ["a", " ", "  ", "▁", "\n", "\t", "the", " The", "é", "中", "😀", "\x00", "<s>", "</s>", "<unk>", "<0x0A>", "12", ".", "\r\n", "\u3000", "    x"]
    for _ in range(600):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(25)))
        assert sum(len(own.encode(w)) for w in tokencount.pretokens(text)) == len(model.encode(text)), repr(text)


def test_nearest_reaches_recall(spark):
    rows, good = vectors(seed=3, n=3000)
    good = [r for r in good if any(r[1])]
    df = spark.createDataFrame([*rows, (5000, [0.0] * 24, 0)], VECTORS)
    want = {}
    for q, _, v, s in top_brute(good, 20, 20, lambda v: v):
        want.setdefault(q, {})[v] = s
    got = ann.nearest(df, ann.Probing(list_rows=100, tile_docs=64, tile_queries=50)).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(want) and all([r.rank for r in sorted(x, key=lambda r: r.rank)] == list(range(1, 21)) for x in by.values())
    x = {i: np.array(v, np.float64) for i, v, _ in good}
    assert all(abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-12 * max(1, abs(r.score)) for r in got)
    hit = sum(r.score >= min(want[r.query_id].values()) - 1e-9 for r in got) / sum(map(len, want.values()))
    assert hit >= 0.9
    assert ann.nearest(df.limit(0)).collect() == []
    assert len(ann.nearest(spark.createDataFrame(good[:3], VECTORS)).collect()) == 2
    assert ann.nearest(spark.createDataFrame(good[:1], VECTORS)).collect() == []
