"""Phrases, WARC archives and spelling variants against brute force and round trips."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from depweave.llm import blocked, phrases, variants, warc

DOCS = "doc_id long, lang string, text string, n long, word string, at int"


def table(spark, rows):
    """Documents with further columns, named like the operators' own."""
    return spark.createDataFrame([(i, lang, t, 1, "w", 2) for i, lang, t in rows], DOCS)


# phrases


def phrases_brute(rows, least, longest=5, top=2000, scale=1000):
    n, f = Counter(), Counter()
    small = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(small)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    out = defaultdict(list)
    for (lang, words), a in f.items():
        if len(words) == 1:
            continue
        longer = [w for (x, w), b in f.items() if x == lang and len(w) > len(words) and 100 * b >= 100 * a and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if not longer:
            score, k, left, right = min((scale * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
            out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def phrase_rows(seed=3, n=160):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "É", "a-b", " x", "日本", "zz"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" "] * 12 + ["\t ", ". ", ",", "\n", "  ", "\x0b", "\x1c "]) for _ in range(rng.randrange(60)))
        rows.append((i if i % 9 else None, [None, "en", "de", "und"][i % 4], text + " new york city hall" * (i % 3)))
    return [*rows, rows[5], (900, "en", None), (901, "en", ""), (902, "en", " \t.,;"), (903, "en", "new york " * 4000), (904, "en", "q" * 70000 + " of the")]


def found_phrases(out):
    return sorted(tuple(r)[:8] for r in out.collect())


@pytest.mark.parametrize("how", [phrases.Phrases(least=8), phrases.Phrases(least=12, block_bytes=500, block_words=37, step=100, held=200, top=7), phrases.Phrases(least=8, bits=1, most_blocks=1)])
def test_phrases(spark, how):
    rows = phrase_rows()
    out = phrases.collocations(table(spark, rows).repartition(5), how)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "at"]
    want = phrases_brute(rows, how.least, top=how.top)
    assert found_phrases(out) == want and len(want) > 20
    texts = {i: re.findall("[^\x20\x09.,;:!?\n-\r]+", (t or "").encode().lower().decode()) for i, _, t in rows if i is not None}
    for r in out.collect():  # pointers lead to the phrase
        if r["at"].doc_id is not None:
            assert " ".join(texts[r["at"].doc_id][r["at"].word :][: r.phrase.count(" ") + 1]) == r.phrase


def test_phrases_of_equal_fingerprints(spark):
    """Should all words or runs have one fingerprint, texts still tell them apart."""
    rows = phrase_rows(n=40)[:46]
    ids = np.array([0, 1, 0, 2, 1, 0])
    first, counts = phrases.same_runs(ids, np.zeros(6, np.uint64), 2, np.array([0, 1, 2, 4]), np.zeros(4, np.uint64))
    assert sorted(zip(first.tolist(), counts.tolist(), strict=True)) == [(0, 1), (1, 2), (2, 1)]
    first, counts = phrases.same_runs(ids, np.zeros(6, np.uint64), 1, np.arange(6), np.array([0, 5, 0, 5, 5, 0], np.uint64))
    assert sorted(counts.tolist()) == [1, 2, 3]
    raw = np.frombuffer(b"ab ab cd AB", np.uint8)
    starts, ends = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])
    flat = np.zeros(4, np.int64)
    chunk = phrases.Chunk(raw, starts, ends, flat, flat, flat, np.zeros(4, np.uint64), np.zeros(4, np.uint64), 4)
    assert phrases.same_words(chunk).tolist() == [0, 0, 1, 0]
    assert found_phrases(phrases.collocations(table(spark, rows), phrases.Phrases(least=6))) == phrases_brute(rows, 6)


def test_span_hashes_do_not_depend_on_steps():
    raw = np.frombuffer(b"Some words, OF several sizes" + b"x" * 100 + b" end", np.uint8)
    spans = [m.span() for m in re.finditer(rb"[^ ]+", raw.tobytes())]
    starts, ends = (np.array(x, np.int64) for x in zip(*spans, strict=True))
    one = phrases.span_hashes(raw, starts, ends, 1 << 10)
    for step in (1, 7, 50):
        assert (phrases.span_hashes(raw, starts, ends, step) == one).all()


def test_phrases_without_any(spark):
    for rows in ([], [(1, None, None)], [(1, "en", "one two three")]):
        assert phrases.collocations(table(spark, rows), phrases.Phrases(least=2)).collect() == []


def test_phrase_scores_beyond_64_bits(spark):
    docs = table(spark, [(1, "en", "a b " * 4000)])
    how = phrases.Phrases(least=10, scale=10**9 - 1)
    assert found_phrases(phrases.collocations(docs, how)) == phrases_brute([(1, "en", "a b " * 4000)], 10, scale=10**9 - 1)


# WARC


def page_rows(seed=4):
    rng = random.Random(seed)
    html = [f"<p>{rng.random()} é 日本</p>" * rng.randrange(1, 30) for _ in range(30)] + [None, "", "\r\n\r\n", "x" * 300000]
    rows = [(i, None if i % 11 == 0 else f"http://a.org/{i} \r\nWARC-Type: x", html[rng.randrange(len(html))]) for i in range(150)]
    return [*rows, *((i, "http://hot.org/", "<hot>") for i in range(200, 700)), rows[7], (None, "http://b.org", "<hot>"), (None, "http://b.org", "only null")]


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], "page_id long, url string, html string, first string, key int")


def warc_brute(rows, least=0):
    first = {}
    for i, _, h in rows:
        h = h or ""
        first[h] = min((x for x in (first.get(h), i) if x is not None), default=None)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= least and first[h or ""] is not None and i != first[h or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [warc.Archives(), warc.Archives(file_bytes=2000, step=100), warc.Archives(least=10, level=1)])
def test_archives(spark, how):
    rows = page_rows()
    out = warc.page_archives(pages_of(spark, rows).repartition(6), how)
    assert sorted(map(tuple, out.collect()), key=str) == warc_brute(rows, how.least)


def test_archives_are_warc(spark):
    """A gzip member a record, whole headers, and payloads that come back."""
    rows = page_rows()
    files = warc.archive_pages(pages_of(spark, rows), warc.Archives(file_bytes=5000))
    assert files.agg(F.sum("records")).first()[0] == len(rows) and files.count() > 3
    back = warc.archived(spark, [r.path for r in files.collect()]).where("record_type = 'response'")
    assert {r.payload.decode() for r in back.collect()} == {h or "" for *_, h in rows}
    path = files.first().path.removeprefix("file://")
    raw = open(path, "rb").read()
    plain = gzip.decompress(raw)
    offsets = sorted(r.offset for r in back.where(F.col("path").endswith(path)).collect())
    for at in offsets:
        assert zlib.decompressobj(31).decompress(raw[at:]).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert plain.count(b"WARC/1.1\r\n") >= len(offsets)
    assert warc.page_archives(pages_of(spark, []), None).collect() == []


def test_broken_archives_are_faults():
    how = warc.Archives(step=64)
    good = warc.record(1, "http://a.org", b"payload" * 50, how) + warc.record(2, None, None, how, 350, "ABC", 1)
    got = list(warc.read_records(io.BytesIO(good), how, payloads=True))
    assert [r.payload for r in got] == [b"payload" * 50, b""] and got[1].http["content-length"] == "350" and got[1].header["warc-refers-to"] == "<urn:x-page:1>"
    assert list(warc.read_records(io.BytesIO(b""), how)) == []
    pack = lambda x: gzip.compress(x)
    plain = gzip.decompress(warc.record(1, None, b"abc", how))
    other = warc.record(3, None, b"abd", how)
    bad = [good[:-5], b"no gzip at all", good + b"\0", pack(plain.replace(b"abc", b"abd")), pack(plain.replace(b"WARC/1.1", b"HTTP/1.1")), pack(plain[:-1]), pack(plain + b"x"), pack(plain.replace(b"Content-Length: ", b"Content-Size: ")), other[:20] + other]
    for raw in bad:
        with pytest.raises(warc.Fault):
            list(warc.read_records(io.BytesIO(raw), how))
    with pytest.raises(warc.Fault):
        list(warc.read_records(io.BytesIO(pack(plain)), warc.Archives(most_header=10)))


# spelling variants


def variants_brute(rows, every, shortest=7, least=2, times=10):
    n = Counter()
    for i, _, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if every and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    letters = sorted({c for w in n for c in w})
    near = {}
    for w in n:
        cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        own = {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}
        near[w] = sorted(((-n[x], x) for x in own - {w} if x in n))
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= times * n[w] else None for w in n}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def variant_rows(seed=6):
    rng = random.Random(seed)
    base = ["colours", "éclairs", "aaaaaaaa", "harbour", "ÀÉÎÕÜÿ×", "training", "xyzxyzxyz", "bookkeeper", "q" * 300]
    rows = []
    for i in range(400):
        words = []
        for _ in range(rng.randrange(30)):
            w = base[min(int(rng.expovariate(0.7)), len(base) - 1)]
            for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abzéÿ") + w[p:], w[:p] + rng.choice("abzéÿ") + w[p + 1 :]])
            words.append(rng.choice([str.upper, str.title, str, str])(w) if w.isascii() else w)
        rows.append((i if i % 8 else None, "en", rng.choice([" ", "-", "1", "Ā"]).join(words)))
    return [*rows, rows[3], (900, None, None), (901, None, ""), (902, None, "harbour " * 9000), (903, None, "Ａcolours ĀcoloursĀ")]


@pytest.mark.parametrize("how", [variants.Spelling(typo_every=31), variants.Spelling(typo_every=5, held=30, block=50, shards=2), variants.Spelling(shortest=3, times=2, bits=64, most_blocks=64), variants.Spelling(bits=1, most_blocks=1, most_turns=1)])
def test_variants(spark, how):
    rows = variant_rows()
    out = variants.spelling_variants(table(spark, rows).repartition(5), how)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants_brute(rows, how.typo_every, how.shortest, how.least, how.times)
    assert sorted(map(tuple, out.collect())) == want and sum(r[1] is not None for r in want) > 5


def test_variants_follow_chains(spark):
    chain = [("abcdefg", 2), ("abcdefgh", 20), ("abcdefghi", 200), ("abcdefghij", 2000)]
    rows = [(1, None, " ".join(f"{w} " * n for w, n in chain))]
    got = {r.word: (r.form, r.root) for r in variants.spelling_variants(table(spark, rows)).collect()}
    assert got == {"abcdefg": ("abcdefgh", "abcdefghij"), "abcdefgh": ("abcdefghi", "abcdefghij"), "abcdefghi": ("abcdefghij", "abcdefghij"), "abcdefghij": (None, "abcdefghij")}
    assert variants.spelling_variants(table(spark, [])).collect() == []


def test_blocked_filters_lose_nothing(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 3000)
    rows = spark.createDataFrame([(int(k), i % 3) for i, k in enumerate(keys)], "k long, s int")
    for most in (1, 64, 1 << 18):
        found = blocked.blocked(rows, "k", [1000, 1000, 1000], "s", most_blocks=max(3, most))
        for s in range(3):
            assert found.may_hold(keys[s::3].view(np.uint64), s).all()
    free = rng.integers(-(2**63), 2**63 - 1, 3000).view(np.uint64)
    assert found.may_hold(free, 0).mean() < 0.01
    assert not blocked.blocked(rows, "k", [0], None).may_hold(free).any()
