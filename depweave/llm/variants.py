"""Spelling variants by Bloom-guided neighbourhoods.

The vocabulary's words are cut by length, and each length has a blocked Bloom filter in one broadcast table. Tasks
generate every deletion and replacement of each word as fingerprints (prefix polynomials, so an edit costs a sum and a
product and no text) and probe the filter of the length it would have; an insertion is the other word's deletion. Only
what passes becomes text and is shuffled to an exact join with the vocabulary, which removes false positives.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm.blocked import Blocked, blocked, inverse, powers, signed
from depweave.llm.memory import let_go
from depweave.llm.store import save
from depweave.llm.words import mixed
from depweave.operators.spread import spread_join

_BASE = 0x9E3779B97F4A7C15
#: Code points that words are made of.
_LAST = 0xFF
_CODES = [*range(ord("a"), ord("z") + 1), *range(0xC0, _LAST + 1)]


@dataclass(frozen=True)
class Spelling:
    """Words of at least ``shortest`` code points and ``least`` occurrences; a form occurs ``times`` as often as its
    variant. ``typo_every``: a word loses one code point where its hash is divisible by this (0: never). ``held``: words
    that a task counts before it hands them on. ``bits`` a word and ``most_blocks`` bound the filters that are
    broadcast at once (2**19 blocks of 32 bytes: 16 MB); a vocabulary that needs more is probed in ``most_turns``
    turns at most, each with the filters of one part of it. ``shards``: filters by length, the last for all longer
    words. ``block``: code points of words worked on at once."""

    shortest: int = 7
    least: int = 2
    times: int = 10
    typo_every: int = 0
    held: int = 1 << 18
    bits: int = 16
    most_blocks: int = 1 << 19
    most_turns: int = 64
    shards: int = 48
    block: int = 1 << 16


def runs_of(shortest: int):
    """Finds the maximal runs of at least so many letters in a text whose A-Z are in lower case."""
    return re.compile(rf"[a-zÀ-ÿ]{{{shortest},}}").findall


def misspelt(doc_id: str, word: str, every: int) -> str:
    """The word, less one code point where the hash says so."""
    h = zlib.crc32(f"{doc_id}:{word}".encode()) if every else 1
    if not every or h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, how: Spelling) -> DataFrame:
    """word, n of the words (A-Z in lower case, others as they are) of whole texts."""

    def lower(text: str) -> str:
        return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes know A-Z only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = runs_of(how.shortest), Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # A word of a document is hashed once, however often it occurs there.
                for word, n in Counter(find(lower(text.as_py() or ""))).items():
                    word = misspelt(doc_id, word, how.typo_every)
                    if len(word) >= how.shortest:
                        seen[word] += n
                if len(seen) > how.held:
                    yield rows()
        yield rows()
        let_go()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text").cast("string"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


_VALUE = mixed(np.arange(1, _LAST + 2, dtype=np.uint64))


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(_BASE, n), powers(inverse(_BASE), n)


def _mix(sums: np.ndarray, length: int) -> np.ndarray:
    return mixed(sums + np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64)))


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-16-le"), "<u2").reshape(len(words), -1)


def fingerprints(words: list[str]) -> np.ndarray:
    """A fingerprint of each word."""
    out = np.empty(len(words), np.uint64)
    for length, at in _by_length(words):
        power = _powers(length + 1)[0]
        codes = _codes([words[i] for i in at])
        out[at] = _mix((_VALUE[codes] * power[:length]).sum(axis=1, dtype=np.uint64), length)
    return out


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.array([len(x) for x in words], np.int64)
    for length in np.unique(sizes).tolist():
        yield length, np.flatnonzero(sizes == length)


def _shard(length: int, how: Spelling) -> int:
    return min(length - how.shortest, how.shards)


def vocabulary(counts: DataFrame, how: Spelling) -> DataFrame:
    """word, n, shard (by its length), fp of the words that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            shards = pa.array([_shard(len(x), how) for x in words], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), shards, pa.array(signed(fingerprints(words)))], names=["word", "n", "shard", "fp"])

    long_enough = F.char_length("word") >= how.shortest
    return counts.where((F.col("n") >= how.least) & long_enough).select("word", "n").mapInArrow(run, "word string, n long, shard int, fp long")


def edits(words: list[str], known: Blocked, how: Spelling) -> Iterator[tuple[int, str]]:
    """(place of the word, edit) for the deletions and the replacements by a larger code point that the filters may hold.
    ``words`` have one length; all their positions are tried at once."""
    codes = _codes(words)
    length = codes.shape[1]
    power, back = _powers(length + 1)
    terms = _VALUE[codes] * power[:length]
    whole = terms.sum(axis=1, dtype=np.uint64)[:, None]
    if length > how.shortest:
        # Dropping either of two equal neighbours gives one word.
        tried = np.ones(codes.shape, bool)
        tried[:, 1:] = codes[:, 1:] != codes[:, :-1]
        before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
        sums = (before + (whole - before - terms) * back[1])[tried]
        hits = known.may_hold(_mix(sums, length - 1), _shard(length - 1, how))
        for i, p in np.argwhere(tried)[hits].tolist():
            yield i, words[i][:p] + words[i][p + 1 :]
    rest = whole - terms
    for c in _CODES:
        tried = codes < c
        sums = (rest + _VALUE[c : c + 1] * power[:length])[tried]
        hits = known.may_hold(_mix(sums, length), _shard(length, how))
        for i, p in np.argwhere(tried)[hits].tolist() if hits.any() else ():
            yield i, words[i][:p] + chr(c) + words[i][p + 1 :]


def near_words(words: DataFrame, how: Spelling) -> DataFrame:
    """word, n, near, near_n, once in each direction, for the words of a vocabulary (``vocabulary``, written) that differ
    by one inserted, deleted or replaced code point."""
    spark = words.sparkSession
    counts = {r.shard: r.n for r in words.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # at most shards + 1
    total = sum(counts.values())
    turns = min(how.most_turns, max(1, -(-total * how.bits // (how.most_blocks * 256))))
    possible = []
    for turn in range(turns):
        part = words.where(F.pmod(F.shiftrightunsigned("fp", 50), F.lit(turns)) == turn)
        sizes = [-(-counts.get(s, 0) // turns) for s in range(how.shards + 1)]
        filters = spark.sparkContext.broadcast(blocked(part, "fp", sizes, "shard", how.bits, how.most_blocks))

        def run(batches: Iterator[pa.RecordBatch], filters=filters) -> Iterator[pa.RecordBatch]:
            known = filters.value
            for batch in batches:
                own, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for length, at in _by_length(own):
                    step = max(1, how.block // length)
                    for lo in range(0, len(at), step):
                        place = at[lo : lo + step].tolist()
                        found = list(edits([own[i] for i in place], known, how))
                        columns = [pa.array([own[place[i]] for i, _ in found], pa.string()), pa.array([n[place[i]] for i, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "near"])
            let_go()

        # Even parts, for a small table too: generating edits is the work here.
        tasks = max(spark.sparkContext.defaultParallelism, -(-total // (1 << 16)))
        possible.append(words.select("word", "n").repartition(tasks).mapInArrow(run, "word string, n long, near string"))
    rows = possible[0]
    for x in possible[1:]:
        rows = rows.unionByName(x)
    rows = rows.distinct() if turns > 1 else rows
    pairs = save(rows.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n"), "variant-pairs")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for words with a form. Each step of a chain is ``times`` as frequent, so chains are short; a round
    doubles the steps that a row has followed."""
    longest = forms.agg(F.max("form_n")).first()[0] or 2
    times = forms.agg(F.min(F.col("form_n") / F.col("n"))).first()[0] or 2
    links = save(forms.select("word", F.col("form").alias("root")), "variant-roots")
    for _ in range(max(1, ceil(log2(max(2.0, log2(max(2, longest)) / log2(max(1.5, times)) + 1))))):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = save(spread_join(links, further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variant-roots")
    return links


def spelling_variants(docs: DataFrame, how: Spelling | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` that counts.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts, A-Z in lower case, of ``shortest`` code points
    and ``least`` occurrences. form: of the words that differ by one inserted, deleted or replaced code point the most
    frequent, ties by code points, if it occurs ``times`` as often as the word; root: where following forms ends.

    A null text has no words, a null doc_id hashes as an empty text; repeated rows count each; words of any length are
    treated alike; other columns, whatever their names, aren't read; an empty table gives an empty result.
    """
    how = how or Spelling()
    words = save(vocabulary(word_counts(docs, how), how), "variant-words")
    pairs = near_words(words, how)
    best = F.min(F.struct((-F.col("near_n")).alias("o"), F.col("near")))
    found = pairs.groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best.alias("best"))
    found = save(found.select("word", "n", "n_near", F.when(-F.col("best.o") >= how.times * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.o")).alias("form_n"))).alias("to")), "variant-forms")
    roots = _roots(found.where("to is not null").select("word", "n", "to.form", "to.form_n"))
    rows = words.select("word", "n").join(found.select("word", "n_near", "to"), "word", "left").join(roots, "word", "left")
    return rows.select("word", F.col("to.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("to.form_n").alias("form_n"))
