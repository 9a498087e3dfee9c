"""Collocated phrases by Rabin-Karp fingerprints.

Tasks hash words and n-grams of whole texts with numpy: prefix polynomials (modulo 2**64) over a text's bytes give a
fingerprint for every word, prefix polynomials over those one for every run of words, by two lookups and a product.
Fingerprints are counted length by length: a run is counted only if both runs that are a word shorter may be frequent,
by a broadcast blocked Bloom filter of those found so far. Neither texts nor rare phrases are shuffled.

The last pass gathers, for what may be frequent, fingerprints with pointers to occurrences. Each task holds every
occurrence's words against those at the pointer, so that different texts of one fingerprint part, and only then makes
the phrase's text; the shuffle adds up by text. Counts are exact whatever collides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.llm.blocked import Blocked, blocked, inverse, powers, signed
from depweave.llm.memory import let_go
from depweave.llm.store import save
from depweave.llm.words import mixed
from depweave.operators.spread import spread_join

_BYTE_BASE, _WORD_BASE, _LENGTH = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F, np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Phrases:
    """Phrases of 2 to ``longest`` words with at least ``least`` occurrences; the first ``top`` of each language.
    ``block_bytes``: bytes of text worked on at once, ``block_words``: words of them, ``step``: bytes that are hashed at
    once; ``held``: fingerprints that a task holds before it hands them on. ``bits`` a key and ``most_blocks`` bound a
    filter (2**18 blocks: 8 MB); a crowded one costs time, never a phrase."""

    least: int = 100
    longest: int = 5
    top: int = 2000
    scale: int = 1000
    block_bytes: int = 1 << 20
    block_words: int = 1 << 18
    step: int = 1 << 19
    held: int = 1 << 21
    bits: int = 24
    most_blocks: int = 1 << 18


def _kinds() -> np.ndarray:
    """0: part of a word, 1: between words, 2: between pieces."""
    out = np.zeros(256, np.uint8)
    out[[*b" \t"]] = 1
    out[[*b".,;:!?\n\x0b\x0c\r"]] = 2
    return out


_KIND = _kinds()
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: A byte's coefficient, for capitals that of the small letter.
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))[_LOWER]


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(base, n), powers(inverse(base), n)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int) -> np.ndarray:
    """Fingerprints of spans of bytes in ascending order, by prefix polynomials over ``step`` bytes at once."""
    power, back = _powers(_BYTE_BASE, step + 1)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + step, side="right")))
        hi = ends[j - 1]
        if hi - lo <= step:
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_VALUE[raw[lo:hi]] * power[: hi - lo], out=sums[1:])
            out[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * back[starts[i:j] - lo]
        else:  # one span of more bytes
            total, shift = 0, 1
            for at in range(lo, hi, step):
                part = raw[at : min(at + step, hi)]
                total += shift * int((_VALUE[part] * power[: len(part)]).sum(dtype=np.uint64))
                shift = shift * pow(_BYTE_BASE, step, 1 << 64) % (1 << 64)
            out[i] = total % (1 << 64)
        i = j
    return mixed(out + (ends - starts).astype(np.uint64) * _LENGTH)


@dataclass
class Chunk:
    """Words of some texts: where each lies in ``raw``, its piece, row, number in its text. Runs that begin at the first
    ``own`` words are this chunk's; the words after those only end them."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    piece: np.ndarray
    row: np.ndarray
    number: np.ndarray
    words: np.ndarray
    seeds: np.ndarray
    own: int

    def __post_init__(self):
        power, self.back = _powers(_WORD_BASE, 1 << max(10, (len(self.words) + 1).bit_length()))
        self.sums = np.zeros(len(self.words) + 1, np.uint64)
        np.cumsum(self.words * power[: len(self.words)], out=self.sums[1:])

    def whole(self, k: int) -> np.ndarray:
        """Whether the run of k words from each word lies in one piece."""
        out = np.zeros(len(self.words), bool)
        if len(out) >= k:
            out[: len(out) - k + 1] = self.piece[: len(out) - k + 1] == self.piece[k - 1 :]
        return out

    def hashes(self, k: int, at: np.ndarray) -> np.ndarray:
        """Fingerprints of the runs of k words from the words ``at``."""
        return mixed((self.sums[at + k] - self.sums[at]) * self.back[at] + self.seeds[at] + np.uint64(k * int(_LENGTH) % (1 << 64)))

    def passed(self, k: int, within: np.ndarray, known: Blocked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the runs of k words ``within``: which may be known (a mask), where these begin, and their fingerprints."""
        at = np.flatnonzero(within)
        found = self.hashes(k, at)
        hit = known.may_hold(found)
        out = np.zeros(len(within), bool)
        out[at[hit]] = True
        return out, at[hit], found[hit]

    def both(self, shorter: np.ndarray, k: int) -> np.ndarray:
        """Runs of k words whose both shorter runs are among ``shorter``."""
        out = self.whole(k)
        out[:-1] &= shorter[:-1] & shorter[1:]
        return out


def _blocks(batch: pa.RecordBatch, how: Phrases) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Slices of (doc_id, lang, text) with at most ``block_bytes`` of text, or one longer text."""
    texts = batch.column(2)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + how.block_bytes, side="right")))
        yield tuple(batch.column(c).slice(i, j - i) for c in range(3))
        i = j


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))


def chunks(batch: pa.RecordBatch, how: Phrases) -> Iterator[tuple[Chunk, pa.Array, list[str]]]:
    """The words of doc_id, lang and text (strings without nulls but for doc_id) by chunks; with each the doc_ids and
    languages of its rows."""
    for ids, langs, texts in _blocks(batch, how):
        each = [x.as_buffer() for x in texts]
        raw = np.frombuffer(b"".join(each), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([x.size for x in each], dtype=np.int64))).astype(np.int64)
        names = langs.to_pylist()
        seeds = np.array([_seed(x) for x in names], np.uint64)
        kind = _KIND[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        word = kind == 0
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        piece = np.cumsum((kind == 2) | edge[:-1], dtype=np.int32)[starts]
        row = np.searchsorted(offsets, starts, side="right") - 1
        number = np.arange(len(starts)) - np.searchsorted(starts, offsets[row])
        del kind, edge, word, first, last
        words = span_hashes(raw, starts, ends, how.step)
        for lo in range(0, len(starts), how.block_words):
            hi = min(len(starts), lo + how.block_words + how.longest - 1)
            cut = slice(lo, hi)
            own = min(how.block_words, hi - lo)
            yield Chunk(raw, starts[cut], ends[cut], piece[cut], row[cut], number[cut], words[cut], seeds[row[cut]], own), ids, names


class Sums:
    """Counts by fingerprint, folded whenever ``most`` are held."""

    def __init__(self, most: int):
        self.most, self.keys, self.counts, self.size = most, [], [], 0

    def add(self, keys: np.ndarray) -> bool:
        """Whether so many are distinct that they should go on."""
        self.keys.append(keys)
        self.counts.append(np.ones(len(keys), np.int64))
        self.size += len(keys)
        if self.size <= self.most:
            return False
        self.fold()
        return self.size > self.most // 2

    def fold(self) -> None:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        counts = np.add.reduceat(counts, first) if len(first) else counts
        self.keys, self.counts, self.size = [keys[first]], [counts], len(first)

    def rows(self) -> pa.RecordBatch:
        """What is held, which is then let go."""
        if self.size:
            self.fold()
        keys, counts = (self.keys[0], self.counts[0]) if self.size else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.keys, self.counts, self.size = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(counts)], names=["fp", "n"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce(F.col("text").cast("string"), F.lit("")))


def _counted(docs: DataFrame, k: int, shorter, how: Phrases) -> DataFrame:
    """fp, n of the runs of k words, added up, from ``least`` on. ``shorter``: the broadcast filter of runs one word
    shorter that may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(how.held)
        for batch in batches:
            for chunk, *_ in chunks(batch, how):
                if k == 1:
                    at = np.arange(chunk.own)
                else:
                    mask = chunk.both(chunk.passed(k - 1, chunk.whole(k - 1), shorter.value)[0], k)
                    at = np.flatnonzero(mask[: chunk.own])
                if sums.add(chunk.hashes(k, at)):
                    yield sums.rows()
        yield sums.rows()
        let_go()

    return _texts(docs).mapInArrow(run, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= how.least)


def frequent_fingerprints(docs: DataFrame, how: Phrases) -> Blocked | None:
    """The filter of all fingerprints, of one to ``longest`` words, that occur ``least`` times or more."""
    found, shorter, total = None, None, 0
    for k in range(1, how.longest + 1):
        own = save(_counted(docs, k, shorter, how).select("fp"), "phrase-prints")
        n = own.count()
        if not n:
            break
        total += n
        found = own if found is None else found.unionByName(own)
        shorter = docs.sparkSession.sparkContext.broadcast(blocked(own, "fp", [n], bits=how.bits, most_blocks=how.most_blocks))
    return None if found is None else blocked(found, "fp", [total], bits=how.bits, most_blocks=how.most_blocks)


def same_words(chunk: Chunk) -> np.ndarray:
    """A number for each word, equal for equal words: each is held against the first of its fingerprint, byte by byte,
    and should one differ, all are numbered by their bytes."""
    _, first, ids = np.unique(chunk.words, return_index=True, return_inverse=True)
    lead, size = first[ids], chunk.ends - chunk.starts
    same = np.array_equal(size, size[lead])
    for lo in range(0, len(ids), 1 << 14):  # by slices, each of the bytes of so many words
        if not same:
            break
        n = size[lo : lo + (1 << 14)]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        mine = chunk.raw[np.repeat(chunk.starts[lo : lo + (1 << 14)], n) + inside]
        theirs = chunk.raw[np.repeat(chunk.starts[lead[lo : lo + (1 << 14)]], n) + inside]
        same = np.array_equal(_LOWER[mine], _LOWER[theirs])
    if same:
        return ids
    known: dict[bytes, int] = {}
    raw = chunk.raw.tobytes()
    return np.array([known.setdefault(raw[s:e].lower(), len(known)) for s, e in zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True)], np.int64)


def same_runs(ids: np.ndarray, seeds: np.ndarray, k: int, at: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct run first begins, and how often it occurs; runs of one fingerprint are held against the first
    of them word by word, and should one differ, runs are told apart by their words."""
    _, first, to, counts = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
    lead = at[first][to]
    if all(np.array_equal(ids[at + i], ids[lead + i]) for i in range(k)) and np.array_equal(seeds[at], seeds[lead]):
        return at[first], counts
    runs = np.stack([seeds[at].view(np.int64), *(ids[at + i] for i in range(k))], axis=1)
    _, first, counts = np.unique(runs, axis=0, return_index=True, return_counts=True)
    return at[first], counts


def run_texts(chunk: Chunk, k: int, at: np.ndarray) -> pa.Array:
    """The runs of k words from the words ``at``: in lower case, a space between words."""
    which = (at[:, None] + np.arange(k)).ravel()
    size = chunk.ends[which] - chunk.starts[which] + 1  # and a space
    ends = np.cumsum(size)
    index = np.repeat(chunk.starts[which] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    index[ends - 1] = 0
    out = _LOWER[chunk.raw[index]]
    out[ends - 1] = ord(" ")
    # A run's last space belongs to no run: it stays between them, so the runs' bytes are taken apart from it.
    keep = np.ones(len(out), bool)
    keep[ends[k - 1 :: k] - 1] = False
    offsets = np.concatenate(([0], ends[k - 1 :: k] - np.arange(1, len(at) + 1))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(out[keep])).cast(pa.string())


_FOUND = "lang string, phrase string, words int, n long, doc_id long, word long"


def occurrences(docs: DataFrame, known, how: Phrases) -> DataFrame:
    """lang, phrase, words, f, at for the runs of words that the broadcast filter may hold, and one row of 0 words for
    each language with the number of its words. ``at`` points to an occurrence: doc_id and the word's number."""

    def rows(langs: pa.Array, phrases: pa.Array, k: int, n: np.ndarray, ids: pa.Array, words: np.ndarray) -> pa.RecordBatch:
        columns = [langs, phrases, pa.array(np.full(len(n), k, np.int32)), pa.array(n.astype(np.int64)), ids, pa.array(words.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "words", "n", "doc_id", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, langs in chunks(batch, how):
                names = pa.array(langs, pa.string())
                own, n = np.unique(chunk.row[: chunk.own], return_counts=True)
                yield rows(names.take(pa.array(own)), pa.array([""] * len(own), pa.string()), 0, n, pa.nulls(len(own), pa.int64()), np.zeros(len(own)))
                same = same_words(chunk)
                mask = chunk.whole(1)
                for k in range(1, how.longest + 1):
                    mask, at, prints = chunk.passed(k, mask if k == 1 else chunk.both(mask, k), known.value)
                    own = at < chunk.own
                    if own.any():
                        first, n = same_runs(same, chunk.seeds, k, at[own], prints[own])
                        at_row = pa.array(chunk.row[first])
                        yield rows(names.take(at_row), run_texts(chunk, k, first), k, n, ids.take(at_row), chunk.number[first])
        let_go()

    # Two plain columns, so that rows are added up by a hash of the text.
    found = _texts(docs).mapInArrow(run, _FOUND).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f"), F.first("doc_id").alias("doc_id"), F.first("word").alias("word"))
    return found.select("lang", "phrase", "words", "f", F.struct("doc_id", "word").alias("at"))


def _part(words: Column, start, n) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def _first_rows(rows: DataFrame, top: int, n: int) -> DataFrame:
    """The first ``top`` of each language: first in parts, then among what the parts keep, so that a large language
    isn't ranked in one task."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    parts = max(1, int((n / top) ** 0.5))
    place = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order))
    rows = rows.withColumn("rank", place).where(F.col("rank") <= top) if parts > 1 else rows
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, how: Phrases | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, and at (doc_id, word: an occurrence) of the best phrases of each language.

    A-Z in lower case; words are what lies between spaces and tabs, and no phrase reaches across ``.,;:!?`` or a line
    end. a, l, r: occurrences of the phrase and of its two parts at the cut of the lowest score
    floor(scale * a * n / (l * r)), n: words of the language; ties to the earlier cut. Phrases that a longer frequent
    one always holds are left out. Order: score, then a, both falling, then the phrase by its bytes.

    Whole texts of any length; a null text is empty, a null lang is ``und``; repeated rows count each; rows without a
    doc_id count and are pointed at only with a null. Other columns, whatever their names, aren't read. An empty table,
    or one without frequent phrases, gives an empty result. Products are exact up to 38 digits.
    """
    how = how or Phrases()
    spark = docs.sparkSession
    known = frequent_fingerprints(docs, how)
    if known is None:
        kinds = "lang string, rank int, phrase string, a long, l long, r long, n long, score long, at struct<doc_id: long, word: long>"
        return spark.createDataFrame([], kinds)
    found = occurrences(docs, spark.sparkContext.broadcast(known), how)
    freq = save(found.where((F.col("words") == 0) | (F.col("f") >= how.least)), "phrases")
    totals = freq.where("words = 0").select("lang", F.col("f").alias("n"))
    own = freq.where("words > 1")
    words = F.split("phrase", " ")

    # A longer phrase that is as frequent holds every occurrence of its parts.
    inner = own.where("words > 2").select("lang", "f", "phrase", "words", F.explode(F.expr("sequence(2, words - 1)")).alias("size"))
    inner = inner.select("lang", "f", "phrase", "size", F.explode(F.expr("sequence(1, words - size + 1)")).alias("start"))
    inner = inner.select("lang", _part(words, F.col("start"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    own = own.join(inner, ["lang", "phrase"], "left").where("longer is null or longer < f")

    cuts = own.select("lang", "phrase", F.col("f").alias("a"), "at", F.explode(F.expr("sequence(1, words - 1)")).alias("cut"), "words")
    cuts = save(cuts.select("lang", "phrase", "a", "at", "cut", _part(words, F.lit(1), F.col("cut")).alias("left"), _part(words, F.col("cut") + 1, F.col("words")).alias("right")), "phrase-cuts")
    for end, name in (("left", "l"), ("right", "r")):
        cuts = save(spread_join(cuts, freq.where("words > 0").select("lang", F.col("phrase").alias(end), F.col("f").alias(name)), ["lang", end]), "phrase-cuts")
    cuts = spread_join(cuts, totals, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    exact = [(F.lit(how.scale).cast("decimal(9,0)") * (wide["a"] * wide["n"])).cast("decimal(38,0)").alias("over"), (wide["l"] * wide["r"]).cast("decimal(38,0)").alias("under")]
    scored = cuts.select("*", *exact).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score", "at"), F.struct("score", "cut")).alias("best"))
    best = save(best.select("lang", "phrase", "best.*"), "phrase-scores")
    return _first_rows(best, how.top, best.count()).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "at")
