"""Near-duplicate documents by b-bit MinHash.

Plan (every step is a distributed job; the driver sees counts only):

1. ``sign``: one pass over the texts gives each document its shingle-set size, a 128-bit fingerprint of
   the set, band keys of MinHash minima, and the low bits of every minimum packed four to two bytes.
2. Documents with one fingerprint are one *class*, named by its smallest doc_id, so that thousands of exact
   copies meet the later steps once.
3. Bands: every class is linked as a candidate with the smallest member of each bucket (a star, not all
   pairs). Candidates whose collision-corrected estimate from bit counts is clearly too low are left out;
   the others are confirmed on their full shingle sets.
4. Components of the confirmed links. A bucket whose members are all in one component is done. In any
   other bucket the pairs *between* components are compared in blocks of bounded size, first by bits, then
   by sets; only links leave a block, and they are confirmed too. Members of the bucket's largest component
   meet the others only, never each other. So no link between components is lost to the star, and no table
   of pairs is ever made.

With 40 bands of 5 minima a pair of similarity 0.8 shares no band with probability 1.3e-7, and the
estimate from 200 minima of 4 bits is held to five standard deviations below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm.bloom import blocks_for, bloom, may_hold, only_keys
from depweave.llm.memory import let_go
from depweave.llm.store import save
from depweave.llm.words import mixed, shingle_set
from depweave.operators.cluster import connected_components
from depweave.operators.spread import spread_join


@dataclass(frozen=True)
class MinHash:
    """``similar``: least similarity in hundredths. ``block``: most classes of one bucket in a block."""

    shingle: int = 2
    similar: int = 80
    bands: int = 40
    rows: int = 5
    seed: int = 1
    block: int = 1024
    #: Width of the estimate's margin in standard deviations.
    margin: float = 5.0

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def least_estimate(self) -> float:
        """Similarity estimates below this one can't belong to a link (but for ``margin`` deviations)."""
        p = self.similar / 100 + (1 - self.similar / 100) / 16
        return self.similar / 100 - self.margin * sqrt(p * (1 - p) / self.minima) * 16 / 15


def _coefficients(how: MinHash) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(how.seed)
    draw = rng.integers(0, 2**32, (2, how.minima), dtype=np.uint64).astype(np.uint32)
    return draw[0] | np.uint32(1), draw[1]


def minima(sets: list[np.ndarray], how: MinHash) -> np.ndarray:
    """A row of minima for each of the sets, none of which is empty."""
    a, b = _coefficients(how)
    shingles = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out, value = np.empty((how.minima, len(sets)), np.uint32), np.empty_like(shingles)
    for i in range(how.minima):
        np.multiply(shingles, a[i], out=value)
        value += b[i]
        np.minimum.reduceat(value, starts, out=out[i])
    return out.T


def packed(found: np.ndarray) -> np.ndarray:
    """The low four bits of each (remixed) minimum, two to a byte."""
    low = (mixed(found.astype(np.uint64)) & np.uint64(15)).astype(np.uint8)
    return low[:, ::2] << 4 | low[:, 1::2]


_AGREE = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], np.uint8)


def estimated(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal four-bit minima, less the sixteenth that agrees by chance."""
    share = _AGREE[left ^ right].sum(1, dtype=np.int32) / (2 * left.shape[1])
    return (share - 1 / 16) / (15 / 16)


def band_keys(found: np.ndarray, how: MinHash) -> np.ndarray:
    key = np.tile(np.arange(how.bands, dtype=np.uint64), (len(found), 1))
    for i in range(how.rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + found[:, i :: how.rows].astype(np.uint64))
    return key.view(np.int64)


_SIGNED = "doc_id long, n_shingles long, print_a long, print_b long, bits binary, keys array<long>"


def sign(docs: DataFrame, how: MinHash) -> DataFrame:
    """Signatures of all rows; an empty set has null for its fingerprint, bits and keys."""

    def of(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [i for i, s in enumerate(sets) if len(s)]
        bits: list = [None] * len(sets)
        keys: list = [None] * len(sets)
        prints = np.zeros((len(sets), 2), np.int64)
        if full:
            found = minima([sets[i] for i in full], how)
            for i, x, y in zip(full, packed(found), band_keys(found, how), strict=True):
                bits[i], keys[i] = x.tobytes(), y
                prints[i] = np.frombuffer(xxhash.xxh3_128_digest(sets[i].tobytes()), np.int64)
        empty = np.array([not len(s) for s in sets])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(map(len, sets), pa.int64()),
                pa.array(prints[:, 0], pa.int64(), mask=empty),
                pa.array(prints[:, 1], pa.int64(), mask=empty),
                pa.array(bits, pa.binary()),
                pa.array(keys, pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_shingles", "print_a", "print_b", "bits", "keys"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                sets.append(shingle_set(text.as_py(), how.shingle))
                held += len(sets[-1])
                if held > 1 << 16:
                    yield of(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield of(ids, sets)
        let_go()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SIGNED)


def _estimate(pairs: DataFrame, how: MinHash) -> DataFrame:
    """Pairs (a, b) with their bits, without those whose estimate is too low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("bits_a", "bits_b"))
                keep = pa.array(estimated(left, right) >= how.least_estimate)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.select("a", "b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def _sized(how: MinHash, x: str, y: str):
    """Whether two set sizes allow the similarity."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * how.similar


def confirm(pairs: DataFrame, docs: DataFrame, how: MinHash, repeated: bool = False) -> DataFrame:
    """Of pairs (a, b) of documents (a written table), those with 100 * intersection >= ``similar`` * union on full
    sets. ``repeated``: some doc_id has several rows; then any of its texts will do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i in range(batch.num_rows):
                if a[i] != last or repeated:  # an id with several texts has several sets
                    last, held = a[i], shingle_set(batch.column(2)[i].as_py(), how.shingle)
                other = shingle_set(batch.column(3)[i].as_py(), how.shingle)
                both = np.concatenate((held, other))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared > 0 and 100 * shared >= how.similar * (len(both) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])
        let_go()

    ends = save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "neardup-ends")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = only_keys(texts, "doc_id", ends)
    texts = save(texts.distinct() if repeated else texts, "neardup-texts")
    left, right = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    # A star's centre is in many pairs: they are dealt over tasks, and its text goes to each of those once.
    both = spread_join(pairs.join(right, "b"), left, "a", counted=pairs)
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _open_sets(ids: DataFrame, docs: DataFrame, how: MinHash, repeated: bool) -> DataFrame:
    """id and its shingle set as sorted unsigned 32-bit hashes, of the documents named by ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [np.sort((shingle_set(x.as_py(), how.shingle) >> np.uint64(32)).astype(np.uint32)).tobytes() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sets = only_keys(rows, "id", ids).mapInArrow(run, "id long, shingles binary").where("octet_length(shingles) > 0")
    return sets.distinct() if repeated else sets


class _Forest:
    """Which components of a tile have been linked so far."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while x in self.up:
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.top(x), self.top(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _linked(i: int, others: np.ndarray, sets: list[np.ndarray], how: MinHash) -> tuple[np.ndarray, np.ndarray]:
    """Which sets may be linked with set ``i``, and which are for sure: 32-bit hashes may collide, so two
    shingles are allowed for either way."""
    own, sizes = sets[i], np.array([len(sets[j]) for j in others])
    every = np.concatenate([sets[j] for j in others])
    at = np.searchsorted(own, every)
    at[at == len(own)] = 0
    shared = np.add.reduceat(own[at] == every, np.concatenate(([0], np.cumsum(sizes[:-1]))), dtype=np.int64)
    union = len(own) + sizes - shared
    return 100 * (shared + 2) >= how.similar * (union - 2), 100 * (shared - 2) >= how.similar * (union + 2)


def _blocks(open_: DataFrame, how: MinHash) -> DataFrame:
    """Members of open buckets (key, band, id, component) with their block ``own``: the bucket's largest component has
    ``near`` blocks, numbered after the ``far`` ones of all others, dealt by a hash of the id."""
    sizes = open_.groupBy("key", "component").agg(F.count("*").alias("n"))
    shape = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n"), F.sum("n").alias("members"))
    blocks = lambda n: F.ceil(n / how.block).cast("int")
    shape = save(shape.select("key", "main", blocks(F.col("n")).alias("near"), blocks(F.col("members") - F.col("n")).alias("far")), "neardup-shape")
    chance = F.xxhash64("id")
    own = F.when(F.col("component") == F.col("main"), F.col("far") + F.pmod(chance, "near")).otherwise(F.pmod(chance, "far"))
    return spread_join(open_, shape, "key").select("key", "band", "id", "component", "near", "far", own.cast("int").alias("own"))


def _between(buckets: DataFrame, how: MinHash) -> DataFrame:
    """Pairs between components in the same bucket that are linked, by sets of 32-bit hashes.

    ``buckets`` has (key, band, own, near, far, id, component, n, bits, keys, shingles), see ``_blocks``. Each pair of
    blocks is a tile, so a tile holds about 2 * ``block`` rows. In a tile, pairs of different components that first
    meet in this band are estimated bit by bit; those that pass are compared on their sets, unless links found
    before have joined their components. Only links leave a tile.
    """
    # Blocks of the largest component come after the others and meet those only.
    last = F.when(F.col("own") < F.col("far"), F.col("far") + F.col("near")).otherwise(F.col("far")) - 1
    held = ["id", "component", "n", "own", "band", "bits", "keys", "shingles"]
    tiles = buckets.select("key", *held, F.explode(F.sequence(F.lit(0), last)).alias("other")).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    tiles = tiles.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "id")

    def pairs_of(ids, comp, n, own, band, bits, keys, sets, tile) -> Iterator[pa.RecordBatch]:
        ends = np.concatenate((np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]))
        start = np.concatenate(([0], ends[:-1]))
        end = np.repeat(ends, ends - start)
        # Tiles of two blocks: only pairs across them.
        crossing = np.repeat(np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start), ends - start)
        active, step, found = np.arange(len(tile)), 1, []
        while True:
            active = active[end[active] > active + step]
            if not len(active):
                break
            i, j = active, active + step
            ok = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * how.similar) & (~crossing[i] | (own[i] != own[j]))
            i, j = i[ok], j[ok]
            for k in range(0, len(i), 16384):
                x, y = i[k : k + 16384], j[k : k + 16384]
                near = estimated(bits[x], bits[y]) >= how.least_estimate
                x, y = x[near], y[near]
                first = (keys[x] == keys[y]).argmax(1) == band[x]
                found.append((x[first], y[first]))
            step += 1
        if not found:
            return
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        forest, last, a, b = _Forest(), -1, [], []
        for k, part in zip(*np.unique(i, return_index=True), strict=True):
            if tile[k] != last:
                forest, last = _Forest(), tile[k]
            others = j[part : np.searchsorted(i, k, side="right")]
            mine = forest.top(comp[k])
            others = np.array([x for x in others.tolist() if forest.top(comp[x]) != mine], np.int64)
            for at in range(0, len(others), 256):
                some = others[at : at + 256]
                may, sure = _linked(k, some, sets, how)
                for x, certain in zip(some[may].tolist(), sure[may].tolist(), strict=True):
                    a.append(min(ids[k], ids[x]))
                    b.append(max(ids[k], ids[x]))
                    if certain:
                        forest.join(comp[k], comp[x])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def columns(batch: pa.RecordBatch) -> list:
        wide = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(batch.num_rows, -1)
        out = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)] + [wide(5, np.uint8), wide(6, np.uint32)]
        return [*out, [np.frombuffer(x, np.uint32) for x in batch.column(7).to_pylist()], batch.column(8).to_numpy(zero_copy_only=False)]

    def together(parts: list[list]) -> list:
        return [sum((p[c] for p in parts), []) if c == 7 else np.concatenate([p[c] for p in parts]) for c in range(9)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = columns(batch.slice(at, 2048))
                cut = np.flatnonzero(part[8][1:] != part[8][:-1])
                if rest and part[8][0] != rest[-1][8][-1]:
                    yield from pairs_of(*together(rest))
                    rest = []
                if len(cut):  # whole tiles so far; the last may go on
                    at_ = cut[-1] + 1
                    yield from pairs_of(*together([*rest, [c[:at_] for c in part]]))
                    rest = []
                    part = [c[at_:] for c in part]
                rest.append(part)
        if rest:
            yield from pairs_of(*together(rest))
        rest = []
        let_go()

    return tiles.select(*held, F.xxhash64("key", "low", "high").alias("tile")).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, how: MinHash | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Only ``doc_id`` and ``text`` are read; other columns, whatever their names, don't matter. A null or
    empty text, or one of white space, has no shingles and is linked with nothing: its component is its
    own doc_id. Repeated rows each get their row back; rows that share a doc_id are one document, which is
    linked with whatever one of its texts is linked with. Rows without doc_id join the class of equal texts
    and are never the one that is kept. An empty table gives an empty result.
    """
    how = how or MinHash()
    signed = save(sign(docs, how), "neardup-signed")
    prints = ["print_a", "print_b"]
    full = signed.where("print_a is not null")
    classes = save(full.groupBy(*prints).agg(F.min("doc_id").alias("id")), "neardup-classes")
    known = full.where("doc_id is not null")
    repeated = not known.groupBy("doc_id").count().where("count > 1").isEmpty()
    reps = known.join(classes.select(F.col("id").alias("doc_id"), *prints), ["doc_id", *prints])
    reps = reps.dropDuplicates(["doc_id", *prints]) if repeated else reps
    reps = save(reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bits", "keys"), "neardup-reps")
    bits = reps.select("id", "n", "bits")

    # Stars: each class with the smallest of its bucket. Keys are counted before they are shuffled, and only
    # members of buckets of several are looked up.
    banded = reps.select("id", F.posexplode("keys").alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("members")).where("members > 1")
    buckets = save(buckets.select("key", "first"), "neardup-buckets")
    blocks = blocks_for(buckets.count())
    members = save(may_hold(banded, "key", bloom(buckets, "key", blocks), blocks), "neardup-members")
    banded = save(spread_join(members, buckets, "key"), "neardup-banded")

    def with_bits(pairs: DataFrame) -> DataFrame:
        left, right = (bits.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
        return spread_join(pairs, left, "a").join(right, "b").where(_sized(how, "n_a", "n_b"))

    stars = save(banded.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "neardup-pairs")
    stars = save(_estimate(with_bits(stars), how), "neardup-stars")
    links = confirm(stars, docs, how, repeated)
    if repeated:  # texts of one document
        of = known.join(classes, prints).groupBy("doc_id", "id").count()
        first = of.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last").select("doc_id", "a")
        links = links.unionByName(of.join(first, "doc_id").where("a <> id").select("a", F.col("id").alias("b")))
    links = save(links, "neardup-links")
    label = connected_components(links, src="a", dst="b")

    # What the stars left open: buckets whose members are in more than one component.
    named = save(banded.join(label.withColumnRenamed("node", "id"), "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("component")), "neardup-named")
    open_keys = save(named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"), "neardup-open-keys")
    if not open_keys.isEmpty():
        open_ = save(spread_join(named, open_keys, "key"), "neardup-open")
        sets = _open_sets(save(open_.select("id").distinct(), "neardup-open-ids"), docs, how, repeated)
        short = F.transform("keys", lambda k: F.substring(F.lpad(F.hex(k), 16, "0"), 9, 8))
        held = reps.join(sets, "id").select("id", "n", "bits", F.unhex(F.array_join(short, "")).alias("keys"), "shingles")
        held = save(held, "neardup-sets")
        more = save(_between(_blocks(open_, how).join(held, "id"), how), "neardup-between")
        more = save(confirm(more, docs, how, repeated), "neardup-more")
        if not more.isEmpty():
            label = connected_components(links.unionByName(more), src="a", dst="b")

    # Copies of one text may be very many: classes get their components first, then rows their class.
    final = save(classes.join(label.withColumnRenamed("node", "id"), "id", "left").select(*prints, F.coalesce("component", "id").alias("component")), "neardup-final")
    found = spread_join(signed.select("doc_id", "n_shingles", *prints), final, prints, "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
