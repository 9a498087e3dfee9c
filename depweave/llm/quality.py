"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of hashed character runs, as they are and by class (letter, capital, digit, space, other
signs as they are). Term weights and the latent space (a truncated SVD) come from a bounded sample of labelled
documents and are fitted in one task; its vectors, at most ``labelled`` rows, are broadcast with their labels. Every
document is compared with all of them by exact cosine products in blocks, and its ``neighbours`` nearest vote with their
similarity as weight. Term counts, space and vectors are whole multiples of a small unit, so that all products and sums
are exact in double precision: a score never depends on which documents share a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.functions.names import spare
from depweave.llm.memory import let_go


@dataclass(frozen=True)
class Voting:
    """``labelled``: most labelled documents that the model is fitted on and votes with, drawn by a hash of
    doc_id. ``terms``: hashed terms of each kind. ``power``: similarity's exponent as a weight. ``prior``:
    the score where nothing is labelled."""

    labelled: int = 4096
    terms: int = 1024
    dimensions: int = 48
    neighbours: int = 15
    power: float = 4.0
    accept: float = 0.7
    prior: float = 1.0
    block: int = 256
    seed: int = 3


def _classes() -> np.ndarray:
    """A byte's class: letters (and all of non-ASCII) as ``a``, capitals ``A``, digits ``0``, white space as
    a space but for line ends; other bytes stand for themselves."""
    out = np.arange(256, dtype=np.uint8)
    out[[*b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = ord("a")
    out[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = ord("A")
    out[[*b"0123456789"]] = ord("0")
    out[[*b"\t\x0b\x0c\r"]] = ord(" ")
    return out


_CLASS = _classes()


def _runs(x: np.ndarray, terms: int, seed: int) -> np.ndarray:
    """Counts of hashed runs of three bytes."""
    if len(x) < 3:
        return np.zeros(terms, np.float32)
    x = x.astype(np.uint32)
    code = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1 + 2 * seed)
    return np.bincount(code >> np.uint32(32 - (terms - 1).bit_length()), minlength=terms)[:terms].astype(np.float32)


def term_counts(text: str | None, how: Voting) -> np.ndarray:
    """Log counts of the text's runs: first by class, with letters of a word drawn together, then as they
    are; either kind at length 1."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    kind = _CLASS[raw]
    if len(kind):
        kind = kind[np.concatenate(([True], (kind[1:] != kind[:-1]) | ~np.isin(kind[1:], [*b"aA0"])))]
    out = []
    for x, seed in ((kind, how.seed), (raw, how.seed + 1)):
        counts = np.log1p(_runs(x, how.terms, seed))
        out.append(counts / max(float(np.linalg.norm(counts)), 1e-9))
    return np.concatenate(out)


#: Units of term counts, of the space and of the vectors' components.
_COUNT, _SPACE, _VECTOR = 2.0**18, 2.0**16, 2.0**20


def _units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in whole units; a row without direction stays 0."""
    x = x.astype(np.float64)
    return np.rint(x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9) * _VECTOR)


@dataclass(frozen=True)
class Voters:
    """Term weights times the latent space (terms x dimensions), unit vectors and their labels, vectors in the order of
    their documents' ids as text; space and vectors in whole units."""

    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def scores(self, counts: np.ndarray, how: Voting) -> np.ndarray:
        """Weighted votes of the nearest: exact cosine products with all labelled vectors, ties to the earlier vector. A
        text without any direction (empty, say) gets the mean label."""
        own = _units(np.rint(counts.astype(np.float64) * _COUNT) @ self.space)
        near = (own @ self.vectors.T).astype(np.int64)
        n = len(self.labels)
        k = min(how.neighbours, n)
        place = near * n + np.arange(n - 1, -1, -1)
        first = np.argpartition(-place, k - 1, axis=1)[:, :k]
        first = np.take_along_axis(first, np.argsort(-np.take_along_axis(place, first, 1), axis=1), 1)
        weight = (np.maximum(np.take_along_axis(near, first, 1), 0) / _VECTOR**2) ** how.power
        total = weight.sum(1)
        votes = (weight * self.labels[first]).sum(1)
        return np.clip(np.where(total > 0, votes / np.maximum(total, 1e-12), self.labels.mean()), 0, 1)


def fit(counts: np.ndarray, labels: np.ndarray, how: Voting) -> Voters:
    counts = np.rint(counts.astype(np.float64) * _COUNT) / _COUNT
    weight = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 0.2
    gram = np.zeros((len(weight), len(weight)))
    for at in range(0, len(counts), how.block):
        x = counts[at : at + how.block] * weight
        gram += x.T @ x
    values, vectors = np.linalg.eigh(gram)
    top = np.argsort(-values)[: how.dimensions]
    space = np.rint(weight[:, None] * vectors[:, top] * _SPACE)
    return Voters(space, _units(np.rint(counts * _COUNT) @ space), labels.astype(np.float64))


def held_out(doc_id: str = "doc_id"):
    """Rows that labels are never learned from: crc32 of the doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(docs: DataFrame, how: Voting) -> DataFrame:
    """doc_id, label and the term counts of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, how.block):
                part = batch.slice(start, how.block)
                counts = [term_counts(x.as_py(), how).astype(np.float32).tobytes() for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.binary())], names=["doc_id", "label", "counts"])

    return docs.select(F.col("doc_id").cast("string"), F.col("label").cast("int"), F.col("text").cast("string")).mapInArrow(run, "doc_id string, label int, counts binary")


def learn(docs: DataFrame, labels: DataFrame, how: Voting, label: str = "quality") -> Voters | None:
    """The voters, from at most ``labelled`` rows that are not held out; None without any. Null labels don't
    count; a doc_id with several takes the smallest, and one with several texts the text of the smallest hash.

    One task holds the counts of all drawn rows (16 KB each) and fits; the driver gets the space, the vectors and
    their labels, which is some hundred bytes a drawn row."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("label"))
    drawn = own.orderBy(F.xxhash64("doc_id", F.lit(how.seed)), "doc_id").limit(how.labelled)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds, held = [], [], []
        for batch in batches:
            names += batch.column(0).to_pylist()
            kinds += batch.column(1).to_pylist()
            held += [np.frombuffer(x, np.float32) for x in batch.column(2).to_pylist()]
        if names:
            order = np.argsort(np.array(names, dtype=object))  # rows come in any order
            found = fit(np.stack([held[i] for i in order]), np.array(kinds)[order], how)
            del held
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (found.space, found.vectors, found.labels)], names=["space", "vectors", "labels"])
        let_go()

    found = _counted(rows, how).repartition(1).mapInArrow(run, "space binary, vectors binary, labels binary").first()
    if found is None:
        return None
    space, vectors, kinds = (np.frombuffer(x, np.float64) for x in found)
    width = min(how.dimensions, 2 * how.terms)
    return Voters(space.reshape(-1, width), vectors.reshape(-1, width), kinds)


def score(docs: DataFrame, labels: DataFrame, how: Voting | None = None, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (by default doc_id), then held_out, score (1: the label 1 is likely), predicted.

    Scores come from whole texts of any length alone: labels, lang, source and doc_id are no inputs. Null and empty texts
    get the mean label of the voters. Of equally near voters those of the smaller doc_id (as text) vote first. Repeated
    rows each get their row; with no labelled document every score is ``prior``; an empty table gives an empty result. Columns named like the new ones are replaced, all
    other names are free.
    """
    how = how or Voting()
    new = ["held_out", "score", "predicted"]
    kept = [c for c in columns or ["doc_id"] if c.lower() not in new]
    voters = learn(docs, labels, how)
    model = docs.sparkSession.sparkContext.broadcast(voters)
    rows = [docs[c] for c in kept] + [held_out().alias("held_out")]
    if "text" in kept and docs.schema["text"].dataType == T.StringType():
        at = kept.index("text")
    else:
        at = len(rows)
        rows.append(docs["text"].cast("string").alias(*spare([*kept, *new], "text")))
    rows = docs.select(*rows)
    schema = T.StructType([*rows.schema.fields[: len(kept) + 1], T.StructField("score", T.DoubleType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = model.value
        for batch in batches:
            for start in range(0, batch.num_rows, how.block):
                part = batch.slice(start, how.block)
                if voters is None:
                    found = np.full(part.num_rows, how.prior)
                else:
                    found = voters.scores(np.stack([term_counts(x.as_py(), how) for x in part.column(at)]), how)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names) - 1], pa.array(found.astype(np.float64))], names=names)
        let_go()

    return rows.mapInArrow(run, schema).withColumn("predicted", F.when(F.col("score") >= how.accept, 1).otherwise(0))
