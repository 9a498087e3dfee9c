"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths of the corpus's most frequent pre-tokens, tier two a cache that
each worker fills with what it meets besides. Texts never leave their task: no pre-token is shuffled. The
table itself comes from a summary of bounded size that each task makes of its own pre-tokens; it decides
speed only, never a count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

#: The character that stands for a space.
SPACE = "▁"


@dataclass(frozen=True)
class Counting:
    """``frequent``: rows of the broadcast table; ``task_summary``: pre-tokens that a task reports for it;
    ``task_counter`` and ``worker_cache``: most entries that a task or worker holds at once."""

    limit: int = 4096
    frequent: int = 1 << 16
    task_summary: int = 1 << 13
    task_counter: int = 1 << 19
    worker_cache: int = 1 << 19


#: A run of spaces with what follows it up to a space or a line end; a line end by itself.
_pretokens = re.compile(r" *[^ \n]+|\n| +").findall


def pretokens(text: str) -> list[str]:
    """The text, after the space that the library puts before it, cut where no piece can reach across."""
    return _pretokens(" " + text.replace(SPACE, " ")) if text else []


@lru_cache(maxsize=2)
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model without its leading space, checked for what the cuts of ``pretokens`` rely on."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    across = [p.piece for p in model.pieces if p.type != kinds.BYTE and (SPACE in p.piece.lstrip(SPACE) or "\n" in p.piece)]
    if across or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not model.trainer_spec.byte_fallback or any(p.type == kinds.USER_DEFINED for p in model.pieces):
        raise ValueError(f"{path}: its tokens may reach across spaces or line ends")
    norm.add_dummy_prefix = False
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


class Lengths(dict):
    """Tier one; what it lacks is looked up in tier two, and there encoded at the first time."""

    def __init__(self, frequent: dict[str, int], encode, most: int):
        super().__init__(frequent)
        self.encode, self.most, self.cache = encode, most, {}

    def __missing__(self, word: str) -> int:
        n = self.cache.get(word)
        if n is None:
            if len(self.cache) >= self.most:
                self.cache.clear()
            n = self.cache[word] = len(self.encode(word))
        return n


def _packed(rows: list[tuple[str, int]]) -> tuple[bytes, bytes, bytes]:
    """One blob of the pre-tokens, with sizes and lengths as arrays."""
    words = [w.encode("utf-8", "surrogatepass") for w, _ in rows]
    return b"".join(words), np.array([len(w) for w in words], np.uint32).tobytes(), np.array([n for _, n in rows], np.uint32).tobytes()


def _unpacked(table: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    blob, sizes, lengths = table[0], np.frombuffer(table[1], np.uint32), np.frombuffer(table[2], np.uint32).tolist()
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return {blob[end - size : end].decode("utf-8", "surrogatepass"): n for end, size, n in zip(ends, sizes.tolist(), lengths, strict=True)}


_lengths: dict[tuple, Lengths] = {}


def frequent_lengths(docs: DataFrame, path: str, how: Counting) -> list[tuple[str, int]]:
    """The most frequent pre-tokens, by the sum of the tasks' summaries, with their lengths in tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(pretokens(text.as_py() or ""))
                if len(seen) > how.task_counter:
                    seen = Counter(dict(seen.most_common(how.task_counter // 4)))
        top = [(w, n) for w, n in seen.most_common(how.task_summary) if len(w) <= 64]
        encode = processor(path).encode
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64()), pa.array([len(encode(w)) for w, _ in top], pa.int32())], names=["word", "seen", "length"])

    summaries = docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, seen long, length int")
    top = summaries.groupBy("word", "length").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "word").limit(how.frequent)
    return [(r.word, r.length) for r in top.collect()]


def count_tokens(docs: DataFrame, path: str, how: Counting | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of ``docs``.

    Whole texts of any length; a null text counts as an empty one: no bytes, no tokens; a null doc_id stays null. Strings of control tokens inside
    a text are ordinary text, as in the library. Only doc_id and text are read; repeated rows each give a
    row, and an empty table gives an empty result. ``path`` must be readable on every worker.
    """
    how = how or Counting()
    table = docs.sparkSession.sparkContext.broadcast(_packed(frequent_lengths(docs, path, how)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = table.value
        key = (path, hash(packed), how)
        if key not in _lengths:
            _lengths.clear()
            _lengths[key] = Lengths(_unpacked(packed), processor(path).encode, how.worker_cache)
        length = _lengths[key].__getitem__
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            tokens = np.array([sum(map(length, pretokens(x))) for x in texts], np.int64)
            n_bytes = pa.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(tokens), pa.array(tokens > how.limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
